"""Reflowable publications: constraints as violation queries, the files of a package, the archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import nullcontext

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import reachable
from .images import EXTENSIONS

# fixed values: identifiers of the format, and the order in which assets are checked
RESERVED = ("bookid", "nav", "ncx", "css")
#: In order; the first that holds is an asset's problem.
ASSET_PROBLEMS = ("missing id", "bad file name", "bad id", "duplicate id", "duplicate file name", "unsupported type", "extension mismatch", "empty content")
_SAFE = r"^[A-Za-z0-9._-]+\z"


def asset_violations(assets: DataFrame, chapters: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, asset_no, problem) of assets (asset_no, id, file_name, media_type, content) that a package may not hold. An id may be neither reserved, nor a
    chapter's, nor that of an earlier asset; a file name may not be that of an earlier asset."""
    n_chapters = chapters.groupBy(*keys).agg(F.count("*").alias("n_chapters"))
    earlier = F.row_number().over(W.partitionBy(*keys, "id").orderBy("asset_no")) > 1
    named = F.row_number().over(W.partitionBy(*keys, "file_name").orderBy("asset_no")) > 1
    df = assets.withColumn("repeat_id", earlier).withColumn("repeat_name", named).join(n_chapters, list(keys), "left")
    chapter = F.regexp_extract(F.coalesce("id", F.lit("")), r"^ch([1-9]\d{0,8})\z", 1)
    taken = F.col("id").isin(*RESERVED) | ((chapter != "") & (chapter.try_cast("int") <= F.coalesce("n_chapters", F.lit(0)))) | F.col("repeat_id")
    media, name = F.lower(X.trimmed(F.coalesce("media_type", F.lit("")))), F.coalesce("file_name", F.lit(""))
    ext = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)\z", 1))
    fits = F.lit(False)
    for kind, exts in EXTENSIONS.items():
        fits = fits | ((media == kind) & ext.isin(*exts))
    tests = (
        X.trimmed(F.coalesce("id", F.lit(""))) == "", ~name.rlike(_SAFE), ~F.col("id").rlike(_SAFE), taken, F.col("repeat_name"), ~media.isin(*EXTENSIONS), ~fits, F.coalesce(F.octet_length("content"), F.lit(0)) == 0,
    )
    problem = None
    for test, what in zip(tests, ASSET_PROBLEMS, strict=True):
        problem = (F if problem is None else problem).when(test, F.lit(what))
    return df.withColumn("problem", problem).where("problem is not null").select(*keys, "asset_no", "problem")


def publication_violations(publications: DataFrame, chapters: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, problem): publications without a chapter, or without an identifier."""
    n = chapters.groupBy(*keys).agg(F.count("*").alias("n"))
    problem = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("no chapter")).when(X.trimmed(F.coalesce("identifier", F.lit(""))) == "", F.lit("no identifier"))
    return publications.join(n, list(keys), "left").withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def unresolved_images(references: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """references (src) that no packaged file answers, with ``problem``: remote sources are exempt, embedded and local ones never resolve."""
    src = F.col("src")
    name = F.regexp_extract(src, r"^(?:\./)?images/([A-Za-z0-9._-]+)\z", 1)
    files = assets.select(*keys, F.col("file_name").alias("name")).distinct()
    refs = references.where(~F.coalesce(src.rlike("(?i)^https?://"), F.lit(False))).withColumn("name", name)
    problem = F.when(src.rlike("(?i)^(?:data|blob|file):"), F.lit("unpackaged source")).otherwise(F.lit("missing file"))
    return refs.join(files, [*keys, "name"], "left_anti").withColumn("problem", problem).drop("name")


# fixed values: the container and documents of the format
_CSS = "body{margin:0;padding:0 5%}h1{page-break-before:always}img{max-width:100%}"
_CONTAINER = '<?xml version="1.0" encoding="UTF-8"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_XHTML = '<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="%s"><head><title>%s</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>%s</body></html>'


def package_files(publications: DataFrame, chapters: DataFrame, assets: DataFrame, keys: tuple[str, ...] = ("doc_id",), empty: bool = False) -> DataFrame:
    """(keys, file_seq, path, text, content) of each publication: the type, the container, the style, images, navigation, contents, chapters, the package.

    ``publications``: title, author, lang, identifier, modified (timestamp). ``chapters``: chapter_no, title, html. ``assets``: asset_no, id, file_name, media_type, content. A publication without chapters has no files, or if ``empty``
    one chapter that says so. Each publication's chapters are gathered, so that chapters that lie together are moved no more and their files come out in order.
    """
    pub = publications.select(*keys, *[X.escape_xml(F.coalesce(F.col(c), F.lit(d))).alias(c) for c, d in (("title", "Untitled"), ("author", "Unknown"), ("lang", "en"))], X.escape_xml(X.trimmed(F.col("identifier"))).alias("identifier"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"))
    no = F.col("chapter_no").cast("long")
    named = X.escape_xml(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), no.cast("string"))))
    chapter = lambda no, name, html: F.struct(no.alias("no"), name.alias("name"), html.alias("html"))
    fragment = X.xhtml_fragment(F.coalesce("html", F.lit("<p>(Empty document)</p>")))
    parts = chapters.select(*keys, chapter(no, named, fragment).alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("chapters"))
    picture = F.struct(F.col("asset_no").cast("long").alias("no"), "id", "file_name", "media_type", "content")
    pictures = assets.select(*keys, picture.alias("p")).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("pictures"))
    whole = pub.join(parts, list(keys), "left" if empty else "inner").join(pictures, list(keys), "left")
    whole = whole.withColumn("chapters", F.coalesce("chapters", F.array(chapter(F.lit(1).cast("long"), F.lit("Untitled"), F.lit("<p>(Empty document)</p>"))))).withColumn("pictures", F.coalesce("pictures", F.array().cast(pictures.schema["pictures"].dataType)))

    def each(of: str, said: Callable[[F.Column], tuple]) -> F.Column:
        return F.array_join(F.transform(of, lambda x: F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in said(x)))), "")

    def xhtml(title: F.Column, body: F.Column) -> F.Column:
        return F.format_string(_XHTML, F.col("lang"), title, body)

    said = lambda c: c["no"].cast("string")
    nav = each("chapters", lambda c: ('<li><a href="chapter-', said(c), '.xhtml">', c["name"], "</a></li>"))
    points = each("chapters", lambda c: ('<navPoint id="ch', said(c), '" playOrder="', said(c), '"><navLabel><text>', c["name"], '</text></navLabel><content src="chapter-', said(c), '.xhtml"/></navPoint>'))
    items = each("chapters", lambda c: ('<item id="ch', said(c), '" href="chapter-', said(c), '.xhtml" media-type="application/xhtml+xml"/>'))
    refs = each("chapters", lambda c: ('<itemref idref="ch', said(c), '"/>'))
    images = each("pictures", lambda p: ('<item id="', p["id"], '" href="images/', p["file_name"], '" media-type="', p["media_type"], '"/>'))
    nav = xhtml(F.col("title"), F.concat(F.lit('<nav epub:type="toc" id="toc"><ol>'), nav, F.lit("</ol></nav>")))
    ncx = F.format_string('<?xml version="1.0" encoding="UTF-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="%s"/></head><docTitle><text>%s</text></docTitle><navMap>%s</navMap></ncx>', "identifier", "title", points)
    opf = F.format_string(
        '<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">%s</dc:identifier><dc:title>%s</dc:title>'
        '<dc:creator>%s</dc:creator><dc:language>%s</dc:language><meta property="dcterms:modified">%s</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
        '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>%s%s</manifest><spine toc="ncx">%s</spine></package>',
        "identifier", "title", "author", "lang", "modified", images, items, refs,
    )

    def file(seq: F.Column, path: F.Column, text: F.Column | None = None, content: F.Column | None = None) -> F.Column:
        return F.struct(seq.cast("long").alias("file_seq"), path.alias("path"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("binary") if content is None else content).alias("content"))

    last = 1 << 40
    fixed = lambda *of: F.array(*(file(F.lit(seq), F.lit(path), text) for seq, path, text in of))
    files = F.concat(
        fixed((0, "mimetype", F.lit("application/epub+zip")), (1, "META-INF/container.xml", F.lit(_CONTAINER)), (2, "OEBPS/style.css", F.lit(_CSS))),
        F.transform("pictures", lambda p: file(p["no"] + 2, F.concat(F.lit("OEBPS/images/"), p["file_name"]), content=p["content"])), fixed((last, "OEBPS/nav.xhtml", nav), (last + 1, "OEBPS/toc.ncx", ncx)),
        F.transform("chapters", lambda c: file(F.lit(last + 1) + c["no"], F.concat(F.lit("OEBPS/chapter-"), said(c), F.lit(".xhtml")), xhtml(c["name"], c["html"]))), fixed((2 * last, "OEBPS/content.opf", opf)),
    )
    return whole.select(*keys, F.explode(files).alias("f")).select(*keys, "f.*")


#: Archives that a task holds at once, beside the batch that they are made from.
AT_ONCE = 64


def archives(files: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, archive): a ZIP for each publication, the type first and stored, all else deflated. One group is one publication."""
    own = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file_seq", "path", "text", "content"))).alias("files"))
    schema = T.StructType([own.schema[k] for k in keys]).add("archive", "binary")

    def zipped(key: tuple, rows: list[dict]) -> bytes:
        if all(row["path"] != "mimetype" for row in rows):
            raise ValueError(f"publication {key} has no mimetype")
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for row in rows:
                info = zipfile.ZipInfo(row["path"], (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if row["path"] == "mimetype" else zipfile.ZIP_DEFLATED
                archive.writestr(info, row["content"] or b"" if row["text"] is None else row["text"].encode(), compresslevel=6)
        return buffer.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                named = zip(*(b.column(k).to_pylist() for k in keys), strict=True)
                made = [zipped(key, rows) for key, rows in zip(named, b.column("files").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(made, pa.binary())], names=schema.names)

    reachable(files.sparkSession)
    return own.mapInArrow(run, schema)


def listed(archives: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, entry_no, path, stored, n_bytes) of the entries of each archive, in order; a null archive has none."""
    fields = [archives.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", entry_no int, path string, stored boolean, n_bytes long"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, archive in b[[*keys, "archive"]].itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(archive)) if archive is not None else nullcontext() as z:
                    rows += [(*key, i, e.filename, e.compress_type == zipfile.ZIP_STORED, e.file_size) for i, e in enumerate(z.infolist() if z else ())]
            yield pd.DataFrame(rows, columns=[*keys, "entry_no", "path", "stored", "n_bytes"])

    reachable(archives.sparkSession)
    return archives.mapInPandas(read, schema)


def entries(archive: bytes) -> Iterator[tuple[str, int]]:
    """(name, method) of an archive's entries, in order."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        for info in z.infolist():
            yield info.filename, info.compress_type
