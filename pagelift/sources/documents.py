"""Sources: files by extension, plain text, Markdown, HTML blocks, word-processor packages, preferences."""

from __future__ import annotations

import html.parser
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..functions import text as X
from ..session import reachable

KINDS = {"docx": "docx", "pdf": "pdf", "txt": "text", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, extension, kind, error) of the files below a path that Spark reads; kind by the last extension, an error where there is none."""
    ext = F.lower(F.element_at(F.split("path", "[.]"), -1))
    kind = None
    for name, k in KINDS.items():
        kind = (F if kind is None else kind).when(ext == name, F.lit(k))
    df = spark.read.format("binaryFile").load(path).select("path", "length", "content", ext.alias("extension"), kind.alias("kind"))
    return df.withColumn("error", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported extension: "), F.col("extension"))))


def _newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def plain_text(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, page, block, text): pages at form feeds, blocks at two or more line feeds, cut at the right; empty ones go. A null text has none."""
    pages = docs.select(*keys, F.posexplode(F.split(_newlines(F.col(text)), "\f")).alias("page", "body"))
    blocks = pages.select(*keys, "page", F.posexplode(F.filter(F.transform(F.split("body", "\n{2,}"), X.right_trimmed), lambda b: b != "")).alias("block", "text"))
    return blocks


def markdown(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", tables: bool = True) -> DataFrame:
    """(keys, block, type, level, text): a block is a page break, a table, a list, a heading or a paragraph, in this order; ``text`` is the block without
    its heading mark."""
    body = F.replace(_newlines(F.col(text)), F.lit("\f"), F.lit("\n\n\\pagebreak\n\n"))
    blocks = docs.select(*keys, F.posexplode(F.filter(F.split(body, "\n{2,}"), lambda b: b != "")).alias("block", "raw"))
    raw = X.right_trimmed(F.col("raw"))
    level = F.length(F.regexp_extract(raw, "^(#{1,3}) ", 1))
    kind = F.when(X.trimmed(raw).rlike(r"(?i)^(?:\\(?:pagebreak|newpage)|<!--\s*pagebreak\s*-->)\z"), F.lit("break"))
    if tables:
        kind = kind.when(X.is_markdown_table(raw), F.lit("table"))
    kind = kind.when(X.is_list_block(raw), F.lit("list")).when(level > 0, F.lit("heading")).otherwise(F.lit("paragraph"))
    out = blocks.select(*keys, "block", kind.alias("type"), level.alias("level"), raw.alias("text"))
    heading = F.col("type") == "heading"
    return out.withColumn("level", F.when(heading, F.col("level"))).withColumn("text", F.when(heading, F.expr("substring(text, level + 2)")).otherwise(F.col("text")))


def text_summary(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, paragraphs, tables) of Markdown documents, one paragraph at least."""
    blocks = markdown(docs, keys)
    return blocks.groupBy(*keys).agg(F.greatest(F.lit(1).cast("long"), F.count_if(F.col("type") == "paragraph")).alias("paragraphs"), F.count_if(F.col("type") == "table").alias("tables"))


_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li td th blockquote figcaption pre".split())
_SKIP = frozenset("script style head title".split())


class _Blocks(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str, str]] = []
        self.tag, self.cls, self.text, self.skip = "p", "", [], 0

    def close_block(self, tag: str = "p", cls: str = "") -> None:
        said = " ".join("".join(self.text).split())
        if said:
            self.rows.append((self.tag, self.cls, said))
        self.tag, self.cls, self.text = tag, cls, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag in _SKIP:
            self.skip += 1
        elif tag in _BLOCKS:
            self.close_block(tag, named.get("class") or "")
        elif tag == "br":
            self.text.append(" ")
        elif tag == "hr":
            self.close_block()
            self.rows.append(("hr", named.get("class") or "", ""))
        elif tag == "img":
            self.rows.append(("img", named.get("class") or "", named.get("src") or ""))
        elif tag in ("div", "section", "article", "nav", "footer", "header", "ul", "ol", "table", "tr", "figure"):
            self.close_block()

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCKS or tag in ("div", "section", "article", "nav", "footer", "header", "ul", "ol", "table", "tr", "figure"):
            self.close_block()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_rows(page: str | None) -> list[tuple[str, str, str]]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.close_block()
    return parser.rows


def html_blocks(pages: DataFrame, keys: tuple[str, ...], column: str = "html") -> DataFrame:
    """(keys, seq, tag, classes, text) by tag events, without repair of the tree; text of an image is its source."""
    fields = [pages.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", seq int, tag string, classes string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*[getattr(r, k) for k in keys], i, *x) for r in b.itertuples(index=False) for i, x in enumerate(html_rows(getattr(r, column)))]
            yield pd.DataFrame(rows, columns=[*keys, "seq", "tag", "classes", "text"])

    reachable(pages.sparkSession)
    return pages.select(*keys, column).mapInPandas(run, schema)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _on(node: ElementTree.Element | None, name: str) -> bool | None:
    x = None if node is None else node.find(_W + name)
    return None if x is None else (x.get(_W + "val") or "true").strip().lower() not in ("0", "false", "off", "no", "none")


def _value(node: ElementTree.Element | None, *path: str) -> str | None:
    for p in path:
        node = None if node is None else node.find(_W + p)
    return None if node is None else node.get(_W + "val")


def _number(said: str | None) -> float | None:
    try:
        return None if said is None else float(said)
    except ValueError:
        return None


def word_rows(content: bytes) -> Iterator[tuple]:
    """(part, p_seq, r_seq, style_id, text, num_id, ilvl, left_twips, page_break, bold, italic, underline, strike, name, based_on) of a word-processor package:
    part is paragraph, run, style, num or level. Of a paragraph also spacing_line, spacing_before, spacing_after (twips) and breaks (line breaks and runs of them)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        if "word/document.xml" not in names:
            raise ValueError("word/document.xml is missing")
        trees = {n: ElementTree.fromstring(z.read(f"word/{n}.xml")) for n in ("document", "styles", "numbering") if f"word/{n}.xml" in names}
    for p_seq, p in enumerate(trees["document"].iter(_W + "p")):
        pr = p.find(_W + "pPr")
        ind = None if pr is None else pr.find(_W + "ind")
        left = None if ind is None else ind.get(_W + "left") or ind.get(_W + "start")
        said = "".join(t.text or "" for t in p.iter(_W + "t"))
        spacing = None if pr is None else pr.find(_W + "spacing")
        measures = [_number(None if spacing is None else spacing.get(_W + k)) for k in ("line", "before", "after")]
        breaks = sum((b.get(_W + "type") or "textWrapping") == "textWrapping" for b in p.iter(_W + "br"))
        yield ("paragraph", p_seq, None, _value(pr, "pStyle"), said, _value(pr, "numPr", "numId"), _value(pr, "numPr", "ilvl"), left, _on(pr, "pageBreakBefore"), None, None, None, None, None, None, *measures, breaks)
        for r_seq, r in enumerate(p.iter(_W + "r")):
            rp = r.find(_W + "rPr")
            breaks = any((b.get(_W + "type") or "") == "page" for b in r.iter(_W + "br"))
            text = "".join((x.text or "") if x.tag == _W + "t" else "\t" if x.tag == _W + "tab" else "\n" if x.tag == _W + "br" else "" for x in r)
            under = _value(rp, "u")
            yield ("run", p_seq, r_seq, _value(rp, "rStyle"), text, None, None, None, breaks, _on(rp, "b"), _on(rp, "i"), None if under is None else under != "none", _on(rp, "strike"), None, None)
    if "styles" in trees:
        for s in trees["styles"].iter(_W + "style"):
            rp, under = s.find(_W + "rPr"), _value(s, "rPr", "u")
            yield ("style", None, None, s.get(_W + "styleId"), s.get(_W + "type"), None, None, None, _on(s.find(_W + "pPr"), "pageBreakBefore"), _on(rp, "b"), _on(rp, "i"), None if under is None else under != "none", _on(rp, "strike"), _value(s, "name"), _value(s, "basedOn"))
    if "numbering" in trees:
        for n in trees["numbering"].iter(_W + "num"):
            yield ("num", None, None, None, _value(n, "abstractNumId"), n.get(_W + "numId"), None, None, None, None, None, None, None, None, None)
        for a in trees["numbering"].iter(_W + "abstractNum"):
            for v in a.iter(_W + "lvl"):
                yield ("level", None, None, a.get(_W + "abstractNumId"), _value(v, "lvlText"), None, v.get(_W + "ilvl"), None, None, None, None, None, None, _value(v, "numFmt"), None)


_WORD = "part string, p_seq long, r_seq long, style_id string, text string, num_id string, ilvl string, left_twips string, page_break boolean, bold boolean, italic boolean, underline boolean, strike boolean, name string, based_on string, spacing_line double, spacing_before double, spacing_after double, breaks long, error string"


def word_packages(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), column: str = "content") -> DataFrame:
    """keys and the columns of ``word_rows``; a package that cannot be read gives one row with ``error``. One package is parsed at a time, rows of several are handed on together."""
    fields = T.StructType.fromDDL(_WORD).fields
    schema = T.StructType([docs.schema[k] for k in keys] + fields)
    kinds = [_ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place: list[int] = []
            held: list[tuple] = []

            def batch() -> pa.RecordBatch:
                columns = zip(*held, strict=True) if held else ([] for _ in fields)
                made = [b.column(k).take(pa.array(place, pa.int64())) for k in keys] + [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                place.clear()
                held.clear()
                return pa.RecordBatch.from_arrays(made, names=schema.names)

            for i, content in enumerate(b.column(column)):
                try:
                    rows = [(*x, *[None] * (len(fields) - len(x))) for x in word_rows(content.as_py() or b"")]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [("error", *[None] * (len(fields) - 2), f"{type(e).__name__}: {e}")]
                place += [i] * len(rows)
                held += rows
                if len(held) >= _AT_ONCE:
                    yield batch()
            yield batch()

    reachable(docs.sparkSession)
    return docs.select(*keys, column).mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
#: Rows that are handed on together, and those of one package more.
_AT_ONCE = 8192


# fixed values: devices and their settings
DEVICES = ("clara-bw", "clara-colour", "libra-colour", "sage", "elipsa-2e")
SLIDERS = {"font": (2.6, 4.8, 0.2, 3.6), "margin": (3.0, 16.0, 1.0, 8.0)}


def preferences(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with device, orientation, font, margin and chrome of a stored object; what is missing, of another kind or out of bounds takes its default or bound."""
    v = F.try_parse_json(column)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, path, "variant"))

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def number(name: str) -> Column:
        low, high, step, default = SLIDERS[name]
        path = f"$.{name}"
        value = F.when(kind(path) == "VOID", F.lit("0")).when(kind(path) == "BOOLEAN", F.when(text(path) == "true", F.lit("1")).otherwise(F.lit("0"))).otherwise(text(path))
        return N.slider(value, low, high, step, default)

    device = F.when((kind("$.device") == "STRING") & text("$.device").isin(*DEVICES), text("$.device")).otherwise(F.lit("libra-colour"))
    orientation = F.when((kind("$.orientation") == "STRING") & text("$.orientation").isin("portrait", "landscape"), text("$.orientation")).otherwise(F.lit("portrait"))
    chrome = F.when(kind("$.chrome") == "BOOLEAN", text("$.chrome") == "true").otherwise(F.lit(True))
    return rows.withColumns({"device": device, "orientation": orientation, "font": number("font"), "margin": number("margin"), "chrome": chrome})
