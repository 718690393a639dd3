"""Blocks of documents to publications: a canonical body, images as assets, chapters, titles, package files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored
from . import images, markup, package, structure

# fixed values: bounds of a body
SPACE_LINES, LIST_LEVELS, HEADINGS = (2, 12), 8, 6
ALIGNMENTS = ("left", "center", "right")


def canonical(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), carried: tuple[str, ...] = ()) -> DataFrame:
    """blocks (seq, type, text, level, format, lines, src, alignment) in the form that is exported: breaks before nothing or a break become blank pages; spaces have 2 to 12 lines, levels of headings and
    lists are within their bounds, alignments are known ones; empty paragraphs go, and so do blocks of unknown types without text. What is canonical stays as it is.

    Nulls: a null text is empty, a null level the least, a null alignment left. Ties go by type. Other columns than those named are not carried.
    """
    text = X.compact(F.coalesce("text", F.lit("")))
    known = F.col("type").isin("paragraph", "heading", "list_item", "break", "blank_page", "space", "image")
    df = blocks.withColumn("text", text).withColumn("type", F.when(known, F.col("type")).otherwise(F.lit("paragraph")))
    df = structure.page_breaks(df, keys).where(~(F.col("type").isin("paragraph", "heading", "list_item") & (F.col("text") == "")))
    level = F.coalesce(F.col("level").cast("int"), F.lit(0))
    bounded = F.when(F.col("type") == "heading", F.greatest(F.lit(1), F.least(F.lit(HEADINGS), level))).when(F.col("type") == "list_item", F.greatest(F.lit(0), F.least(F.lit(LIST_LEVELS), level)))
    lines = F.when(F.col("type") == "space", F.greatest(F.lit(SPACE_LINES[0]), F.least(F.lit(SPACE_LINES[1]), F.coalesce(F.col("lines").cast("int"), F.lit(0)))))
    aligned = F.when(F.col("alignment").isin(*ALIGNMENTS), F.col("alignment")).otherwise(F.lit("left"))
    return df.select(*keys, "seq", "type", "text", bounded.alias("level"), F.when(F.col("type") == "list_item", F.coalesce("format", F.lit("bullet"))).alias("format"), lines.alias("lines"), F.when(F.col("type") == "image", F.col("src")).alias("src"), aligned.alias("alignment"), *carried)


def assets(body: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(assets, uses) of a canonical body: embedded images that are what they say, each once; and of each image block its file, or what is wrong with it."""
    own = body.where("type = 'image'").select(*keys, F.col("seq").alias("img_no"), F.coalesce("src", F.lit("")).alias("src"))
    checked = images.decoded(own, "src").withColumn("problem", F.when(F.length("src") > images.MOST_CHARS, F.lit("too large")).otherwise(F.col("problem")))
    good = images.packaged(checked.where("problem is null").select(*keys, "img_no", "src", "media_type", "content"), keys)
    one = good.groupBy(*keys, "asset_no", "file_name").agg(F.min_by("media_type", "img_no").alias("media_type"), F.min_by("content", "img_no").alias("content"))
    uses = checked.select(*keys, F.col("img_no").alias("seq"), "problem").join(good.select(*keys, F.col("img_no").alias("seq"), "file_name"), [*keys, "seq"], "left")
    return one.select(*keys, F.col("asset_no").cast("int").alias("asset_no"), F.concat(F.lit("img"), F.col("asset_no").cast("string")).alias("id"), "file_name", "media_type", "content"), uses


def block_html(problem: Column, file_name: Column) -> Column:
    """A canonical block as markup; list items are lists of one, with their level."""
    text, kind = X.escape_html(F.col("text")), F.col("type")
    style = F.when(F.col("alignment") == "left", F.lit("")).otherwise(F.concat(F.lit(' style="text-align:'), "alignment", F.lit('"')))
    tag = F.concat(F.lit("h"), F.col("level").cast("string"))
    wrap = lambda t, c: F.concat(F.lit("<"), t, style, F.lit(">"), c, F.lit("</"), t, F.lit(">"))
    item = F.concat(F.lit("<"), X.list_tag(F.col("format")), F.lit(' class="level-'), F.col("level").cast("string"), F.lit('"><li>'), text, F.lit("</li></"), X.list_tag(F.col("format")), F.lit(">"))
    image = F.when(file_name.isNotNull(), F.concat(F.lit('<figure><img src="images/'), file_name, F.lit('" alt=""/></figure>'))).otherwise(F.concat(F.lit("<p>[Image left out: "), F.coalesce(problem, F.lit("no data")), F.lit("]</p>")))
    return (
        F.when(kind == "heading", wrap(tag, text)).when(kind == "list_item", item).when(kind == "space", F.concat(F.lit('<div class="note-space" data-lines="'), F.col("lines").cast("string"), F.lit('"></div>')))
        .when(kind == "break", F.lit('<div class="page-break"></div>')).when(kind == "blank_page", F.lit('<div class="blank-page"></div>')).when(kind == "image", image).otherwise(wrap(F.lit("p"), text))
    )


def chaptered(body: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, chapter_no, title, html) of a canonical body with file_name and problem of its images: a chapter at each heading of level 1, at most ``structure.MOST_CHAPTERS`` or else one, each beginning with its title.

    Windows and aggregates within documents alone, so that a body whose documents lie together is not moved again."""
    marked = body.withColumn("html", block_html(F.col("problem"), F.col("file_name")))
    marked = marked.withColumn("is_h1", (F.col("type") == "heading") & (F.col("level") == 1)).withColumn("has_object", F.col("type") == "image")
    joined = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda b: b["html"]), "")
    parts = structure.chapters(marked.select(*keys, "seq", "text", "html", "is_h1", "has_object"), keys).groupBy(*keys, "chapter_no").agg(
        F.max((F.length("text") > 0) | F.col("has_object")).alias("filled"), F.max("chapter_title").alias("title"), F.min("seq").alias("seq"), joined(F.struct("seq", "html")).alias("html"),
    ).where("filled")
    n = F.count("*").over(W.partitionBy(*keys))
    no = F.when(n > structure.MOST_CHAPTERS, 1).otherwise(F.row_number().over(W.partitionBy(*keys).orderBy("chapter_no")))
    out = parts.withColumn("no", no.cast("int")).groupBy(*keys, F.col("no").alias("chapter_no")).agg(F.min_by("title", "seq").alias("title"), joined(F.struct("seq", "html")).alias("html"))
    title = F.coalesce("title", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string")))
    return out.select(*keys, "chapter_no", title.alias("title"), markup.titled(markup.prepared(F.col("html")), title).alias("html"))


def exported(blocks: DataFrame, publications: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, archive): each publication (title, author, lang, identifier, modified) with the blocks of its document. One without blocks has one empty chapter.

    Blocks are read twice, once for images; texts move once, with all of their document, and come out of that as archives."""
    image = F.col("type").eqNullSafe("image")
    shown = stored(blocks.where(image))
    pictures, uses = assets(shown, keys)
    none = F.lit(None).cast("string")
    known = blocks.where(~image).withColumns({"problem": none, "file_name": none}).unionByName(shown.withColumn("src", none).join(uses, [*keys, "seq"], "left"))
    own = chaptered(canonical(known.repartition(*keys), keys, ("problem", "file_name")), keys)
    return package.archives(package.package_files(publications, own, pictures, keys, empty=True), keys)
