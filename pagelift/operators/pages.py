"""Pages of positioned text to blocks: lines, reading columns, writing spaces, tables, headings, paragraphs and list items, in reading order.

Composed of the operators of ``layout`` and ``tables``, over one partitioning by page; the lines are stored once, for prose, tables and spaces; a group is one page at most. A page that its decoder could not read (``error``) becomes one placeholder block and
disturbs no other; text without a usable position is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..session import stored
from . import layout, tables

#: A smaller reading column with at most this share of the other's baselines is a side rail.
SIDE_RAIL = 0.55


def lines(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, text, y, x_start, x_end, line_height, max_height, char_width, family, size, bold, cells) of text items (``layout.text_items``)."""
    traits = X.font_traits(F.col("font_name"))
    placed = layout.cluster_lines(items, keys, ("font_name", "text", "x", "y", "width", "height", "char_width", "space_before"))
    styled = placed.withColumn("family", F.coalesce(traits["family"], F.lit(""))).withColumn("bold", F.coalesce(traits["bold"], F.lit(False)))
    styled = styled.withColumn("signature", F.concat_ws("|", "family", F.col("bold").cast("string"))).withColumn("part_no", F.col("item_no"))
    cell = F.struct("x", (F.col("x") + F.col("width")).alias("end"), "text")
    found = styled.groupBy(*keys, "line_no").agg(
        F.first("line_y").alias("y"), F.min("x").alias("x_start"), F.max(F.col("x") + F.col("width")).alias("x_end"), F.max("height").alias("max_height"), F.min("char_width").alias("char_width"),
        F.bool_or("bold").alias("bold"), F.array_sort(F.collect_list(cell)).alias("cells"), tables.gathered_parts().alias("parts"), F.collect_list(F.struct("item_no", "family", F.length("text").alias("n"))).alias("fonts"),
    )
    said = F.transform(tables.runs_of_parts(F.col("parts")), lambda r: F.concat(F.when(r["gap_level"] > 0, F.lit(" ")).otherwise(F.lit("")), r["text"]))
    # as layout.dominant_family
    own = lambda f: F.filter("fonts", lambda i: i["family"] == f)
    weighed = F.transform(F.array_distinct(F.transform("fonts", lambda i: i["family"])), lambda f: F.struct(F.aggregate(own(f), F.lit(0), lambda n, i: n + i["n"]).alias("weight"), (-F.array_min(F.transform(own(f), lambda i: i["item_no"]))).alias("early"), f.alias("family")))
    out = found.withColumn("text", F.array_join(said, "")).withColumn("family", F.array_max(weighed)["family"]).drop("parts", "fonts")
    return out.withColumn("line_height", F.col("max_height")).withColumn("size", F.col("max_height"))


def text_blocks(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, block_no, type, level, text, y, lines) of lines in order: headings and paragraphs.

    A line that ends in a letter and a hyphen takes the next one that starts with a small letter. A heading stands apart: nothing is pending before it, or the gap to it is over 1.3 line heights and
    1.2 median heights; headings of one level and family that follow closely are one. All other lines are paragraphs by ``layout.paragraph_breaks``. ``lines`` holds x_start, x_end and top
    of each line of the block.
    """
    order, page = W.partitionBy(*keys).orderBy("line_no"), W.partitionBy(*keys)
    median = N.or_default(F.median("max_height").over(page), 10)
    gap = F.lag("y").over(order) - F.col("y")
    measured = lines.withColumn("median", median).withColumn("gap", gap)
    measured = measured.withColumn("advance", N.or_default(F.median(F.when(F.col("gap") > 0, F.col("gap"))).over(page), N.or_default(F.median("line_height").over(page), 10) * 1.5))
    soft = F.coalesce(F.lag("text").over(order).rlike("[A-Za-z]-\\z") & F.col("text").rlike("^[a-z]"), F.lit(False))
    measured = measured.withColumn("soft", soft).withColumn("run", F.sum(F.when(F.col("soft"), 0).otherwise(1)).over(order)).withColumn("follows", F.coalesce(F.lead("soft").over(order), F.lit(False)))
    part = F.when(F.col("follows"), F.regexp_replace("text", "-\\z", "")).otherwise(F.col("text"))
    first, last = (lambda c: F.min_by(c, "line_no").alias(c)), (lambda c: F.max_by(c, "line_no").alias(c))
    joined = measured.withColumn("part", part).groupBy(*keys, "run").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda p: p["part"]), "").alias("text"), last("y"), first("x_start"), last("x_end"),
        *[F.max(c).alias(c) for c in ("line_height", "max_height", "median", "advance", "size")], first("char_width"), first("family"), F.bool_or("bold").alias("bold"), F.max(F.col("y") + F.col("max_height")).alias("top"),
    ).drop("run")
    level = X.heading_level(F.col("text"), F.col("max_height") / F.greatest(F.col("median"), F.lit(1.0)), F.col("bold"))
    joined = joined.withColumn("level", level)
    body = F.when(F.col("level").isNull() | (F.min(F.col("level").isNotNull()).over(page)), F.lit(True))
    joined = joined.withColumn("text_width", F.greatest(F.max(F.when(body, F.col("x_end"))).over(page) - F.min(F.when(body, F.col("x_start"))).over(page), F.lit(1.0)))
    marked = layout.paragraph_breaks(joined, F.col("advance"), F.col("text_width"), keys).withColumn("gap", F.lag("y").over(order) - F.col("y")).withColumn("before", F.lag("line_height").over(order))

    def step(acc: Column, it: Column) -> Column:
        titled = acc["in_heading"] & it["level"].isNotNull() & (it["level"] == acc["level"]) & (it["family"] == acc["family"]) & (it["gap"] <= F.greatest(it["before"] * 1.7, it["median"] * 1.7))
        apart = ~acc["pending"] | it["gap"].isNull() | (it["gap"] > F.greatest(it["before"] * 1.3, it["median"] * 1.2))
        titled = F.coalesce(titled, F.lit(False))
        heads = ~titled & it["level"].isNotNull() & apart
        heading = titled | heads
        fresh = heads | (~heading & (~acc["pending"] | it["breaks"]))
        return F.struct(
            (~heading).alias("pending"), heading.alias("in_heading"), F.when(heads, it["level"]).when(titled, acc["level"]).alias("level"), F.when(heads, it["family"]).when(titled, acc["family"]).alias("family"),
            F.concat(acc["out"], F.array(F.struct(it["line_no"].alias("line_no"), fresh.alias("fresh"), heading.alias("heading"), F.when(heading, it["level"]).alias("level")))).alias("out"),
        )

    its = F.array_sort(F.collect_list(F.struct("line_no", "level", "family", "gap", "before", "median", "breaks", F.struct("text", "y", "x_start", "x_end", "top", "char_width").alias("line"))))
    zero = F.struct(F.lit(False).alias("pending"), F.lit(False).alias("in_heading"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("family"), F.array().cast("array<struct<line_no:int,fresh:boolean,heading:boolean,level:int>>").alias("out"))
    both = F.zip_with(F.aggregate("its", zero, step, lambda a: a["out"]), "its", lambda o, i: F.struct(o.alias("o"), i["line"].alias("line")))
    kinds = marked.withColumn("line_no", F.col("line_no").cast("int")).groupBy(*keys).agg(its.alias("its")).select(*keys, F.explode(both).alias("b")).select(*keys, "b.o.*", "b.line.*")
    each = kinds.withColumn("block_no", F.sum(F.when(F.col("fresh"), 1).otherwise(0)).over(order).cast("int")).drop("fresh")
    told = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    out = each.groupBy(*keys, "block_no", "heading").agg(
        F.min("line_no").alias("line_no"), F.min("level").alias("level"), told.alias("told"), F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct("line_no", "x_start", "x_end", "top"))).alias("lines"), F.min_by("char_width", "line_no").alias("char_width"),
    )
    text = F.when(F.col("heading"), F.array_join(F.transform("told", lambda t: t["text"]), "\n")).otherwise(F.array_join(F.transform("told", lambda t: X.trimmed(t["text"])), " "))
    out = out.withColumn("text", text).withColumn("type", F.when(F.col("heading"), F.lit("heading")).otherwise(F.lit("paragraph")))
    return out.where("text <> '' or heading").select(*keys, "block_no", "line_no", "type", "level", "text", "y", "lines", "char_width")


def blocks(items: DataFrame, pages: DataFrame, keys: tuple[str, ...] = layout.PAGE, page_width: float = 596.0, page_height: float = 842.0) -> DataFrame:
    """(keys, seq, type, level, format, marker, text, cells, space_lines, column, alignment, vertical_position): a page's blocks in reading order.

    ``items``: item_seq, str, transform, width, height, font_name; ``pages``: has_grid, error, a row for each page. Types: paragraph, heading, list_item, table (a row for each of its rows, with ``cells``), spacer, failed.
    Nulls: an item without text or a whole transform is passed over. Pages without items have no blocks. Ties go by item_seq. Other columns are not carried.
    """
    at = [*keys, "side"]
    failing = pages.where("error is not null").select(*keys)
    text = layout.text_items(items, keys).join(failing, list(keys), "left_anti").withColumn("item_seq", F.col("item_seq").cast("long"))
    split = layout.reading_columns(text, page_width, page_height, keys).select(*keys, "split")
    grids = pages.select(*keys, F.coalesce("has_grid", F.lit(False)).alias("has_grid"))
    sided = text.join(split, list(keys), "left").withColumn("side", F.when(F.col("split").isNull(), F.lit("")).when(F.col("x") < F.col("split"), F.lit("left")).otherwise(F.lit("right"))).drop("split")
    order = W.partitionBy(*at).orderBy("line_no")
    held = layout.spaced(lines(sided, tuple(at)), page_height, tuple(at))
    held = held.withColumn("segment", F.coalesce(F.sum(F.when(F.col("space_lines").isNotNull(), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = [*at, "segment"]
    rest = [c for c in held.columns if c not in (*inside, "line_no")]
    seen = held.groupBy(*inside).agg(F.array_sort(F.collect_list(F.struct("line_no", *rest))).alias("ls")).join(grids, list(keys), "left")
    shape = F.transform("ls", lambda x: F.struct(*(x[c].alias(c) for c in ("line_no", "y", "line_height", "bold", "char_width", "cells"))))
    seen = seen.withColumn("rs", tables.rows_of(shape, F.coalesce("has_grid", F.lit(False))))
    known = seen.select(*inside, F.explode(F.zip_with("ls", "rs", lambda x, r: F.struct(x.alias("l"), r.alias("r")))).alias("b")).select(*inside, "b.l.*", F.col("b.r.row_no").alias("row_no"), F.col("b.r.cells").alias("row_cells"), F.col("b.r.tables").alias("island"))
    known = stored(known.drop("cells"), "zstd")  # read for prose, tables and spaces

    prose = text_blocks(known.where("row_no is null").repartition(*keys), (*inside, "island"))
    left = known.groupBy(*keys).agg(F.min("x_start").alias("text_left"))
    marker = X.list_marker(F.col("text"))
    prose = prose.join(left, list(keys)).withColumn("m", F.when((F.col("type") == "paragraph"), marker)).select("*", *layout.array_position("lines", page_width, page_height))
    listed = F.col("m").isNotNull()
    ragged = (F.col("side") != "") & (F.size("lines") >= 2) & (F.col("alignment") == "right")  # prose of a narrow column stays to the left
    indent = N.indent_level(F.element_at("lines", 1)["x_start"], F.col("text_left"), F.col("char_width"))
    none = F.lit(None)
    prose = prose.select(
        *at, F.col("line_no").cast("double").alias("place"), "y", F.when(listed, F.lit("list_item")).otherwise(F.col("type")).alias("type"), F.when(listed, F.greatest(F.col("m.level"), indent)).otherwise(F.col("level")).alias("level"),
        F.col("m.format").alias("format"), F.col("m.marker").alias("marker"), F.coalesce("m.body", "text").alias("text"), none.cast("array<string>").alias("cells"), none.cast("int").alias("space_lines"),
        F.when(ragged, F.lit("left")).otherwise(F.col("alignment")).alias("alignment"), "vertical_position",
    )

    def plain(df: DataFrame, kind: str, place: Column, y: Column, cells: Column, space: Column) -> DataFrame:
        return df.select(*at, place.cast("double").alias("place"), y.alias("y"), F.lit(kind).alias("type"), *[none.cast(t).alias(c) for c, t in (("level", "int"), ("format", "string"), ("marker", "string"), ("text", "string"))], cells.alias("cells"), space.alias("space_lines"), none.cast("string").alias("alignment"), none.cast("string").alias("vertical_position"))

    tabled = plain(known.where("row_no is not null"), "table", F.col("line_no"), F.col("y"), F.col("row_cells"), none.cast("int"))
    spacer = plain(known.where("space_lines is not null"), "spacer", F.col("line_no") + 0.5, F.col("y") - F.col("gap") / 2, none.cast("array<string>"), F.col("space_lines"))
    every = prose.unionByName(tabled.repartition(*keys)).unionByName(spacer.repartition(*keys))
    # a page has one column or two; two are read by height, the left one first where blocks stand side by side
    numbered = lambda df: df.withColumn("item_seq", F.row_number().over(W.partitionBy(*keys).orderBy("side", "place")).cast("long")).withColumn("x", F.when(F.col("side") == "right", 1.0).otherwise(0.0))
    single = numbered(every.where("side = ''")).withColumn("seq", F.col("item_seq").cast("int"))
    double = layout.ordered_items(numbered(every.where("side <> ''")), 3.0, keys).withColumn("seq", F.col("rank").cast("int")).drop("rank")
    out = single.unionByName(double).withColumn("column", F.nullif(F.col("side"), F.lit("")))
    shown = ["seq", "type", "level", "format", "marker", "text", "cells", "space_lines", "column", "alignment", "vertical_position"]
    failed = pages.where("error is not null").select(*keys, F.lit(1).alias("seq"), F.lit("failed").alias("type"), *[none.cast(t).alias(c) for c, t in (("level", "int"), ("format", "string"), ("marker", "string"))], F.concat(F.lit("(Failed to extract page "), F.col(keys[-1]).cast("string"), F.lit(": "), "error", F.lit(")")).alias("text"), none.cast("array<string>").alias("cells"), none.cast("int").alias("space_lines"), *[none.cast("string").alias(c) for c in ("column", "alignment", "vertical_position")])
    return out.select(*keys, *shown).unionByName(failed.select(*keys, *shown))


def kinds(blocks: DataFrame, pages: DataFrame, keys: tuple[str, ...] = layout.PAGE) -> DataFrame:
    """(keys, kind) of every page: failed, text, image (no text, but ``n_images``, or drawn operators, ``n_ops``, that make a picture) or blank."""
    has = blocks.select(*keys).distinct().withColumn("has_blocks", F.lit(True))
    drawn = (F.coalesce("n_images", F.lit(0)) > 0) | (F.coalesce("n_ops", F.lit(1)) > 0)
    kind = F.when(F.col("error").isNotNull(), F.lit("failed")).when(F.col("has_blocks"), F.lit("text")).when(drawn, F.lit("image")).otherwise(F.lit("blank"))
    return pages.join(has, list(keys), "left").select(*keys, kind.alias("kind"))


def summary(blocks: DataFrame, kinds: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, pages, headings, paragraphs, list_items, table_rows, spacers, column_pages, failed_pages, image_pages, blank_pages) of each document; the last three are sorted arrays."""
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col(page)))).alias(f"{k}_pages")
    per_page = kinds.groupBy(doc).agg(F.count("*").alias("pages"), *[of(k) for k in ("failed", "image", "blank")])
    n = lambda k, name: F.count_if(F.col("type") == k).alias(name)
    per_block = blocks.groupBy(doc).agg(n("heading", "headings"), n("paragraph", "paragraphs"), n("list_item", "list_items"), n("table", "table_rows"), n("spacer", "spacers"), F.count_distinct(F.when(F.col("column").isNotNull(), F.col(page))).alias("column_pages"))
    counted = ("headings", "paragraphs", "list_items", "table_rows", "spacers", "column_pages")
    return per_page.join(per_block, doc, "left").select(doc, "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted], "failed_pages", "image_pages", "blank_pages")
