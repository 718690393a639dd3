"""Word-processor packages to documents: effective run traits, numbered lists, writing spaces, page breaks, one summary for each package.

Unzipping and XML are one Python pass (``documents.word_packages``); all that follows is windows and aggregates over its rows, which move once for blocks and once for runs; what is small in a package (styles, list definitions) comes to them as maps. The plan of writing spaces is made before empty
separators of lists are removed, so that it knows every blank paragraph. A package that cannot be read gives no blocks and an error in its summary, and disturbs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import structure
from ..session import stored
from .documents import word_packages

_TRAITS = ("bold", "italic", "underline", "strike")


def rows(packages: DataFrame, keys: tuple[str, ...] = ("doc_id",), column: str = "content") -> DataFrame:
    """What ``blocks``, ``runs``, ``spaces`` and ``summary`` start from, read once. A paragraph's text stands beside that of its runs, which Zstandard takes as a repetition."""
    return stored(word_packages(packages, keys, column), "zstd")


def runs(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, p_seq, r_seq, text, bold, italic, underline, strike): direct formatting wins; else styles of the paragraph and of the run, each with what it is based on: bold,
    italic and strike of both cancel, of underline the run's wins. Styles that are not there say nothing."""
    styles = structure.resolved_styles(rows.where("part = 'style' and style_id is not null").select(*keys, "style_id", "based_on", *_TRAITS), _TRAITS, keys)
    sheet = styles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("style_id", F.struct(*_TRAITS)))).alias("sheet"))
    run = F.col("part") == "run"
    own = rows.where("part in ('paragraph', 'run')").select(*keys, "p_seq", "r_seq", F.when(run, F.col("text")).alias("text"), "part", "style_id", *_TRAITS).repartition(*keys)  # a package's rows lie together from here on
    said = own.withColumn("p_style", F.max(F.when(~run, F.col("style_id"))).over(W.partitionBy(*keys, "p_seq"))).where(run)
    both = said.join(sheet, list(keys), "left").withColumns({side: F.try_element_at("sheet", style) for side, style in (("p", F.col("p_style")), ("r", F.col("style_id")))})
    none = F.lit(None).cast("boolean")
    value = {t: N.toggle(F.lit(False), F.array(F.col("p")[t], F.col("r")[t]), F.col(t)) for t in ("bold", "italic", "strike")}
    value["underline"] = N.override(F.lit(False), none, F.col("p")["underline"], F.col("r")["underline"], F.col("underline"))
    return both.select(*keys, "p_seq", "r_seq", "text", *[value[t].alias(t) for t in _TRAITS])


def paragraphs(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, text, visible, is_list, format, level, level_text, page_break, page_inside and the spacing) of every paragraph, numbered by its own list or that of level 0. Of two definitions of one
    list or level the least holds. ``page_inside``: a page break within it."""
    paragraph = F.col("part") == "paragraph"
    own = rows.where("part = 'paragraph' or part = 'run' and page_break").select(
        *keys, "part", F.col("p_seq").alias("seq"), F.when(paragraph, F.col("text")).alias("text"), "num_id", F.coalesce("ilvl", F.lit("0")).alias("ilvl"), "page_break", "spacing_line", "spacing_before", "spacing_after",
        F.col("breaks").cast("int").alias("breaks"),
    ).repartition(*keys)
    own = own.withColumn("page_inside", F.max(~paragraph).over(W.partitionBy(*keys, "seq"))).where(paragraph).drop("part")
    small = rows.where("part in ('num', 'level')").select(*keys, "part", "num_id", F.when(F.col("part") == "num", F.col("text")).otherwise(F.col("style_id")).alias("abstract_id"), "ilvl", F.col("name").alias("format"), F.col("text").alias("level_text")).repartition(*keys)
    place = lambda ilvl: F.concat(F.col("abstract_id"), F.lit("\x00"), ilvl)

    def mapped(part: str, key: Column, value: Column, name: str) -> DataFrame:
        one = small.where(F.col("part") == part).groupBy(*keys, key.alias("k")).agg(F.min(value).alias("v")).where("k is not null")
        return one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))

    out = own.join(mapped("num", F.col("num_id"), F.col("abstract_id"), "nums"), list(keys), "left").join(mapped("level", place(F.col("ilvl")), F.struct("format", "level_text"), "levels"), list(keys), "left")
    out = out.withColumn("abstract_id", F.try_element_at("nums", F.col("num_id")))
    out = out.withColumns({"own": F.try_element_at("levels", place(F.col("ilvl"))), "zero": F.try_element_at("levels", place(F.lit("0")))})
    listed = F.col("num_id").isNotNull() & (F.col("num_id") != "0")
    fmt = X.word_list_format(F.coalesce("own.format", "zero.format", F.lit("decimal")))
    return out.select(
        *keys, "seq", "text", (X.trimmed(F.coalesce("text", F.lit(""))) != "").alias("visible"), listed.alias("is_list"), F.when(listed, fmt).alias("format"), F.when(listed, F.expr("try_cast(ilvl AS int)")).alias("level"),
        F.coalesce("own.level_text", "zero.level_text").alias("level_text"), "page_break", "page_inside", "spacing_line", "spacing_before", "spacing_after", "breaks",
    )


def spaces(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The plan of writing spaces, over all paragraphs."""
    return structure.writing_spaces(paragraphs(rows, keys), keys)


def blocks(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, type, text, format, level, lines) in order: paragraphs and list items without the empty separators of lists, breaks (blank_page where one stands before
    nothing or a break), and spaces of so many lines. Each paragraph's text is that of its own runs, page breaks within it come after it. Windows alone, over one partitioning by package."""
    planned = structure.spaces_after(structure.separators(paragraphs(rows, keys), keys), keys)
    none = F.lit(None)

    def block(place: int, where: Column, kind: Column, text: Column = none, fmt: Column = none, level: Column = none, lines: Column = none) -> Column:
        values = ((text, "string", "text"), (fmt, "string", "format"), (level, "int", "level"), (lines, "int", "lines"))
        return F.when(where, F.struct((F.col("seq") * 4 + place).alias("seq"), kind.alias("type"), *[v.cast(t).alias(n) for v, t, n in values]))

    kind = F.when(F.col("is_list"), F.lit("list_item")).otherwise(F.lit("paragraph"))
    each = F.array(
        block(0, F.col("page_break"), F.lit("break")), block(1, ~F.col("gone"), kind, F.col("text"), F.col("format"), F.col("level")), block(2, F.col("page_inside"), F.lit("break")),
        block(3, F.col("space_lines").isNotNull(), F.lit("space"), lines=F.col("space_lines")),
    )
    out = planned.select(*keys, F.explode(F.array_compact(each)).alias("b")).select(*keys, "b.*")
    return structure.page_breaks(out, keys)


def summary(packages: DataFrame, rows: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, error, paragraphs, list_items, spaces, page_breaks, verses) of each package; counts of one that cannot be read are 0."""
    errors = rows.where("part = 'error'").select(*keys, "error")
    shown = X.trimmed(F.coalesce("text", F.lit(""))) != ""
    counted = blocks.groupBy(*keys).agg(
        F.count_if((F.col("type") == "paragraph") & shown).alias("paragraphs"), F.count_if(F.col("type") == "list_item").alias("list_items"), F.count_if(F.col("type") == "space").alias("spaces"),
        F.count_if(F.col("type").isin("break", "blank_page")).alias("page_breaks"), F.count_if(X.verse_marker(F.coalesce("text", F.lit(""))).isNotNull()).alias("verses"),
    )
    names = ("paragraphs", "list_items", "spaces", "page_breaks", "verses")
    return packages.select(*keys).join(errors, list(keys), "left").join(counted, list(keys), "left").select(*keys, "error", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
