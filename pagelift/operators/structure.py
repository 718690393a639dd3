"""Document structure: styles, numbering, lists, writing spaces, page breaks, chapters."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import written
from .grouped import met

TRAITS = ("bold", "italic", "underline", "strike")
#: The deepest level of a list, and the characters by which a longer text is known.
LEVELS, PREFIX = 8, 40


def style_chains(styles: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, style_id, ancestor, depth): each style with itself at depth 0 and what it is based on, nearest first.

    A chain ends at a style that is not there and before one that it holds already. Each round joins every unfinished path with the path of the style
    that comes next, so that paths double and a chain of n styles takes in the order of log n rounds, however long it is.
    """
    paths = styles.select(*keys, "style_id", F.array("style_id").alias("path"), F.col("based_on").alias("next"))
    while True:
        paths = written(paths)
        if paths.where("next is not null").isEmpty():
            return paths.select(*keys, "style_id", F.posexplode("path").alias("depth", "ancestor")).select(*keys, "style_id", "ancestor", "depth")
        ahead = paths.select(*keys, F.col("style_id").alias("next"), F.col("path").alias("more"), F.col("next").alias("after"))
        again = F.coalesce(F.array_position(F.transform("more", lambda x: F.array_contains("path", x)), True), F.lit(0)).cast("int")  # 0: the chain meets no style twice
        both = paths.join(ahead, [*keys, "next"], "left").withColumn("again", again)
        more = F.when(F.col("again") > 0, F.slice("more", F.lit(1), F.greatest(F.col("again") - 1, F.lit(0)))).otherwise(F.coalesce("more", F.slice("path", 1, 0)))
        paths = both.select(*keys, "style_id", F.concat("path", more).alias("longer"), F.when(F.col("again") == 0, F.col("after")).alias("next")).withColumnRenamed("longer", "path")


def resolved_styles(styles: DataFrame, traits: tuple[str, ...] = TRAITS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, style_id, traits, depth): of each trait the nearest value in the chain that says something."""
    chains = style_chains(styles, keys).join(styles.select(*keys, F.col("style_id").alias("ancestor"), *traits), [*keys, "ancestor"])
    nearest = [F.min_by(t, F.when(F.col(t).isNotNull(), F.col("depth"))).alias(t) for t in traits]
    return chains.groupBy(*keys, "style_id").agg(*nearest, F.max("depth").alias("depth"))


def table_traits(uses: DataFrame, styles: DataFrame, conditional: DataFrame, part_order: tuple[str, ...], traits: tuple[str, ...] = TRAITS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, use_id, traits) of table cells: of each style in the chain its own traits, then those of the active parts in order; a style overrides what
    it is based on. ``uses``: keys, use_id, style_id, parts."""
    rank = F.array_position(F.array(*[F.lit(p) for p in part_order]), F.col("part"))
    own = styles.select(*keys, F.col("style_id").alias("ancestor"), F.lit("").alias("part"), F.lit(0).cast("long").alias("rank"), *traits)
    every = own.unionByName(conditional.select(*keys, F.col("style_id").alias("ancestor"), "part", rank.alias("rank"), *traits))
    said = uses.join(style_chains(styles, keys), [*keys, "style_id"]).join(every, [*keys, "ancestor"]).where((F.col("part") == "") | F.array_contains("parts", F.col("part")))
    strongest = [F.max_by(t, F.when(F.col(t).isNotNull(), F.struct((-F.col("depth")).alias("near"), "rank"))).alias(t) for t in traits]
    return said.groupBy(*keys, "use_id").agg(*strongest)


def numbered(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """paragraphs with ``format`` and ``level_text`` by num_id and ilvl: the level's own, else level 0's, else decimal."""
    own = levels.select(*keys, "abstract_id", F.col("ilvl"), F.col("format").alias("own_format"), F.col("level_text").alias("own_text"))
    zero = levels.where("ilvl = 0").select(*keys, "abstract_id", F.col("format").alias("zero_format"), F.col("level_text").alias("zero_text"))
    out = paragraphs.join(nums.select(*keys, "num_id", "abstract_id"), [*keys, "num_id"], "left").join(own, [*keys, "abstract_id", "ilvl"], "left").join(zero, [*keys, "abstract_id"], "left")
    fmt = X.word_list_format(F.coalesce("own_format", "zero_format", F.lit("decimal")))
    return out.withColumn("format", fmt).withColumn("level_text", F.coalesce("own_text", "zero_text")).drop("own_format", "own_text", "zero_format", "zero_text")


def nested(items: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """items with ``run`` (of list items without another block between), ``parent_seq`` (the nearest item before of a lower level, in the run), ``depth`` (lists around the item) and ``list_no``
    (in the run; a sibling of another level or format begins another list). Levels count from 0 to LEVELS; others are taken to the nearest of these. Windows alone, a pass over a document's items."""
    order = W.partitionBy(*keys).orderBy("seq")
    starts = F.when(F.col("is_list") & ~F.coalesce(F.lag("is_list").over(order), F.lit(False)), 1).otherwise(0)
    out = items.withColumn("run", F.sum(starts).over(order)).where("is_list").withColumn("seq", F.col("seq").cast("long"))
    level = F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.coalesce(F.col("level").cast("int"), F.lit(0))))
    before = W.partitionBy(*keys, "run").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("_level", level).withColumns({f"_l{k}": F.last(F.when(F.col("_level") == k, F.col("seq")), True).over(before) for k in range(LEVELS)})
    lower = [F.when(F.col("_level") > k, F.col(f"_l{k}")) for k in range(LEVELS)]
    # a level's last item is around this one if no item of a lower level came after it
    none = F.lit(None).cast("long")
    around = [F.when((F.col("_level") > k) & (F.col(f"_l{k}") > F.coalesce(F.greatest(none, none, *(F.col(f"_l{j}") for j in range(k))), F.lit(-(1 << 62)))), 1).otherwise(0) for k in range(LEVELS)]
    depth = F.lit(1)
    for x in around:
        depth = depth + x
    out = out.withColumn("parent_seq", F.greatest(none, *lower)).withColumn("depth", depth)
    sibling = W.partitionBy(*keys, "run", "parent_seq").orderBy("seq")
    same = (F.lag("format").over(sibling).eqNullSafe(F.col("format"))) & (F.lag("_level").over(sibling) == F.col("_level"))
    out = out.withColumn("changed", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("list_no", F.sum("changed").over(sibling))
    return out.select(*items.columns, "run", "parent_seq", "depth", "list_no")


def list_events(items: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, run, event_no, event, depth, tag, seq, text) of ``nested`` items (with text): the lists rebuilt, as what a stack of open lists does at each item.

    An item ends the lists that are deeper than its own, each after its last item, begins a list if none of its kind is open at its place (inside the item before it of a lower level), and then itself. ``event`` is open or close of a list (tag ul or ol)
    or an item (li); the text comes with an item's open. At a run's end all is closed. Lists of one kind side by side are one.
    """
    order = W.partitionBy(*keys, "run").orderBy("seq")
    sibling = W.partitionBy(*keys, "run", "parent_seq").orderBy("seq")
    tag = X.list_tag(F.coalesce("format", F.lit("decimal")))
    opens = F.lag("list_no").over(sibling).isNull() | (F.lag("list_no").over(sibling) != F.col("list_no"))
    # the tags of the lists around an item, outermost first, are carried as what its depth's list was last
    df = items.withColumn("tag", tag).withColumn("opens", opens)
    df = df.withColumns({f"_t{d}": F.last(F.when(F.col("depth") == d, F.col("tag")), True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) for d in range(1, LEVELS + 2)})
    df = df.withColumn("_open", F.array(*(F.col(f"_t{d}") for d in range(1, LEVELS + 2))))
    df = df.withColumns({"_before": F.coalesce(F.lag("depth").over(order), F.lit(0)), "_tags": F.lag("_open").over(order), "_last": F.lead("seq").over(order).isNull()})
    event = lambda kind, d, t, text=None: F.struct(F.lit(kind).alias("event"), d.cast("int").alias("depth"), t.alias("tag"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    none = F.array().cast("array<struct<event:string,depth:int,tag:string,text:string>>")

    def closing(tags: Column, top: Column, least: Column) -> Column:
        """An item and its list, from depth ``top`` down to ``least``."""
        pairs = F.transform(F.sequence(F.greatest(top, least), least, F.lit(-1)), lambda d: F.array(event("close", d, F.lit("li")), event("close", d, F.get(tags, d - 1))))
        return F.when(top >= least, F.flatten(pairs)).otherwise(none)

    depth = F.col("depth")
    goes = F.when(F.col("opens"), closing(F.col("_tags"), F.col("_before"), depth)).otherwise(F.concat(closing(F.col("_tags"), F.col("_before"), depth + 1), F.array(event("close", depth, F.lit("li")))))
    comes = F.concat(F.when(F.col("opens"), F.array(event("open", depth, F.col("tag")))).otherwise(none), F.array(event("open", depth, F.lit("li"), F.coalesce("text", F.lit("")))))
    ends = F.when(F.col("_last"), closing(F.col("_open"), depth, F.lit(1))).otherwise(none)
    rows = df.select(*keys, "run", "seq", F.posexplode(F.concat(goes, comes, ends)).alias("_at", "e"))
    return rows.select(*keys, "run", F.row_number().over(W.partitionBy(*keys, "run").orderBy("seq", "_at")).alias("event_no"), F.col("e.event").alias("event"), F.col("e.depth").alias("depth"), F.col("e.tag").alias("tag"), "seq", F.col("e.text").alias("text"))


def lists_html(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, run, seq, html): each run of lists as markup, at the place of its first item."""
    said = F.when(F.col("event") == "open", F.concat(F.lit("<"), "tag", F.lit(">"), X.escape_html(F.coalesce("text", F.lit(""))))).otherwise(F.concat(F.lit("</"), "tag", F.lit(">")))
    rows = F.array_sort(F.collect_list(F.struct("event_no", said.alias("html"))))
    return events.groupBy(*keys, "run").agg(F.min("seq").alias("seq"), F.array_join(F.transform(rows, lambda r: r["html"]), "").alias("html"))


def writing_spaces(paragraphs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, after_seq, after_key, next_key, empty_paragraphs, lines): runs of blank paragraphs after a visible one that make two lines or more.

    A blank paragraph counts line / 240, one at least, its manual breaks, and its spacing before and after over 240.
    """
    order = W.partitionBy(*keys).orderBy("seq")
    visible = F.col("visible")
    df = paragraphs.withColumn("island", F.count_if(visible).over(order)).withColumn("key", X.match_key(F.col("text"))).withColumn("size", F.when(~visible, _blank_size()))
    grouped = df.groupBy(*keys, "island").agg(
        F.min(F.when(visible, F.col("seq"))).alias("after_seq"), F.max(F.when(visible, F.col("key"))).alias("after_key"), F.count_if(~visible).alias("empty_paragraphs"), F.sum("size").alias("size"),
    )
    after = grouped.withColumn("next_key", F.lead("after_key").over(W.partitionBy(*keys).orderBy("island")))
    return after.where((F.col("island") > 0) & (F.col("size") >= 1.5)).select(*keys, "after_seq", "after_key", "next_key", "empty_paragraphs", _space_lines(F.col("size")).alias("lines"))


def _blank_size() -> Column:
    return F.greatest(F.lit(1.0), F.coalesce("spacing_line", F.lit(240.0)) / 240) + F.coalesce("breaks", F.lit(0)) + (F.coalesce("spacing_before", F.lit(0.0)) + F.coalesce("spacing_after", F.lit(0.0))) / 240


def _space_lines(size: Column) -> Column:
    return F.least(F.lit(12), F.floor(size + 0.5)).cast("int")


def spaces_after(paragraphs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """paragraphs with ``space_lines``: those of ``writing_spaces`` after the paragraph, null where there is none."""
    visible = F.col("visible")
    df = paragraphs.withColumn("island", F.count_if(visible).over(W.partitionBy(*keys).orderBy("seq")))
    df = df.withColumn("size", F.sum(F.when(~visible, _blank_size())).over(W.partitionBy(*keys, "island")))
    return df.withColumn("space_lines", F.when(visible & (F.col("size") >= 1.5), _space_lines(F.col("size")))).drop("island", "size")


def without_separators(paragraphs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """paragraphs without the empty ones between list items (``separators``)."""
    return separators(paragraphs, keys).where("not gone").drop("gone")


def separators(paragraphs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """paragraphs with ``gone``: the empty ones between list items, whose neighbours are both list items, or whose nearest visible paragraphs
    are; the first and the last stay."""
    order = W.partitionBy(*keys).orderBy("seq")
    behind = W.partitionBy(*keys).orderBy(F.col("seq").desc()).rowsBetween(W.unboundedPreceding, -1)  # what follows, in one running pass
    seen = F.when(F.col("visible"), F.col("is_list"))
    near = F.coalesce(F.lag("is_list").over(order), F.lit(False)) & F.coalesce(F.lead("is_list").over(order), F.lit(False))
    far = F.coalesce(F.last(seen, True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)) & F.coalesce(F.last(seen, True).over(behind), F.lit(False))
    edge = F.lag("seq").over(order).isNull() | F.lead("seq").over(order).isNull()
    return paragraphs.withColumn("gone", ~F.col("visible") & ~edge & (near | far))


def page_breaks(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """blocks whose type ``break`` becomes ``blank_page`` where nothing, or another break, stands before it; empty paragraphs do not count."""
    order = W.partitionBy(*keys).orderBy("seq")
    counted = F.when(~((F.col("type") == "paragraph") & (X.trimmed(F.coalesce("text", F.lit(""))) == "")), F.col("type"))
    before = F.last(counted, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("type", F.when((F.col("type") == "break") & (before.isNull() | (before == "break")), F.lit("blank_page")).otherwise(F.col("type")))


def chapters(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """blocks with ``chapter_no`` from 1 and ``chapter_title``: a chapter begins at each level-1 heading; what precedes the first is front matter where
    more follows, and goes if it is blank."""
    order = W.partitionBy(*keys).orderBy("seq")
    whole = W.partitionBy(*keys)
    df = blocks.withColumn("raw", F.sum(F.when(F.col("is_h1"), 1).otherwise(0)).over(order)).withColumn("n_h1", F.count_if("is_h1").over(whole))
    filled = F.max(F.length(X.trimmed(F.coalesce("text", F.lit("")))) > 0).over(W.partitionBy(*keys, "raw"))
    df = df.withColumn("filled", filled).where((F.col("raw") > 0) | F.col("filled") | (F.col("n_h1") == 0))
    front = F.min("raw").over(whole) == 0
    title = F.when((F.col("raw") == 0) & (F.col("n_h1") > 0), F.lit("Front matter")).otherwise(F.max(F.when(F.col("is_h1"), X.compact(F.col("text")))).over(W.partitionBy(*keys, "raw")))
    return df.withColumn("chapter_no", (F.col("raw") + F.when(front, 1).otherwise(0)).cast("int")).withColumn("chapter_title", title).drop("raw", "n_h1", "filled")


#: Chapters of a spine; more become one.
MOST_CHAPTERS = 12


def spine(chaptered: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, chapter_no, title, n_blocks) of chapters that hold something; documents of more than MOST_CHAPTERS are one chapter."""
    filled = F.max((F.length(X.trimmed(F.coalesce("text", F.lit("")))) > 0) | F.coalesce(F.col("has_object"), F.lit(False)))
    each = chaptered.groupBy(*keys, "chapter_no").agg(F.max("chapter_title").alias("title"), F.count("*").alias("n_blocks"), filled.alias("filled")).where("filled")
    each = each.withColumn("n", F.count("*").over(W.partitionBy(*keys))).withColumn("chapter_no", F.when(F.col("n") > MOST_CHAPTERS, 1).otherwise(F.row_number().over(W.partitionBy(*keys).orderBy("chapter_no"))))
    return each.groupBy(*keys, "chapter_no").agg(F.min("title").alias("title"), F.sum("n_blocks").alias("n_blocks"))


def split_tables(rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_id")) -> DataFrame:
    """rows with ``part``: a body row with ``break_before`` begins another table, header rows stand in every part; a break before the first body row does
    not split."""
    order = W.partitionBy(*keys).orderBy("row_no")
    body = rows.where(~F.col("is_header"))
    part = F.sum(F.when(F.col("break_before") & (F.row_number().over(order) > 1), 1).otherwise(0)).over(order)
    body = body.withColumn("part", part.cast("int"))
    heads = rows.where("is_header").join(body.select(*keys, "part").distinct(), list(keys))
    return body.unionByName(heads)


def wrapped_inline(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, is_block, text): runs of root nodes that are no blocks become one paragraph at the place of the first; blank runs go."""
    order = W.partitionBy(*keys).orderBy("seq")
    fresh = F.when(F.col("is_block") | F.coalesce(F.lag("is_block").over(order), F.lit(True)), 1).otherwise(0)
    runs = nodes.withColumn("run", F.sum(fresh).over(order))
    out = runs.groupBy(*keys, "run").agg(F.min("seq").alias("seq"), F.max("is_block").alias("is_block"), F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("o"))
    out = out.select(*keys, "seq", "is_block", F.array_join(F.transform("o", lambda x: x["text"]), "").alias("text"))
    return out.where(F.col("is_block") | (X.trimmed("text") != ""))


def planned(blocks: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ("doc_id",), look_back: int = 2, least_prefix: int = 13) -> DataFrame:
    """(keys, seq, plan_seq): an ordered merge of blocks with a plan, by text key. A block takes the first exact key at or after the cursor; else, from
    ``look_back`` before it, one that is exact or shares a beginning of 40 characters, ``least_prefix`` at least. What is taken is used up and moves
    the cursor on. One group is one document."""
    def merge(rows: list[dict], entries: list[dict]) -> Iterator[tuple]:
        index, cursor = _Entries([e["text_key"] or "" for e in entries], least_prefix), 0
        for row in rows:
            key = row["text_key"]
            hit = index.exact(key, cursor) if key else None
            if hit is None and key:
                hit = index.alike(key, max(0, cursor - look_back))
            if hit is not None:
                index.taken[hit], cursor = True, hit + 1
                yield row["seq"], entries[hit]["plan_seq"]

    return met(blocks.select(*keys, F.col("seq").cast("long").alias("seq"), "text_key"), plan.select(*keys, F.col("plan_seq").cast("long").alias("plan_seq"), "text_key"), keys, merge, "seq bigint, plan_seq bigint")


class _Entries:
    """Keys of a plan, by what they are and by what they begin with; a search looks at places, not at entries."""

    def __init__(self, names: list[str], least: int) -> None:
        self.names, self.least, self.taken = names, least, [False] * len(names)
        self.begun: dict[int, dict[str, list[int]]] = {}
        self.whole = self._by(names)
        self.short = self._by([n[:PREFIX] for n in names])
        self.lengths = sorted({len(n) for n in self.short if len(n) >= least})

    def _by(self, names: list[str]) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for i, n in enumerate(names):
            out.setdefault(n, []).append(i)
        return out

    def _next(self, places: list[int] | None, start: int) -> int | None:
        at = bisect_left(places or [], start)
        while places and at < len(places):
            if not self.taken[places[at]]:
                return places[at]
            del places[at]  # taken for good, so no search passes it again
        return None

    def exact(self, key: str, start: int) -> int | None:
        return self._next(self.whole.get(key), start)

    def alike(self, key: str, start: int) -> int | None:
        """The first entry from ``start`` on that is the key, begins with its first PREFIX characters, or whose own the key begins with."""
        mine = key[:PREFIX]
        found = [self.exact(key, start)]
        if len(mine) >= self.least:
            if len(mine) not in self.begun:
                self.begun[len(mine)] = self._by([n[: len(mine)] for n in self.names])
            found.append(self._next(self.begun[len(mine)].get(mine), start))
        found += [self._next(self.short.get(key[:n]), start) for n in self.lengths if n <= len(key)]
        return min((i for i in found if i is not None), default=None)


def spaced(blocks: DataFrame, spacing: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, lines): an ordered merge of blocks with writing spaces; where a key repeats in the document, the key of the following block must match too."""
    def merge(rows: list[dict], plan: list[dict]) -> Iterator[tuple]:
        counts = Counter(row["text_key"] for row in rows)
        places: dict[Any, list[int]] = {}
        for j, p in enumerate(plan):
            places.setdefault(p["after_key"], []).append(j)
            places.setdefault((p["after_key"], p["next_key"]), []).append(j)
        cursor = 0
        for row, after in zip(rows, [*rows[1:], None]):
            key = row["text_key"]
            own = places.get(key if counts[key] == 1 else (key, after and after["text_key"]), [])
            at = bisect_left(own, cursor)
            if at < len(own):
                yield row["seq"], plan[own[at]]["lines"]
                cursor = own[at] + 1

    spaces = spacing.select(*keys, F.col("after_seq").cast("long").alias("after_seq"), "after_key", "next_key", F.col("lines").cast("int").alias("lines"))
    return met(blocks.select(*keys, F.col("seq").cast("long").alias("seq"), "text_key"), spaces, keys, merge, "seq bigint, lines int")


def split_runs(runs: DataFrame, keys: tuple[str, ...] = ("doc_id", "p_seq")) -> DataFrame:
    """(keys, r_seq, part_no, text, complex, is_break): runs apart at breaks (line feeds) and where the kind of script changes; traits stay with the run."""
    pieces = F.filter(F.split(F.regexp_replace("text", "\n", "\x00\n\x00"), "\x00"), lambda t: t != "")
    one = F.transform(pieces, lambda t: F.when(t == "\n", F.array(F.struct(t.alias("text"), F.lit(False).alias("complex"), F.lit(True).alias("is_break")))).otherwise(F.transform(X.script_segments(t), lambda s: F.struct(s["text"].alias("text"), s["complex"].alias("complex"), F.lit(False).alias("is_break")))))
    return runs.select(*keys, "r_seq", F.posexplode(F.flatten(one)).alias("part_no", "p")).select(*keys, "r_seq", "part_no", "p.*")


def run_breaks(runs: DataFrame, keys: tuple[str, ...] = ("doc_id", "p_seq")) -> DataFrame:
    """(keys, visible, only_breaks, starts_with_break, ends_with_break) of paragraphs from runs (r_seq, text, drawings, page_break)."""
    text = X.trimmed(F.coalesce("text", F.lit(""))) != ""
    shown = text | (F.coalesce("drawings", F.lit(0)) > 0)
    counted = F.when(shown | F.col("page_break"), F.col("page_break") & ~shown)
    a = runs.withColumn("shown", shown).withColumn("counted", counted)
    return a.groupBy(*keys).agg(
        F.max("shown").alias("visible"), (F.max("page_break") & ~F.max("shown")).alias("only_breaks"), F.coalesce(F.min_by("counted", F.when(F.col("counted").isNotNull(), F.col("r_seq"))), F.lit(False)).alias("starts_with_break"),
        F.coalesce(F.max_by("counted", F.when(F.col("counted").isNotNull(), F.col("r_seq"))), F.lit(False)).alias("ends_with_break"),
    )


def normalized_lists(blocks: DataFrame, plan: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, text, format, level, run, parent_seq, list_no) of list items among blocks (seq, text): those that a plan entry (plan_seq, text_key, format, level) matches in order, and
    those that begin with a marker, which goes."""
    keyed = blocks.withColumn("text_key", X.match_key(F.col("text")))
    hits = planned(keyed, plan, keys).join(plan.select(*keys, "plan_seq", F.col("format").alias("p_format"), F.col("level").alias("p_level")), [*keys, "plan_seq"])
    m = X.list_marker(F.col("text"))
    both = keyed.join(hits.select(*keys, "seq", "p_format", "p_level"), [*keys, "seq"], "left").withColumn("m", m)
    both = both.select(
        *keys, "seq", F.coalesce(F.when(F.col("p_format").isNull(), F.col("m.body")), "text").alias("text"), F.coalesce("p_format", "m.format").alias("format"), F.coalesce(F.col("p_level").cast("int"), "m.level", F.lit(0)).alias("level"),
        (F.col("p_format").isNotNull() | F.col("m").isNotNull()).alias("is_list"),
    )
    return nested(both, keys).drop("is_list")


def flattened_lists(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, text, format, level) of list items, from nodes (node_id, path down to itself, seq, tag, own text).

    An item that holds nothing but one list is a wrapper: it goes, and the items of that list belong to the list around it. So the level of an item is the number of lists around it that no wrapper
    holds, less one, and its format that of the nearest of these. Items outside lists are of level 0. Lists of one kind side by side need no merge here: ``nested`` numbers items by level and format.
    """
    listed = F.col("tag").isin("ul", "ol")
    inner = nodes.withColumn("parent", F.try_element_at("path", F.lit(-2)))
    kids = inner.where("parent is not null").groupBy(*keys, F.col("parent").alias("node_id")).agg(F.count("*").alias("children"), F.count_if(listed).alias("lists"))
    wraps = (F.col("tag") == "li") & (X.trimmed(F.coalesce("text", F.lit(""))) == "") & (F.col("children") == 1) & (F.col("lists") == 1)
    marked = inner.join(kids, [*keys, "node_id"], "left").withColumn("wrapper", F.coalesce(wraps, F.lit(False)))
    counted = marked.where(listed).select(*keys, F.col("node_id").alias("at"), "parent", F.col("tag").alias("kind"))
    counted = counted.join(marked.where("wrapper").select(*keys, F.col("node_id").alias("parent")), [*keys, "parent"], "left_anti")  # lists that no wrapper holds
    items = marked.where("tag = 'li' and not wrapper")
    above = items.select(*keys, "node_id", F.posexplode("path").alias("depth", "at")).join(counted.drop("parent"), [*keys, "at"])
    around = above.groupBy(*keys, "node_id").agg(F.count("*").alias("n"), F.max_by("kind", "depth").alias("kind"))
    out = items.join(around, [*keys, "node_id"], "left")
    return out.select(*keys, "seq", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("kind") == "ol", F.lit("decimal")).otherwise(F.lit("bullet")).alias("format"), F.greatest(F.coalesce(F.col("n"), F.lit(1)) - 1, F.lit(0)).cast("int").alias("level"))


def entries(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, seq, type, key) of what a comparison looks at, from nodes (node_id, path, seq, tag, text): spaces and breaks, the outermost figures and tables, images outside those, and text
    blocks without a block inside that hold something."""
    big, blocks = ("figure", "table"), ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "td", "th", "figcaption")
    above = nodes.select(*keys, "node_id", F.explode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("at")).join(nodes.select(*keys, F.col("node_id").alias("at"), F.col("tag").alias("above")), [*keys, "at"])
    inside = above.where(F.col("above").isin(*big)).select(*keys, "node_id").distinct().withColumn("inside", F.lit(True))
    holds = above.join(nodes.where(F.col("tag").isin(*blocks)).select(*keys, "node_id"), [*keys, "node_id"], "left_semi").where(F.col("above").isin(*blocks)).select(*keys, F.col("at").alias("node_id")).distinct().withColumn("holds", F.lit(True))
    tag = F.col("tag")
    kind = F.when(tag == "hr", F.lit("break")).when(tag == "space", F.lit("space")).when(F.col("inside"), F.lit(None)).when(tag == "table", F.lit("table")).when(tag.isin("figure", "img"), F.lit("image")).when(tag.isin(*blocks) & F.col("holds").isNull() & (X.trimmed(F.coalesce("text", F.lit(""))) != ""), F.lit("text"))
    out = nodes.join(inside, [*keys, "node_id"], "left").join(holds, [*keys, "node_id"], "left").withColumn("type", kind).where("type is not null")
    return out.select(*keys, "seq", "type", F.concat_ws(":", "type", X.match_key(F.coalesce("text", F.lit("")))).alias("key"))
