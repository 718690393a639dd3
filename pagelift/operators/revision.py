"""Two revisions of formatted text laid over each other, and documents compared page by page.

Word changes know nothing of formats, and runs of one format know nothing of words. ``revised_runs`` lays the two over each other as intervals on the
texts of both revisions: borders of runs and of changes are events in order of position, and each event carries the last of the other kind forward. That is a
sort per paragraph, whatever the number of runs and changes in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..session import reachable
from .diff import sequence_diff
from .grouped import ruled

_WORD = re.compile(rf"[^{X.WS}]+")


def changed_stretches(before: str, after: str) -> Iterator[tuple[str, int | None, int | None, int]]:
    """(same, del or ins; start in before, start in after, length), in order and without gaps on either side. A word takes the white space before it along; where that differs, it changes by itself."""
    old, new = list(_WORD.finditer(before)), list(_WORD.finditer(after))
    i = j = at = to = 0
    last: list = []

    def put(kind: str, a: int | None, b: int | None, n: int) -> Iterator[tuple]:
        """Hands out the stretch before, unless this one goes on where it ends."""
        if n and last and last[0] == kind and (a is None or last[1] + last[3] == a) and (b is None or last[2] + last[3] == b):
            last[3] += n
        elif n:
            if last:
                yield tuple(last)
            last[:] = [kind, a, b, n]

    def gaps(x: int, y: int) -> Iterator[tuple]:
        """What stands before old position x and new position y; equal white space stays."""
        nonlocal at, to
        if before[at:x] == after[to:y]:
            yield from put("same", at, to, x - at)
        else:
            yield from put("del", at, None, x - at)
            yield from put("ins", None, to, y - to)
        at, to = x, y

    for kind, _ in sequence_diff([m[0] for m in old], [m[0] for m in new]):
        if kind == "same":
            yield from gaps(old[i].start(), new[j].start())
            yield from put("same", at, to, len(old[i][0]))
            at, to, i, j = old[i].end(), new[j].end(), i + 1, j + 1
        elif kind == "del":
            yield from put("del", at, None, old[i].end() - at)
            at, i = old[i].end(), i + 1
        else:
            yield from put("ins", None, to, new[j].end() - to)
            to, j = new[j].end(), j + 1
    yield from gaps(len(before), len(after))
    if last:
        yield tuple(last)


def _stretches(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, change_no, change, before_start, after_start, length) of each paragraph. One paragraph's two texts meet in a task at a time."""
    def side(df: DataFrame, old: bool) -> DataFrame:
        return df.select(*keys, F.lit(old).alias("old"), F.struct("run_no", F.coalesce("text", F.lit("")).alias("text")).alias("run"))

    def text(old: bool) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("old") == old, F.col("run")))), lambda r: r["text"]), "")

    both = side(before, True).unionByName(side(after, False)).groupBy(*keys).agg(text(True).alias("_before"), text(False).alias("_after"))
    schema = T.StructType([both.schema[k] for k in keys]).add("change_no", "integer").add("change", "string").add("before_start", "integer").add("after_start", "integer").add("length", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r, n, *s) for r, (x, y) in enumerate(zip(b.column("_before").to_pylist(), b.column("_after").to_pylist(), strict=True)) for n, s in enumerate(changed_stretches(x, y))]
            place, *columns = zip(*rows, strict=True) if rows else ([],) * 6
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(place, pa.int64())) for k in keys), *made], names=schema.names)

    reachable(both.sparkSession)
    return both.mapInArrow(run, schema)


def revised_runs(before: DataFrame, after: DataFrame, keys: tuple[str, ...], traits: tuple[str, ...]) -> DataFrame:
    """(keys, seq, change_no, change, text, format, was) of paragraphs in two revisions, each given as runs: run_no, text and traits.

    ``change`` is same, del or ins; rows are cut where a run of either revision ends. ``format`` (a struct of the traits) is that of the revision after for what stays and comes, of the one before for what goes;
    ``was`` is what stays in the revision before. In order, same and ins rows are the text after, same and del rows the text before. A paragraph that one side lacks comes or goes whole; null texts are empty, empty runs leave nothing; null keys are equal.
    """
    stretches = _stretches(before, after, keys)
    border = W.partitionBy(*keys)

    def runs(df: DataFrame) -> DataFrame:
        size = F.length(F.coalesce("text", F.lit("")))
        start = F.coalesce(F.sum(size).over(border.orderBy("run_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
        spans = df.withColumn("_start", start).where(size > 0)
        return spans.select(*keys, F.col("_start").alias("pos"), F.struct(F.col("_start").alias("start"), "text", F.struct(*traits).alias("format")).alias("run"))

    def cut(df: DataFrame, start: str, name: str) -> DataFrame:
        """Each stretch of one side at its runs' borders: from where in the stretch, and the run."""
        own = stretches.where(F.col(start).isNotNull()).select(*keys, F.col(start).alias("pos"), F.struct("change_no", F.col(start).alias("start"), "change", "length").alias("stretch"))
        events = runs(df).unionByName(own, allowMissingColumns=True).repartition(*keys).groupBy(*keys, "pos").agg(F.max("run").alias("run"), F.max("stretch").alias("stretch"))
        upto = border.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
        held = events.select(*keys, "pos", F.last("run", True).over(upto).alias("run"), F.last("stretch", True).over(upto).alias("s"))
        return held.select(*keys, F.col("s.change_no").alias("change_no"), (F.col("pos") - F.col("s.start")).alias("inside"), F.col("s.change").alias("change"), F.col("s.length").alias("length"), F.struct((F.col("pos") - F.col("run.start")).alias("skip"), "run.text", "run.format").alias(name))

    old, new = cut(before, "before_start", "old"), cut(after, "after_start", "new")
    both = old.unionByName(new, allowMissingColumns=True).repartition(*keys).groupBy(*keys, "change_no", "inside").agg(*(F.max(c).alias(c) for c in ("change", "length", "old", "new")))
    order = W.partitionBy(*keys).orderBy("change_no", "inside")
    within = W.partitionBy(*keys, "change_no").orderBy("inside")
    carried = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct(c, "inside")), True).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)).alias(c)
    parts = both.select(*keys, "change_no", "inside", "change", (F.coalesce(F.lead("inside").over(within), F.col("length")) - F.col("inside")).alias("n"), carried("old"), carried("new"), F.row_number().over(order).alias("seq"))
    shown = F.when(F.col("change") == "del", F.struct(F.col("old.old").alias("run"), F.col("old.inside").alias("at"))).otherwise(F.struct(F.col("new.new").alias("run"), F.col("new.inside").alias("at")))
    parts = parts.withColumn("shown", shown)
    text = F.substring("shown.run.text", F.col("shown.run.skip") + F.col("inside") - F.col("shown.at") + 1, F.col("n"))
    return parts.select(*keys, "seq", "change_no", "change", text.alias("text"), F.col("shown.run.format").alias("format"), F.when(F.col("change") == "same", F.col("old.old.format")).alias("was"))


def _page_rule(a: list[dict], b: list[dict]) -> Iterator[tuple]:
    """Changes between a page's blocks in two revisions, each block with seq, key, signature, and ``to``, the place of the one block after that it may have moved to; (kind, before_seq, after_seq, to_page, removed, added).

    A block that may have moved and is not in its place has moved there; the page that it is on after says nothing of it."""
    gone: list[int] = []
    come: list[int] = []

    def close() -> Iterator[tuple]:
        yield from (("moved", a[i]["seq"], a[i]["to"]["seq"], a[i]["to"]["page"], 0, 0) for i in gone if a[i]["to"])
        rest, new = [i for i in gone if not a[i]["to"]], [j for j in come if not b[j]["to"]]
        for n in range(max(len(rest), len(new))):
            i, j = rest[n] if n < len(rest) else None, new[n] if n < len(new) else None
            words = [op for op, _ in sequence_diff([] if i is None else a[i]["key"].split(), [] if j is None else b[j]["key"].split())]
            yield "added" if i is None else "removed" if j is None else "replaced", None if i is None else a[i]["seq"], None if j is None else b[j]["seq"], None, words.count("del"), words.count("add")
        gone.clear()
        come.clear()

    i = j = 0
    for op, _ in sequence_diff([x["key"] for x in a], [x["key"] for x in b]):
        if op == "same":
            yield from close()
            if a[i]["signature"] != b[j]["signature"]:
                yield "formatted", a[i]["seq"], b[j]["seq"], None, 0, 0
            i, j = i + 1, j + 1
        elif op == "del":
            gone.append(i)
            i += 1
        else:
            come.append(j)
            j += 1
    yield from close()


def document_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",), pages: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(keys, change_no, kind, before_page, before_seq, after_page, after_seq, removed, added): what differs between two revisions of documents whose blocks have page, seq, key and signature; seq is unique in a page.

    A key that stands once in either revision of the document is the same block wherever it stands: if it is not in its place, that is one ``moved`` row, within its page or across pages. Everything else is compared page by page, each pair of pages in a task of its own;
    a page that one side lacks comes or goes. ``pages``: both revisions' page, and layout (a struct); a page in both whose layout differs is a ``page`` row. ``removed`` and ``added`` count words.
    ``change_no`` runs through the document by page and place, in the revision after where there is one. Null keys of blocks are empty and, as empty ones, never move; documents without pages have one null page.
    """
    own = [*keys, "page", "seq", "key", "signature"]
    old, new = (df.withColumn("key", F.coalesce("key", F.lit(""))).withColumn("seq", F.col("seq").cast("long")).select(*own, F.lit(side).alias("_old")) for df, side in ((before, True), (after, False)))
    sides = old.unionByName(new).repartition(*keys)  # a document's rows lie together from here on, so neither uniqueness nor pages move them again
    alike = W.partitionBy(*keys, "key")
    to = F.max(F.when(~F.col("_old"), F.struct(F.col("page").cast("string").alias("page"), "seq"))).over(alike)
    single = (F.col("key") != "") & (F.count_if("_old").over(alike) == 1) & (F.count("*").over(alike) == 2)
    block = F.struct("seq", "key", "signature", F.when(single, to).alias("to"))
    rows = lambda side: F.array_sort(F.collect_list(F.when(F.col("_old") == side, F.col("block"))))
    both = sides.withColumn("block", block).groupBy(*keys, "page").agg(rows(True).alias("left_rows"), rows(False).alias("right_rows"))
    found = ruled(both, (*keys, "page"), _page_rule, "kind string, before_seq bigint, after_seq bigint, to_page string, removed int, added int")
    moved = F.col("kind") == "moved"
    pages_of = {"before_page": F.when(F.col("before_seq").isNotNull(), F.col("page")), "after_page": F.when(moved, F.col("to_page").cast(both.schema["page"].dataType)).when(F.col("after_seq").isNotNull(), F.col("page"))}
    rows = found.withColumns(pages_of).select(*keys, "kind", "before_page", "before_seq", "after_page", "after_seq", "removed", "added")
    if pages is not None:
        same = " and ".join(f"l.{k} <=> r.{k}" for k in (*keys, "page"))
        laid = pages[0].alias("l").join(pages[1].alias("r"), F.expr(f"{same} and not (l.layout <=> r.layout)")).select(*(F.col(f"l.{k}").alias(k) for k in keys), F.lit("page").alias("kind"), F.col("l.page").alias("before_page"), F.col("r.page").alias("after_page"), F.lit(0).alias("removed"), F.lit(0).alias("added"))
        rows = rows.unionByName(laid, allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(F.coalesce("after_page", "before_page"), F.coalesce("after_seq", "before_seq"), "kind", "before_page", "before_seq")
    return rows.select(*keys, F.row_number().over(order).alias("change_no"), "kind", "before_page", "before_seq", "after_page", "after_seq", "removed", "added")
