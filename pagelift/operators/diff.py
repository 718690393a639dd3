"""Comparison of two revisions: word and block diffs, moves, counters, context."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import reachable
from .grouped import met

#: Cells of a comparison; beyond, everything goes and everything comes.
MOST_CELLS = 250_000
OPS = "array<struct<type:string,text:string>>"


def sequence_diff(a: list[str], b: list[str], most_cells: int = MOST_CELLS) -> list[tuple[str, str]]:
    """(same, del or add; token) by a longest common subsequence; where both ways are as long, what goes comes first."""
    if len(a) * len(b) > most_cells:
        return [("del", x) for x in a] + [("add", x) for x in b]
    # Bits of a whole number stand for the last tokens of b, the last lowest; rows[i] has a nought where a[i:] gains by one more of them, so that the noughts
    # among its lowest k bits count the longest common subsequence of a[i:] and the last k of b.
    n, m = len(a), len(b)
    where: dict[str, int] = {}
    for j, t in enumerate(b):
        where[t] = where.get(t, 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1
    row = full
    rows = [row] * (n + 1)
    for i in range(n - 1, -1, -1):
        hit = row & where.get(a[i], 0)
        row = (row + hit | row - hit) & full
        rows[i] = row
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("same", a[i]))
            i, j = i + 1, j + 1
            continue
        skip_a = (m - j) - (rows[i + 1] & full >> j).bit_count()
        skip_b = (m - j - 1) - (rows[i] & full >> j + 1).bit_count()
        if skip_a >= skip_b:
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("add", b[j]))
            j += 1
    return out + [("del", t) for t in a[i:]] + [("add", t) for t in b[j:]]


def word_diff(pairs: DataFrame, keys: tuple[str, ...], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, ops) for each pair of texts; a null text is empty. One pass, one pair in memory at a time."""
    fields = [pairs.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", ops {OPS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
        for b in batches:
            ops = [[{"type": t, "text": w} for t, w in sequence_diff(x or [], y or [])] for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(ops, kind)], names=[*keys, "ops"])

    reachable(pairs.sparkSession)
    return pairs.select(*keys, X.diff_tokens(F.col(before)).alias("x"), X.diff_tokens(F.col(after)).alias("y")).mapInArrow(run, schema)


def with_context(ops: DataFrame, keys: tuple[str, ...], span: int = 2) -> DataFrame:
    """(keys, seq, type, text): changes and what stands within ``span`` of one; each other run is one ellipsis."""
    order = W.partitionBy(*keys).orderBy("seq")
    near = F.max(F.col("type") != "same").over(order.rowsBetween(-span, span))
    df = ops.withColumn("near", near)
    fresh = F.when(F.col("near") | F.coalesce(F.lag("near").over(order), F.lit(True)), 1).otherwise(0)
    df = df.withColumn("run", F.sum(fresh).over(order))
    out = df.groupBy(*keys, "run").agg(F.min("seq").alias("seq"), F.max("near").alias("near"), F.min_by("type", "seq").alias("type"), F.min_by("text", "seq").alias("text"))
    return out.select(*keys, "seq", F.when(F.col("near"), F.col("type")).otherwise(F.lit("ellipsis")).alias("type"), F.when(F.col("near"), F.col("text")).otherwise(F.lit("…")).alias("text"))


def counters(ops: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, added, removed, heading_changes): words, and headings whose level went and came, a pair side by side once."""
    order = W.partitionBy(*keys).orderBy("seq")
    heading = X.is_heading_token(F.col("text"))
    df = ops.withColumn("heading", heading & (F.col("type") != "same"))
    pair = F.col("heading") & F.coalesce(F.lag("heading").over(order), F.lit(False)) & (F.col("type") == "add") & F.coalesce(F.lag("type").over(order) == "del", F.lit(False))
    df = df.withColumn("pair", pair)
    return df.groupBy(*keys).agg(
        F.count_if((F.col("type") == "add") & ~heading).alias("added"), F.count_if((F.col("type") == "del") & ~heading).alias("removed"),
        F.greatest(F.lit(0).cast("long"), F.count_if("heading") - F.count_if("pair")).alias("heading_changes"),
    )


def pages_side_by_side(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """A full outer join of two revisions' pages with ``status``: both, removed or added. The other columns get ``before_`` and ``after_``."""
    left = before.select(*keys, *[F.col(c).alias(f"before_{c}") for c in before.columns if c not in keys], F.lit(True).alias("in_before"))
    right = after.select(*keys, *[F.col(c).alias(f"after_{c}") for c in after.columns if c not in keys], F.lit(True).alias("in_after"))
    status = F.when(F.col("in_before") & F.col("in_after"), F.lit("both")).when(F.col("in_before"), F.lit("removed")).otherwise(F.lit("added"))
    return left.join(right, list(keys), "full_outer").withColumn("status", status).drop("in_before", "in_after")


def unique_in_both(before: DataFrame, after: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that stand exactly once on either side: what can have moved."""
    def once(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n = 1").select(*keys)

    return once(before).join(once(after), list(keys))


def block_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, change_no, kind, before_seq, after_seq, words): blocks that were moved, added, removed, replaced or formatted anew.

    Blocks have seq, key and signature. Their keys are compared as sequences. In a stretch of changes, a key that is unique on both sides is a move, and
    the other removed and added blocks are paired in order as replacements. One group is one document (or page, by ``keys``).
    """
    def compare(a: list[dict], b: list[dict]) -> Iterator[tuple]:
        ka, kb = [x["key"] for x in a], [x["key"] for x in b]
        once_a, once_b = Counter(ka), Counter(kb)
        place = {k: j for j, k in enumerate(kb)}
        single = {k for k in once_a if once_a[k] == 1 and once_b[k] == 1}
        rows: list[tuple] = []

        def close(gone: list[int], come: list[int]) -> None:
            rows.extend(("moved", a[i]["seq"], b[place[ka[i]]]["seq"], 0, 0) for i in gone if ka[i] in single)
            for i, j in zip_longest((i for i in gone if ka[i] not in single), (j for j in come if kb[j] not in single)):
                kind = "added" if i is None else "removed" if j is None else "replaced"
                ops = Counter(t for t, _ in sequence_diff(_words(ka, i), _words(kb, j)))
                rows.append((kind, None if i is None else a[i]["seq"], None if j is None else b[j]["seq"], ops["del"], ops["add"]))

        i = j = 0
        gone: list[int] = []
        come: list[int] = []
        for kind, _ in sequence_diff(ka, kb):
            if kind == "same":
                close(gone, come)
                gone, come = [], []
                if a[i]["signature"] != b[j]["signature"]:
                    rows.append(("formatted", a[i]["seq"], b[j]["seq"], 0, 0))
                i, j = i + 1, j + 1
            elif kind == "del":
                gone.append(i)
                i += 1
            else:
                come.append(j)
                j += 1
        close(gone, come)
        for n, row in enumerate(rows):
            yield n + 1, *row

    def blocks(df: DataFrame) -> DataFrame:
        return df.select(*keys, F.col("seq").cast("long").alias("seq"), F.coalesce("key", F.lit("")).alias("key"), "signature")

    return met(blocks(before), blocks(after), keys, compare, "change_no int, kind string, before_seq bigint, after_seq bigint, removed int, added int")


def _words(keys: list[str], i: int | None) -> list[str]:
    return [] if i is None else keys[i].split()


#: The parts of an entry's format, in the order in which their changes are told.
FORMAT = ("bold", "italic", "underline", "strike", "kind", "alignment", "placement", "size", "font", "width", "link")


def signature(*columns: Column | str) -> Column:
    """A digest of an entry's format; nulls count as themselves."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def described_changes(before: str, after: str, parts: tuple[str, ...] = FORMAT) -> Column:
    """What of two format structs differs, told in order: ``part: old to new``."""
    def told(p: str) -> Column:
        x, y = F.col(before)[p].cast("string"), F.col(after)[p].cast("string")
        return F.when(~x.eqNullSafe(y), F.concat(F.lit(f"{p}: "), F.coalesce(x, F.lit("none")), F.lit(" to "), F.coalesce(y, F.lit("none"))))

    return F.array_compact(F.array(*[told(p) for p in parts]))


def rendered(ops: Column) -> Column:
    """Ops as HTML: del and ins elements, words joined by spaces."""
    def one(o: Column) -> Column:
        text = X.escape_html(o["text"])
        return F.when(o["type"] == "del", F.concat(F.lit("<del>"), text, F.lit("</del>"))).when(o["type"] == "add", F.concat(F.lit("<ins>"), text, F.lit("</ins>"))).otherwise(text)

    return F.array_join(F.transform(ops, one), " ")


def accepted(ops: Column) -> Column:
    """The text after: everything but what went."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["type"] != "del"), lambda o: o["text"]), " ")
