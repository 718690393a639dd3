"""Near-duplicates by min-max hashing.

1. One scan makes a row of fixed size for each document: its number of distinct shingles, a 128-bit digest of the set, and bands of
   a signature that keeps both the minimum and the maximum under every permutation, so that n values cost n / 2 hash evaluations.
2. Documents with equal sets are one vertex (an aggregate by digest, combined before the shuffle).
3. Vertices that share a band are candidates. The members of each bucket meet with their sizes and a byte of every signature value, and of these pairs only those go on that
   could be linked by size and agree in so many values that a link fails it with chance ``MISS``. Buckets with the same members meet once.
4. The connected components of what goes on are clusters that no link can leave. The sets of each cluster meet once and every link is confirmed on full sets.
5. A bucket or cluster of more than ``BLOCK`` vertices is dealt out as pairs of blocks, each a task of bounded size. A task gives a spanning forest, or the least id that each vertex
   reaches, never the pairs.

The chance that a pair exactly at the threshold is missed is under two in a million; links are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, partitions, saved, text_bytes
from .components import components
from .words import LOWERED, Words, chunks, mix

MISS = 1e-6
MOST_VALUES = 192
#: Vertices, and shingles, of a block of a large cluster.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20


def banding(threshold: float, miss: float = MISS, most: int = MOST_VALUES) -> tuple[int, int]:
    """(bands, values in each): as selective as ``most`` values allow while a pair at the threshold is missed with chance ``miss``."""
    best = (math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999))), 1)
    for rows in range(2, 13):
        bands = math.ceil(math.log(miss) / math.log(1 - min(threshold, 0.999) ** rows))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def agreement(threshold: float, values: int, miss: float = MISS) -> int:
    """Of ``values`` signature values how many a pair at the threshold agrees in at least, but with chance ``miss``. The two ends of a permutation are taken to agree or not
    together, which spreads the number most."""
    n, total, k = values // 2, 0.0, 0
    while True:
        total += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)
        if total > miss:
            return 2 * k
        k += 1


class Signatures:
    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.n = -(-bands * rows // 2)
        self.xor, self.by, self.by2 = (rng.integers(0, 1 << 32, self.n, dtype=np.uint32) for _ in range(3))
        self.by |= np.uint32(1)
        self.by2 |= np.uint32(1)
        self.weights = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of non-empty sets of 64-bit shingles the bands, as signed numbers that differ from band to band, and a byte of each value."""
        at = np.zeros(len(sets), np.int64)
        np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
        short = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        values = np.empty((2 * self.n, len(sets)), np.uint64)
        for p in range(self.n):
            h = (short ^ self.xor[p]) * self.by[p]
            h ^= h >> np.uint32(15)
            h *= self.by2[p]
            values[p], values[self.n + p] = np.minimum.reduceat(h, at), np.maximum.reduceat(h, at)
        values = mix(values[: self.bands * self.rows].reshape(self.bands, self.rows, -1))
        keys = (values * self.weights[:, :, None]).sum(1, dtype=np.uint64)
        return mix(keys + np.arange(1, self.bands + 1, dtype=np.uint64)[:, None]).T.view(np.int64), values.reshape(self.bands * self.rows, -1).astype(np.uint8).T


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` lowered words (all words, if fewer; none without words)."""
    for _, part in chunks(texts):
        w = Words(part, LOWERED)
        h, _ = w.windows(size)
        for d in range(len(part)):
            a, z = int(w.first[d]), int(w.first[d + 1])
            if z - a >= size:
                yield np.unique(h[a : z - size + 1])
            elif z > a:
                whole = np.zeros(1, np.uint64)
                for x in w.hashes[a:z]:
                    whole = mix(whole * np.uint64(3) + x)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def digest(s: np.ndarray) -> tuple[int, int]:
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def forest(sizes: np.ndarray, sides: np.ndarray, percent: int, test: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest over the pairs that pass ``test`` (of one and several others), among sets of ascending ``sizes`` that differ by no more than a link allows. With two sides, of pairs
    across them. Pairs that are connected already are not looked at."""
    root, out, two = np.arange(len(sizes)), [], len(set(sides.tolist())) > 1
    for i in range(len(sizes) - 1):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        other = np.arange(i + 1, end)
        other = other[root[other] != root[i]]
        if two:
            other = other[sides[other] != sides[i]]
        for j in other[test(i, other)] if len(other) else ():
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def linked(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: 100 * |a & b| >= percent * |a | b|. With two sides, of the links across them.

    Exact: a set that can link shares at least ``percent`` of its shingles with some other, and sizes differ by that at most.
    """
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    shared = np.add.reduceat((df > 1)[ids].astype(np.int64), at[:-1])
    live = np.flatnonzero(100 * shared >= percent * n)
    live = live[np.argsort(n[live], kind="stable")]
    where = [ids[at[i] : at[i + 1]] for i in live]
    sizes = n[live]
    flag = np.zeros(len(df), np.int8)

    def test(i: int, other: np.ndarray) -> np.ndarray:
        flag[where[i]] = 1
        begin = np.zeros(len(other), np.int64)
        np.cumsum(sizes[other][:-1], out=begin[1:])
        both = np.add.reduceat(flag[np.concatenate([where[j] for j in other])].astype(np.int64), begin)
        flag[where[i]] = 0
        return 100 * both >= percent * (sizes[other] + sizes[i] - both)

    return [(int(live[i]), int(live[j])) for i, j in forest(sizes, np.array(side)[live], percent, test)]


def alike(n: list[int], sketches: list[bytes], side: list[int], percent: int, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in ``least`` bytes of their sketches."""
    order = np.argsort(n, kind="stable")
    s = np.frombuffer(b"".join(sketches[i] for i in order), np.uint8).reshape(len(n), -1)
    found = forest(np.array(n)[order], np.array(side)[order], percent, lambda i, other: (s[other] == s[i]).sum(1) >= least)
    return [(int(order[i]), int(order[j])) for i, j in found]


def dealt(df: DataFrame, *carry: str) -> DataFrame:
    """df (cluster, blocks, block, carry) with a row for each pair of blocks, as lo and hi, of its cluster that holds it; ``whole``: a cluster of one block. The rows of a pair follow one another."""
    out = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    out = out.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), (F.col("blocks") == 1).alias("whole"), "block", *carry)
    return out.repartition(partitions(df.sparkSession), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")


def classes(docs: DataFrame, *, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id that links reach), kept (doc_id = component_id).

    Nulls: a null or wordless text has an empty set and links with nothing; a null id links with nothing, and its row has a null
    component_id and is kept. Very long texts are read whole; a task holds a block of sets, or one larger set with another. Ties cannot arise: ids are ordered. Repeated rows fall into one class and are all kept or none; an id with several texts is one vertex
    wherever it stands for their sets, so its links tie those classes. Empty table: no rows. Other columns are not carried, so clashing names cannot disturb.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    bands, rows = banding(percent / 100)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        signatures = Signatures(bands, rows)
        for b in batches:
            texts = text_bytes(b.column("text"))
            out: dict = {"id": b.column("id"), "n": [], "d1": [], "d2": [], "bands": [], "sketch": []}
            for _, part in chunks(texts):
                sets = list(shingle_sets(part, size))
                full = [s for s in sets if len(s)]
                keys, sketches = signatures.of(full) if full else (np.zeros((0, bands)), ())
                signed = zip(keys.tolist(), sketches, strict=True)
                for s in sets:
                    one, two = digest(s)
                    out["n"].append(len(s))
                    out["d1"].append(one)
                    out["d2"].append(two)
                    own, sketch = next(signed) if len(s) else (None, None)
                    out["bands"].append(own)
                    out["sketch"].append(None if sketch is None else sketch.tobytes())
            yield out

    rows_of = saved(map_batches(read, sign, "n long, d1 long, d2 long, bands array<long>, sketch binary", ("id",)))
    sets = rows_of.where("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "bands", "sketch")).alias("x"))
    sets = saved(sets.select("d1", "d2", "n", F.col("x.id").alias("rep"), F.col("x.bands").alias("bands"), F.col("x.sketch").alias("sketch")))

    buckets = sets.select("rep", F.explode("bands").alias("bucket"))
    held = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("members > 1")
    held = held.groupBy("leader", "last", "members", "who").agg(F.min("bucket").alias("bucket"))  # of buckets with the same members, one
    held = saved(held.select(F.col("bucket").alias("cluster"), F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")))
    member = buckets.join(held, buckets["bucket"] == held["cluster"]).select("cluster", "blocks", "rep").join(sets.select("rep", "n", "sketch"), "rep")
    least = agreement(percent / 100, bands * rows)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in _groups(batches, "rep", "n", "sketch"):
            out: dict[str, list] = {"rep": [], "leader": []}
            for _, group in b:
                edges = alike([g[2] for g in group], [g[3] for g in group], [g[0] for g in group], percent, least)
                inside = sorted({i for e in edges for i in e})
                place = {i: k for k, i in enumerate(inside)}
                ids = [group[i][1] for i in inside]
                out["rep"] += ids
                out["leader"] += leasts(ids, [(place[i], place[j]) for i, j in edges])
            yield out

    id_type = docs.schema[id_col].dataType.simpleString().replace("bigint", "long")
    near = map_batches(dealt(member.withColumn("block", _block("rep")), "rep", "n", "sketch"), compare, f"rep {id_type}, leader {id_type}")
    # a vertex ties the leaders of its buckets together, so that only leaders need components
    led = saved(near.groupBy("rep").agg(F.collect_set("leader").alias("leaders")).select("rep", F.array_min("leaders").alias("least"), "leaders"))  # one at most for each task that saw the vertex
    tied = components(led.where("size(leaders) > 1").select("least", F.explode("leaders").alias("other")), "least", "other")
    cluster = led.join(tied, led["least"] == tied["v"], "left").select(F.col("rep").alias("v"), F.coalesce("label", "least").alias("label"))

    vertices = sets.drop("bands", "sketch").join(cluster.withColumnsRenamed({"v": "rep", "label": "cluster"}), "rep")
    large = vertices.groupBy("cluster").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    large = large.select("cluster", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    vertices = vertices.join(large, "cluster").withColumn("block", _block("rep"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            keep, shingles = [], []
            for i, (s, *said) in enumerate(zip(shingle_sets(text_bytes(b.column("text")), size), b.column("d1").to_pylist(), b.column("d2").to_pylist(), strict=True)):
                if digest(s) == tuple(said):
                    keep.append(i)
                    shingles.append(s.tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            yield {c: part.column(c) for c in ("cluster", "blocks", "block", "rep")} | {"shingles": shingles}

    full = map_batches(read.join(vertices, read["id"] == vertices["rep"]).select("text", "d1", "d2", "cluster", "blocks", "block", "rep"), gather, "shingles binary", ("cluster", "blocks", "block", "rep"))
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in _groups(batches, "rep", "shingles"):
            out: dict[str, list] = {"v": [], "label": [], "whole": []}
            for whole, members in b:
                found = list(dict.fromkeys(members))  # a repeated row once
                if len(found) > 1:
                    ids = [rep for _, rep, _ in found]
                    reached = leasts(ids, linked([np.frombuffer(s, np.uint64) for _, _, s in found], [block for block, _, _ in found], percent))
                    tied = [i for i in range(len(ids)) if ids[i] != reached[i]]
                    for k, said in (("v", [ids[i] for i in tied]), ("label", [reached[i] for i in tied]), ("whole", [whole] * len(tied))):
                        out[k] += said
            yield out

    links = saved(map_batches(dealt(full, "rep", "shingles"), confirm, f"v {id_type}, label {id_type}, whole boolean"))
    # a cluster of one block is done; the tasks of others each saw two blocks
    found = links.where("whole").select("v", "label").unionByName(components(links.where("not whole"), "v", "label"))
    found = found.groupBy("v").agg(F.min("label").alias("component")).withColumnRenamed("v", "rep")
    # dealt out by rep, so that both sides of the last join are dealt out anew and Spark can split a digest that very many rows have
    named = sets.select("rep", "d1", "d2", "n").join(found, "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = rows_of.drop("bands").join(named, ["d1", "d2", "n"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _block(rep: str) -> Column:
    return F.pmod(F.xxhash64(rep), F.col("blocks")).cast("int")


def _groups(batches: Iterator[pa.RecordBatch], *carry: str) -> Iterator[list[tuple[bool, list[tuple]]]]:
    """For each batch the runs of equal (cluster, lo, hi) that end in it: whether it is a whole cluster, and its (block, carry)."""
    key, members = None, []
    for b in batches:
        done = []
        columns = [b.column(c).to_pylist() for c in ("cluster", "lo", "hi", "whole", "block", *carry)]
        for cluster, lo, hi, whole, *row in zip(*columns, strict=True):
            if key != (cluster, lo, hi, whole):
                if members:
                    done.append((key[-1], members))
                key, members = (cluster, lo, hi, whole), []
            members.append(tuple(row))
        yield done
    if members:
        yield [(key[-1], members)]


def leasts(ids: list, links: list[tuple[int, int]]) -> list:
    """The least id that each can reach over links."""
    root = list(range(len(ids)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in links:
        i, j = top(i), top(j)
        if i != j:
            i, j = (i, j) if ids[i] <= ids[j] else (j, i)
            root[j] = i
    return [ids[top(i)] for i in range(len(ids))]


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", **options: int | str) -> DataFrame:
    """docs with one document of each class: the one with the least id. Columns stay as they are. Nulls, very long texts, repeated rows and ties: as for ``classes``; rows with the
    least id all stay. Empty table: no rows."""
    gone = classes(docs, id_col=id_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS said FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM s x JOIN s y ON x.said = y.said AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * n_both >= 85 * (na.n + nb.n - n_both)),
reach AS (SELECT doc_id AS v, doc_id AS w FROM d UNION SELECT v, b FROM reach JOIN links ON w = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(w) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""
