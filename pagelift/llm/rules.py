"""Quality rules: statistics of each whole text, base rules on them, and an isolation forest over all of them.

Every tree of the forest grows from all rows, a level at a time: tasks give each node's number of rows and the least and greatest figures in it, Spark merges
them, and the node is split at random between them. A text's anomaly is the mean length of its paths over the trees. The threshold is calibrated on all
labelled rows: the best balance of bad rows caught and good ones lost, from sums that run over their sorted anomalies.
The figures are computed once and saved; the driver gets the nodes of one level at a time, and one row of sums for each partition of the anomalies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import map_batches, partitions, saved, text_bytes
from .words import AS_IS, ASCII_SPACE, Words, chunks

#: Trees, their depth, and the rows that a forest's trees draw in this process.
TREES, DEPTH, TREE_ROWS = 200, 8, 256
#: Rows that go down a tree at once, and partitions of figures (small beside their texts) that a task takes.
BLOCK, TOGETHER = 8_192, 4
_SYMBOLS = b"#*$%&|<>"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NAMES = ("log words", "word length", "symbols", "repeated lines", "repeated words", "different words", "capitals", "digits", "exclamations", "punctuation", "words as the one before", "different bytes")


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_FIRST = np.array([not 0x80 <= b < 0xC0 for b in range(256)])
_CHAR_IN_WORD = _FIRST & ~_mask(ASCII_SPACE)
_COUNTED = {"symbols": _mask(_SYMBOLS), "capitals": _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _mask(b"0123456789"), "exclamations": _mask(b"!?"), "punctuation": _mask(b".,;:'\"()-")}


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The base statistics (whole numbers) and the forest's figures of each text."""
    base, figures = [], []
    for _, part in chunks(texts):
        w = Words(part, AS_IS)
        raw = np.frombuffer(w.data, np.uint8)
        at = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=at[1:])
        running = {k: np.concatenate([[0], np.cumsum(m[raw], dtype=np.int64)]) for k, m in (_COUNTED | {"word_chars": _CHAR_IN_WORD, "chars": _FIRST}).items()}
        end = np.minimum(at[1:] - 1, len(raw))
        counted = {k: v[end] - v[at[:-1]] for k, v in running.items()}
        n = np.diff(w.first)
        h, whole = w.windows(3)
        owner = np.searchsorted(w.first, np.arange(len(w.hashes)), side="right").astype(np.uint64)
        key = h ^ (owner[: len(h)] * np.uint64(0x9E3779B97F4A7C15))
        _, where, times = np.unique(key[whole], return_inverse=True, return_counts=True)
        again = np.flatnonzero(whole)[times[where] > 1] if len(where) else np.zeros(0, np.int64)
        covered = np.zeros(len(w.hashes) + 3, np.int64)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 3, -1)
        repeated = np.concatenate([[0], np.cumsum(np.cumsum(covered)[: len(w.hashes)] > 0)])
        same = np.zeros(len(w.hashes) + 1, np.int64)
        if len(w.hashes) > 1:
            same[2:] = np.cumsum((w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1]))
        _, once = np.unique(w.hashes ^ (owner * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        distinct = np.bincount(owner[once].astype(np.int64), minlength=len(part) + 1)[1:]
        for d, text in enumerate(part):
            lines = [line for line in text.split(b"\n") if line.strip(ASCII_SPACE)]
            words, chars = int(n[d]), max(1, int(counted["chars"][d]))
            dup, rep = len(lines) - len(set(lines)), int(repeated[w.first[d + 1]] - repeated[w.first[d]])
            base.append((words, int(counted["word_chars"][d]), int(counted["symbols"][d]), dup, rep))
            some = max(1, words)
            figures.append((
                math.log1p(words), counted["word_chars"][d] / some, counted["symbols"][d] / chars, dup / max(1, len(lines)), rep / some, distinct[d] / some, counted["capitals"][d] / chars,
                counted["digits"][d] / chars, counted["exclamations"][d] / chars, counted["punctuation"][d] / chars, (same[w.first[d + 1]] - same[w.first[d]]) / some, len(set(text)) / math.sqrt(len(text) + 1),
            ))
    return np.array(base, np.int64).reshape(-1, len(STATISTICS)), np.array(figures, float).reshape(-1, len(NAMES))


class Growth:
    """Trees of random splits, as arrays over the nodes of a binary heap, that grow by a level at a time.

    Of each node, ``rank`` puts the figures in random order and ``share`` is a random number, both drawn beforehand: it splits the first figure in that order
    that differs among its rows, at that share of the way from the least to the greatest.
    """

    def __init__(self, trees: int, depth: int, width: int, seed: int = 11) -> None:
        self.depth, self.width, self.seed, self.level = depth, width, seed, 0
        nodes = (1 << (depth + 1)) - 1
        self.feature, self.cut, self.length = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.full((trees, nodes), np.nan)  # a node with a length is a leaf
        self.rows = np.zeros(trees, np.int64)

    def drawn(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """rank and share of the nodes of a tree."""
        rng = np.random.default_rng([self.seed, tree])
        return rng.random(((1 << self.depth) - 1, self.width)), rng.random((1 << self.depth) - 1)

    def ranges(self, parts: Iterator[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each node of this level that rows come to: its tree and place among those of its level as one number, how many rows, and (above the last level) their least and greatest figures.
        parts: figures of some rows, and which trees have them, or None for all."""
        trees, first, inner = len(self.feature), (1 << self.level) - 1, self.level < self.depth
        n = np.zeros((trees, first + 1), np.int64)
        low = np.full((trees, first + 1, self.width if inner else 0), np.inf)
        high = -low
        left = onward(self.length, self.cut)
        for x, has in parts:
            for t in range(trees):
                own = x if has is None else x[has[:, t]]
                node = down(own, self.level, left[t], self.feature[t], self.cut[t])
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node[order], first) :]  # without rows in leaves further up
                if not len(order):
                    continue
                at = node[order]
                start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                k = at[start].astype(np.int64) - first
                n[t, k] += np.diff(np.append(start, len(at)))
                if inner:
                    y = own.T[:, order]
                    low[t, k] = np.minimum(low[t, k], np.minimum.reduceat(y, start, axis=1).T)
                    high[t, k] = np.maximum(high[t, k], np.maximum.reduceat(y, start, axis=1).T)
        some = np.flatnonzero(n.ravel())
        return some, n.ravel()[some], low.reshape(n.size, -1)[some], high.reshape(n.size, -1)[some]

    def split(self, place: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Split the nodes of this level, of which these are the ranges over all rows, or make them leaves."""
        first, wide = (1 << self.level) - 1, 1 << self.level
        tree, node = place // wide, place % wide + first
        if not self.level:
            self.rows[tree] = n
        above = np.arange(first, first + wide)
        reached = np.isfinite(self.cut[:, (above - 1) // 2]) if self.level else np.ones((len(self.feature), 1), bool)
        self.length[:, first : first + wide][reached] = self.level  # a side of a split that got no rows
        self.length[tree, node] = [self.level + expected(rows) for rows in n.tolist()]
        if self.level < self.depth:
            draws: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for t, k, rows, a, z in zip(tree.tolist(), node.tolist(), n.tolist(), low, high, strict=True):
                differs = z > a
                if rows > 1 and differs.any():
                    rank, share = draws[t] if t in draws else draws.setdefault(t, self.drawn(t))
                    f = int(np.where(differs, rank[k], -1).argmax())
                    self.feature[t, k], self.cut[t, k], self.length[t, k] = f, a[f] + (z[f] - a[f]) * share[k], np.nan
        self.level += 1

    def forest(self) -> Forest:
        """Of the trees that have rows."""
        some = self.rows > 0
        return Forest(self.feature[some], self.cut[some], self.length[some], float(self.rows[some].mean()))


def onward(length: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The left child of each inner node of each tree; another node leads to itself."""
    nodes = np.arange(length.shape[1])
    return np.where(np.isnan(length) & np.isfinite(cut), 2 * nodes + 1, nodes).astype(np.min_scalar_type(2 * len(nodes)))


def down(x: np.ndarray, levels: int, left: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of a tree that each row of x is in after so many levels, or the leaf that it came to before. (What leads to itself has an infinite cut.)"""
    node, flat, row = np.zeros(len(x), left.dtype), x.ravel(), np.arange(len(x)) * x.shape[1]
    for _ in range(levels):
        node = left[node] + (flat[row + feature[node]] > cut[node])
    return node


class Forest:
    """``paths`` gives the mean path length over all trees, shortest for what stands apart."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, length: np.ndarray, rows: float) -> None:
        self.feature, self.cut, self.length, self.rows = feature, cut, np.nan_to_num(length), rows
        self.inner, self.left = np.isnan(length) & np.isfinite(cut), onward(length, cut)
        self.depth = int(math.log2(feature.shape[1] + 1)) - 1

    @classmethod
    def of(cls, x: np.ndarray, *, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
        """A forest in this process, each tree from so many rows of x."""
        rng, rows = np.random.default_rng(seed), min(rows, len(x))
        has = np.zeros((len(x), trees), bool)
        for t in range(trees):
            has[rng.choice(len(x), rows, replace=False), t] = True
        growth = Growth(trees, depth_for(rows), x.shape[1], seed)
        for _ in range(growth.depth + 1):
            growth.split(*growth.ranges(iter([(x, has)])))
        return growth.forest()

    def paths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in range(len(self.feature)):
            total += self.length[t, down(x, self.depth, self.left[t], self.feature[t], self.cut[t])]
        return total / len(self.feature)

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; over a half where paths are shorter than in a random search tree of as many rows."""
        return 2.0 ** (-self.paths(x) / max(expected(round(self.rows)), 1e-9))


def depth_for(rows: int) -> int:
    return max(1, math.ceil(math.log2(max(2, rows))))


def expected(n: int) -> float:
    """The mean path of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Rules:
    forest: Forest | None
    threshold: float

    def verdicts(self, x: np.ndarray) -> np.ndarray:
        return self.forest.anomaly(x) if self.forest is not None and len(x) else np.zeros(len(x))


def calibrated(anomaly: np.ndarray, good: np.ndarray, price: float, most_lost: float) -> float:
    """The threshold with the best balance: the share of bad rows above it, less ``price`` times the share of good rows above it, of which there may
    be at most ``most_lost``. It lies in the middle of the gap over the last row that it lets through."""
    if not good.any():
        return math.inf
    value = np.unique(anomaly)
    lost = 1 - np.searchsorted(np.sort(anomaly[good]), value, side="right") / good.sum()
    caught = 1 - np.searchsorted(np.sort(anomaly[~good]), value, side="right") / max(1, (~good).sum())
    balance = np.where(lost <= most_lost, caught - price * lost, -np.inf)
    k = len(value) - 1 - int(balance[::-1].argmax())  # of equals, the one that rejects least
    return float(value[k] + value[k + 1]) / 2 if k + 1 < len(value) else math.inf


def threshold(known: DataFrame, price: float, most_lost: float) -> float:
    """What ``calibrated`` gives for (anomaly, good), over all rows: equal anomalies are one row, and sums run over these in order, a range of them in each partition."""
    spark, good = known.sparkSession, F.col("good").cast("long")
    value = known.groupBy("anomaly").agg(F.sum(good).alias("good"), F.sum(1 - good).alias("bad"))
    dealt = saved(value.repartitionByRange(partitions(spark), "anomaly").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("anomaly").alias("least")).orderBy("least").collect()
    goods, bads = sum(p.good for p in parts), sum(p.bad for p in parts)
    if not goods:
        return math.inf
    before, good_before, bad_before = [], 0, 0
    for p, after in zip(parts, [*(q.least for q in parts[1:]), None], strict=True):
        before.append((p.part, good_before, bad_before, after))
        good_before, bad_before = good_before + p.good, bad_before + p.bad
    order = Window.partitionBy("part").orderBy("anomaly")
    lost = 1 - (F.col("good_before") + F.sum("good").over(order)) / F.lit(float(goods))
    caught = 1 - (F.col("bad_before") + F.sum("bad").over(order)) / F.lit(float(max(1, bads)))
    each = dealt.join(F.broadcast(spark.createDataFrame(before, "part int, good_before long, bad_before long, after double")), "part")
    each = each.select("anomaly", F.coalesce(F.lead("anomaly").over(order), "after").alias("after"), lost.alias("lost"), caught.alias("caught"))
    balance = F.when(F.col("lost") <= most_lost, F.col("caught") - price * F.col("lost")).otherwise(-math.inf)
    best = each.agg(F.max(F.struct(balance.alias("balance"), "anomaly", "after")).alias("best")).first().best  # of equals, the one that rejects least
    return math.inf if best.after is None else (best.anomaly + best.after) / 2


def drawn(rows_of: DataFrame, trees: int, rows: int) -> DataFrame:
    """Rows with ``trees`` that draw them, for forests that are asked to subsample: each of ``trees`` is expected to draw ``rows`` of all rows, by a hash of the row; of fewer rows, all.

    A row is drawn trees * rows / (number of rows) times, each time by another tree; what is over a whole number is the chance of one draw more.
    """
    rate = min(trees, trees * rows / max(1, rows_of.count()))
    h = F.xxhash64(*rows_of.columns)
    times = int(rate) + F.when(F.pmod(F.xxhash64(h, F.lit(1)), F.lit(1 << 40)) < int((rate - int(rate)) * (1 << 40)), 1).otherwise(0)
    chosen = rows_of.withColumns({"h": h, "times": times}).where("times > 0")
    return chosen.withColumn("trees", F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda j: F.pmod(F.col("h") + j, F.lit(trees)).cast("int"))).drop("h", "times")


def blocks(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Figures of BLOCK rows or some more at once, and which trees have them if the rows have ``trees``."""
    def joined() -> tuple[np.ndarray, np.ndarray | None]:
        x = np.concatenate([b.column("x").flatten().to_numpy() for b in held]).reshape(-1, len(NAMES))
        if "trees" not in held[0].schema.names:
            return x, None
        has = np.zeros((len(x), trees), bool)
        times = np.concatenate([b.column("trees").value_lengths().to_numpy() for b in held])
        has[np.repeat(np.arange(len(x)), times), np.concatenate([b.column("trees").flatten().to_numpy() for b in held])] = True
        return x, has

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= BLOCK:
            yield joined()
            held = []
    if sum(h.num_rows for h in held):
        yield joined()


def grown(figures: DataFrame, *, trees: int = TREES, depth: int = DEPTH) -> Forest | None:
    """The forest of all rows of (x), or of (x, trees) each tree of the rows that it has; without rows, none. Each level is a pass over the rows, which are best saved;
    a task and the driver hold the ranges of one level, at most trees * 2 ** (depth - 1) nodes, however many the rows."""
    spark, growth = figures.sparkSession, Growth(trees, depth, len(NAMES))
    rows = figures.select(*[c for c in ("x", "trees") if c in figures.columns])
    count = rows.rdd.getNumPartitions()
    rows = rows.coalesce(max(2 * spark.sparkContext.defaultParallelism, count // TOGETHER))
    for level in range(depth + 1):
        ends = [(f"{name}{j}", f) for name, f in (("low", F.min), ("high", F.max)) for j in range(len(NAMES))] if level < depth else []
        shared = spark.sparkContext.broadcast(growth)

        def make(batches: Iterator[pa.RecordBatch], shared=shared, names=[c for c, _ in ends]) -> Iterator[dict]:
            place, n, low, high = shared.value.ranges(blocks(batches, trees))
            yield {"place": place, "n": n} | dict(zip(names, [*low.T, *high.T]))

        found = map_batches(rows, make, ", ".join(["place long", "n long", *(f"{c} double" for c, _ in ends)]))
        got = found.groupBy("place").agg(F.sum("n").alias("n"), *(f(c).alias(c) for c, f in ends)).toArrow()
        column = {c: got.column(c).to_numpy() for c in got.column_names}
        if not level and not got.num_rows:
            return None
        low, high = (np.stack([column[f"{name}{j}"] for j in range(len(NAMES))], 1) if ends else np.zeros((got.num_rows, 0)) for name in ("low", "high"))
        growth.split(column["place"], column["n"], low, high)
        shared.unpersist()
    return growth.forest()


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, and the forest's figures x."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            base, x = statistics(text_bytes(b.column("text")))
            yield {"doc_id": b.column("doc_id"), "base_failed": failed(base), "x": list(x)} | {name: base[:, j] for j, name in enumerate(STATISTICS)}

    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(text, make, ", ".join(f"{s} long" for s in STATISTICS) + ", base_failed boolean, x array<double>", ("doc_id",))


def learnt(figures: DataFrame, labels: DataFrame, *, label: str = "quality", trees: int = TREES, depth: int = DEPTH, rows: int | None = None, price: float = 8.0, most_lost: float = 0.02, id_col: str = "doc_id") -> Rules:
    """The forest of all rows that ``measured`` gave, and its threshold from every one of them that has a label and passes the base rules (these need no help). With ``rows`` each tree
    draws so many. Null labels and ids are passed over, a repeated id has its greatest label. Without rows there is no forest, and without labelled good rows no threshold."""
    forest = grown(figures if rows is None else drawn(figures, trees, rows), trees=trees, depth=depth)
    if forest is None:
        return Rules(None, math.inf)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = figures.where(~F.col("base_failed")).select("doc_id", "x").join(known.groupBy("doc_id").agg((F.max("label") == 1).alias("good")), "doc_id")
    rules = Rules(forest, math.inf)
    return Rules(forest, threshold(_scored(known, rules, ("good",)), price, most_lost))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> Rules:
    """The forest and its threshold, as ``learnt`` has them, of texts. Very long texts are read whole."""
    return learnt(saved(measured(docs, id_col=id_col, text_col=text_col)), labels, id_col=id_col, **how)


def failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def _scored(figures: DataFrame, rules: Rules, carry: tuple[str, ...]) -> DataFrame:
    """``carry`` of each row of (x), and its anomaly."""
    shared = figures.sparkSession.sparkContext.broadcast(rules)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {c: b.column(c) for c in carry} | {"anomaly": shared.value.verdicts(b.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))}

    return map_batches(figures, make, "anomaly double", carry)


def verdicts(figures: DataFrame, rules: Rules) -> DataFrame:
    """What ``judged`` gives, of rows that ``measured`` gave."""
    out = _scored(figures, rules, ("doc_id", *STATISTICS, "base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= rules.threshold))


def judged(docs: DataFrame, rules: Rules, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, kept, anomaly.

    Nulls: a null text has no words, so the base rules fail it; a null id is carried. Very long texts are read whole. Equal texts, and so repeated rows, have equal
    results; an anomaly equal to the threshold passes. Empty tables: no rows; without
    labelled good rows only the base rules reject. Other columns are not carried, so clashing names cannot disturb.
    """
    return verdicts(measured(docs, id_col=id_col, text_col=text_col), rules)
