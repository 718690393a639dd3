"""What the trained operators share: bounded samples of labelled rows, boosted trees, isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import saved


def held_out(id_col: str = "doc_id") -> Column:
    """Whether labels of a row may not be learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, label, text) of at most ``bound`` labelled rows that may be learnt from, half of them of each label, in order of
    a hash of the id; and how many labelled rows a sampled one of each label stands for. Null labels are passed over."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("label") == k).orderBy(*order).limit(bound // 2) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most ``bound`` rows
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rows = saved(text.join(ids, "doc_id"))
    got = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    return rows, {k: totals.get(k, 0) / max(1, got.get(k, 0)) for k in (0, 1)}


class Trees:
    """Gradient-boosted trees of fixed depth for two classes, on features in quantile bins."""

    def __init__(self, *, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        width = self.bins
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        flat = binned + np.arange(f) * width
        share = np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(n, self.base)
        inner = (1 << self.depth) - 1
        self.feature, self.cut = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), width, np.int64)
        self.leaf = np.zeros((self.rounds, inner + 1))
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                base = (1 << level) - 1
                for k in range(1 << level):
                    rows = np.flatnonzero(node == base + k)
                    if len(rows) < 2:
                        continue
                    cells = flat[rows].ravel()
                    gs = np.bincount(cells, np.repeat(g[rows], f), f * width).reshape(f, width).cumsum(1)
                    hs = np.bincount(cells, np.repeat(h[rows], f), f * width).reshape(f, width).cumsum(1)
                    gt, ht = gs[0, -1], hs[0, -1]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < 1e-6) | (ht - hs < 1e-6)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        self.feature[r, base + k], self.cut[r, base + k] = divmod(best, width)
                node = self._down(binned, node, r)
            leaf = node - inner
            gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            self.leaf[r] = self.rate * gs / (hs + self.ridge)
            score += self.leaf[r][leaf]
        return self

    def _down(self, binned: np.ndarray, node: np.ndarray, r: int) -> np.ndarray:
        right = binned[np.arange(len(node)), self.feature[r, node]] > self.cut[r, node]
        return 2 * node + 1 + right

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        score = np.full(len(x), self.base)
        for r in range(self.rounds):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = self._down(binned, node, r)
            score += self.leaf[r][node - self.leaf.shape[1] + 1]
        return score


class Isotonic:
    """The non-decreasing step function of least squares, read with straight lines between the middles of its steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Isotonic:
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # mean, weight, first x, last x
        for i in order:
            pools.append([float(y[i]), float(weight[i]), float(x[i]), float(x[i])])
            while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
                b, a = pools.pop(), pools.pop()
                w = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
        self.x = np.array([(p[2] + p[3]) / 2 for p in pools] or [0.0])
        self.y = np.array([p[0] for p in pools] or [0.0])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)


def crossed(fit, x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 3) -> np.ndarray:
    """Raw scores of each row from a model that has not seen it."""
    fold = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        seen = fold != k
        if seen.any() and (~seen).any():
            out[~seen] = fit(x[seen], y[seen], weight[seen]).raw(x[~seen])
    return out
