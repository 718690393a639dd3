"""Compression of vectors to codes: each part of a vector becomes the index of its codebook's nearest entry.

Nearest entries are found by annular norm pruning. Entries are sorted by norm; a part at distance r from some entry can have a nearer one only
among entries whose norm differs from its own by at most r, an interval that binary search finds. The first entry tried is the one nearest by norm, entries around it
shrink r and with it the interval, and what is left of the interval is evaluated whole, both ends included. Distances are sums of squares of integers, so ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved
from .vectors import scaled, sound, width

#: Pairs of a part and an entry whose distances are computed at once, and how many neighbours by norm are tried before the interval is taken whole.
PAIRS, TRIED = 1 << 14, 4
#: Components below this have squared distances below 2**53 in 64 dimensions.
SMALL = 1 << 22


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.order = np.lexsort((np.arange(len(entries)), _norms(entries)))
        self.entries = entries[self.order]
        self.norms = _norms(self.entries)
        self.small = entries.dtype != object and entries.shape[1] <= 64 and np.abs(entries).max(initial=0) < SMALL

    def interval(self, norm: np.ndarray, squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of parts with these norms at these squared distances: where entries that may be as near begin and end. Wider by more than what floating numbers lose."""
        reach = np.sqrt(squared.astype(np.float64))
        slack = 1e-9 * (norm + reach) + 1e-9
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part the index of its nearest entry (the lower of equals) and the squared distance; and how many distances were computed."""
        if self.small and parts.dtype != object and np.abs(parts).max(initial=0) < SMALL:
            index, best, computed = self._nearest(parts.astype(np.float64), self.entries.astype(np.float64))  # whole numbers that doubles hold exactly
            return index, best.astype(np.int64), computed
        return self._nearest(parts, self.entries)

    def _nearest(self, parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        norm = _norms(parts)
        at = np.clip(np.searchsorted(self.norms, norm), 0, len(self.norms) - 1)
        best, index, computed = _squared(parts, entries[at]), self.order[at], len(parts)

        def compare(rows: np.ndarray, found: np.ndarray, which: np.ndarray) -> None:
            better = (found < best[rows]) | ((found == best[rows]) & (which < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], which[better]

        for step in range(1, TRIED + 1):  # outwards by norm, as long as the interval reaches there
            for side in (at - step, at + step):
                low, high = self.interval(norm, best)
                rows = np.flatnonzero((side >= low) & (side < high))
                compare(rows, _squared(parts[rows], entries[side[rows]]), self.order[side[rows]])
                computed += len(rows)
        low, high = self.interval(norm, best)
        upto, done = np.cumsum(high - low), 0
        while done < len(parts):
            end = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
            each = (high - low)[done:end]  # at least one: an interval holds the entry that it is drawn around
            heads = np.cumsum(each) - each
            side = np.repeat(low[done:end] - heads, each) + np.arange(each.sum())
            found = _squared(np.repeat(parts[done:end], each, axis=0), entries[side])
            least = np.minimum.reduceat(found, heads)
            which = np.minimum.reduceat(np.where(found == np.repeat(least, each), self.order[side], len(self.order)), heads)
            compare(np.arange(done, end), least, which)
            computed += len(side)
            done = end
        return index, best, computed


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart) if apart.dtype == np.float64 else (apart * apart).sum(1)


def _norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt((a.astype(np.float64) ** 2).sum(1))


def _cut(column: pa.Array, factor: int, dims: int, parts: int) -> list[np.ndarray]:
    return np.split(scaled(column, factor, dims), parts, axis=1) if len(column) else []


def _sums(rows: DataFrame, books: list[np.ndarray], factor: int, dims: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Of each codebook entry that has parts: their count and sums by component. Each task sums its own; the driver gets a row for each entry."""
    size = dims // len(books)
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ready = [Codebook(b) for b in books]
        counts, sums = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), size), object)
        for b in batches:
            for p, own in enumerate(_cut(b.column("v"), factor, dims, len(books))):
                index, _, _ = ready[p].nearest(own)
                order = np.argsort(index, kind="stable")
                heads = np.flatnonzero(np.diff(index[order], prepend=-1))
                counts[p] += np.bincount(index, minlength=len(books[p]))
                sums[p][index[order][heads]] += np.add.reduceat(own[order], heads, axis=0).astype(object)
        p, e = np.nonzero(counts)
        yield {"part": p, "entry": e, "n": counts[p, e]} | {c: [str(x) for x in sums[p, e, i]] for i, c in enumerate(names)}

    tasks = map_batches(rows.select("v"), run, "part int, entry int, n long, " + ", ".join(f"{c} string" for c in names))
    total = tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names))
    return {(r.part, r.entry): (r.n, [int(r[c]) for c in names]) for r in total.collect()}


def fit(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> list[np.ndarray]:
    """A codebook (entries by components) for each part position; none without sound vectors. Starts as the parts of the ``entries`` smallest ids; each of ``rounds`` rounds assigns all parts and moves every entry that
    has parts to the floor of their mean. Null ids come last, rows of one id in order of their vectors; fewer vectors than entries give as many entries. Vectors that ``parts`` does not divide raise ValueError."""
    rows = sound(vectors, vector_col).select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dims = width(rows, "v")
    if dims % parts:
        raise ValueError(f"{vector_col}: {dims} components in {parts} parts")
    if not dims:
        return []
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).toArrow().column("v").combine_chunks()
    books = _cut(first, factor, dims, parts)
    for _ in range(rounds):
        moved = [b.astype(object) for b in books]
        for (p, e), (n, sums) in _sums(rows, books, factor, dims).items():
            moved[p][e] = [s // n for s in sums]
        books = [m.astype(np.int64) if np.abs(m).max() < 1 << 24 else m for m in moved]
    return books


def coded(vectors: DataFrame, books: list[np.ndarray], *, factor: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (the parts' entries, 0-based, two hex digits each in order), error (squared distances summed over parts); a row for each sound vector.

    Components are floor(``factor`` * component). Other rows are dropped, null ids and labels carried, repeated rows coded each for itself; an empty table gives no rows; other columns are not carried.
    """
    rows = sound(vectors, vector_col).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    dims = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ready = [Codebook(b) for b in books]
        for b in batches:
            found = [ready[p].nearest(own) for p, own in enumerate(_cut(b.column("v"), factor, dims, len(books)))]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*(index for index, _, _ in found), strict=True)]
            error = sum(best.astype(object) for _, best, _ in found) if found else []
            yield {"vec_id": b.column("vec_id"), "label": b.column("label"), "code": codes, "error": [int(x) for x in error]}

    return map_batches(rows, run, "code string, error long", ("vec_id", "label"))


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256: codebooks learnt from all sound vectors, and each vector's code. Defined as ``fit`` and ``coded`` are."""
    books = fit(vectors, id_col=id_col, vector_col=vector_col)
    rows = saved(coded(vectors, books, id_col=id_col, vector_col=vector_col, label_col=label_col))  # read for the sums and for the result
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
