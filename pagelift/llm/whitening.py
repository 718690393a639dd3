"""Whitening of vectors by an upper-triangle aggregation.

One aggregation gives the count, the sums and the range of every dimension; a second sums, for every pair of dimensions, the product of the
components less their dimension's centre. Its expressions are generated: row i of the triangle has a sum for each distance k, the pair (i, i + k) taken round, so that half a row
of sums holds every pair once. (A sum for each of the 2,080 pairs of 64 dimensions in one row is more than generated code can hold, and Spark then interprets it.) Components are whole
numbers and so are the centres, hence these sums are exact; what the rounding of the centre adds is taken off exactly on the driver, which holds one number for each pair. LAPACK decomposes the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, saved
from .vectors import sound, width

@dataclass(frozen=True)
class Whitening:
    """What rows are whitened with. ``directions`` has a column for each component, by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float

    @property
    def rank(self) -> int:
        """Components with an eigenvalue above what rounding leaves of a zero."""
        return int((self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0), 0)).sum())


def centred_products(rows: DataFrame, column: str, dims: int, centre: list[Any], kind: str) -> list[list[Any]]:
    """For each pair of dimensions the sum over ``rows`` of (column[i] - centre[i]) * (column[j] - centre[j]) as ``kind``, in one aggregation; tasks sum before anything is moved."""
    off = F.array(*(F.lit(c).cast(kind) for c in centre))
    rows = rows.select(F.zip_with(column, off, lambda x, c: (x.cast(kind) - c).cast(kind)).alias("c"))
    sums = [F.expr(f"sum(ci * c[(i + {k}) % {dims}])").alias(f"k{k}") for k in range(dims // 2 + 1)]
    out = {}
    for row in rows.select(F.posexplode("c").alias("i", "ci"), "c").groupBy("i").agg(*sums).collect():  # a row for each dimension
        for k in range(dims // 2 + 1):
            j = (row.i + k) % dims
            out[row.i, j] = out[j, row.i] = row[f"k{k}"]
    return [[out[i, j] for j in range(dims)] for i in range(dims)]


def whole(component: Column) -> Column:
    """The whole number that stands for a component; null for what is not finite, as the optimizer may ask before such rows are dropped."""
    return F.when(F.abs(component) < float("inf"), F.floor(component.cast("double") * 64).cast("long") + 1_000_000)


def fit(vectors: DataFrame, *, vector_col: str = "embedding") -> Whitening | None:
    """Counts, exact sums, covariance (divisor n) and its decomposition over all sound vectors; None without any.

    Sums of products are 64-bit where their size, bounded by the range of components, allows it, and of decimals else. Repeated rows count each."""
    rows = sound(vectors, vector_col)
    dims = width(rows, vector_col)
    if not dims:
        return None
    rows = rows.select(F.transform(vector_col, whole).alias("x"))
    first = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i].cast("decimal(38,0)") if f is F.sum else F.col("x")[i]).alias(f"{name}{i}") for i in range(dims) for name, f in (("s", F.sum), ("a", F.min), ("b", F.max)))).first()
    n, sums = first.n, [int(first[f"s{i}"]) for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the nearest whole number
    far = max(max(first[f"b{i}"] - c, c - first[f"a{i}"]) for i, c in enumerate(centre))
    products = centred_products(rows, "x", dims, centre, "long" if n * far * far < 1 << 62 else "decimal(38,0)")
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.array([[float((Fraction(int(products[i][j])) - Fraction(rest[i] * rest[j], n)) / n) for j in range(dims)] for i in range(dims)])
    values, directions = np.linalg.eigh(covariance)
    return Whitening(n, tuple(sums), values[::-1].copy(), directions[:, ::-1].copy(), float(np.trace(covariance)))


def whitened(vectors: DataFrame, by: Whitening | None, *, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n*x-S)^2, exact), whitened (array of double, one for each component): a row for each sound vector, written to the checkpoint folder.

    A component whose eigenvalue is zero but for rounding says nothing and is left out, so that constant dimensions, or one distinct row, give fewer components or none. A deviation beyond 64 bits
    raises OverflowError rather than to be wrong. Null ids are carried, repeated rows whitened each for itself; an empty table gives no rows; other columns are not carried, so clashing names cannot disturb.
    """
    rows = sound(vectors, vector_col).select(F.col(id_col).alias("vec_id"), F.transform(vector_col, whole).alias("x"))
    if by is None:
        return rows.where("false").select("vec_id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    k, dims, n = min(components, by.rank), len(by.sums), by.n
    turn = by.directions[:, :k] / np.sqrt(by.values[:k])
    sums = np.array(by.sums, object)
    narrow = max(map(abs, by.sums)) + n * (1 << 24) < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if narrow and (not len(x) or np.abs(x).max() < 1 << 24):
                apart = x * n - sums.astype(np.int64)
            else:
                apart = x.astype(object) * n - sums
            away = apart.astype(np.float64)
            exact = apart if (away**2).sum(1).max(initial=0) < 1 << 62 else apart.astype(object)
            total = [int(t) for t in (exact * exact).sum(1)]
            if total and max(total) >= 1 << 63:
                raise OverflowError("deviation: beyond 64 bits")
            flat = (away / n @ turn).ravel()
            yield {"vec_id": b.column("vec_id"), "deviation": total, "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(flat))}

    return saved(map_batches(rows, run, "deviation long, whitened array<double>", ("vec_id",)))


def identity_error(rows: DataFrame, column: str = "whitened") -> float | None:
    """The largest absolute entry of the covariance of ``column`` less the identity; None without rows or components. Centred in a pass of its own before anything is multiplied."""
    dims = width(rows, column)
    if not dims:
        return None
    sums = rows.agg(F.count("*"), *(F.sum(F.col(column)[i]) for i in range(dims))).first()
    found = np.array(centred_products(rows, column, dims, [s / sums[0] for s in sums[1:]], "double")) / sums[0]
    return float(np.abs(found - np.eye(dims)).max())


def components(vectors: DataFrame, *, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each sound vector and component, as ``whitened`` gives them."""
    by = fit(vectors, vector_col=vector_col)
    rows = whitened(vectors, by, components=most, id_col=id_col, vector_col=vector_col)
    shares = F.array(*(F.lit(float(v / by.trace)) for v in by.values[: min(most, by.rank)])) if by is not None and by.rank else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(by.n if by else 0).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"),
        F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(rows) if by else None).cast("double").alias("identity_error"),
    )
