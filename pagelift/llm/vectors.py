"""Tables of vectors: which rows can be worked on, and their components as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sound(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, and holds neither nulls nor values that are not finite. The filter stays in the JVM."""
    finite = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.where(F.coalesce((F.size(vector_col) > 0) & finite, F.lit(False)))


def width(df: DataFrame, vector_col: str = "embedding") -> int:
    """The number of dimensions, 0 without rows. Vectors of several lengths raise ValueError: no reading of them is right."""
    least, most = df.agg(F.min(F.size(vector_col)), F.max(F.size(vector_col))).first()
    if least != most:
        raise ValueError(f"{vector_col}: vectors of {least} to {most} components")
    return most or 0


def scaled(column: pa.Array, factor: int, dims: int) -> np.ndarray:
    """floor(factor * component) of a batch of vectors, one row each: 64-bit where sums of squares fit, else Python's own integers."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor).reshape(len(column), dims)
    if not len(values) or np.abs(values).max() < 1 << 24:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object)
