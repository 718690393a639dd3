"""Arrow batches between Spark and numpy code."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import checkpoints, reachable

#: Rows, and bytes, of a batch that goes to Python: texts may be long, so few at once. One text is never cut.
ROWS, BYTES = 512, 8 << 20


def arrow_type(ddl: str) -> pa.DataType:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.list_(kinds[ddl[6:-1]]) if ddl.startswith("array<") else kinds[ddl]


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, Any]]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """df through ``make``, from batches to columns: of flat types named as in ``schema``, and of df's own named in ``carry``. No shuffle."""
    small_batches(df.sparkSession)
    added = [f.split() for f in schema.split(", ") if f]
    target = [(name, None) for name in carry] + [(name, arrow_type(kind)) for name, kind in added]
    full = T.StructType([df.schema[c] for c in carry] + (T.StructType.fromDDL(schema).fields if schema else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays([columns[n] if k is None or isinstance(columns[n], pa.Array) else pa.array(columns[n], k) for n, k in target], names=[n for n, _ in target])

    return df.mapInArrow(run, full)


def small_batches(spark: SparkSession) -> None:
    """Lower the limits of a batch where they are above ours; settings below stay. Workers can import the package from here on."""
    reachable(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_binary(column.type):
        column = column.cast(pa.string()).cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Each text; null is empty."""
    return [t or "" for t in column.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept as files in the folder that spark.checkpoint.dir names; a lost executor loses nothing."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
