"""Two ordered tables met per group by an imperative rule, without the cost of a data frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reachable


def met(left: DataFrame, right: DataFrame, keys: tuple[str, ...], rule: Callable[[list[dict], list[dict]], Iterable[tuple]], out: str) -> DataFrame:
    """(keys, out) where ``rule`` maps a group's left and right rows, each sorted by its columns in order, to rows of ``out``.

    Each side is gathered into an array per group (a document or a page, so bounded) and the sides are joined by key; a side that a group lacks is empty.
    """
    def gathered(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))

    return ruled(gathered(left, "left_rows").join(gathered(right, "right_rows"), list(keys), "full_outer"), keys, rule, out)


def ruled(both: DataFrame, keys: tuple[str, ...], rule: Callable[[list[dict], list[dict]], Iterable[tuple]], out: str) -> DataFrame:
    """(keys, out) where ``rule`` maps the arrays left_rows and right_rows of each row to rows of ``out``; a null array is empty."""
    reachable(both.sparkSession)
    fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([both.schema[k] for k in keys] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for b in batches:
            target = target or pa.schema([b.schema.field(k) for k in keys] + [(f.name, _ARROW[f.dataType.simpleString()]) for f in fields])
            place: list[int] = []
            columns: list[list] = [[] for _ in fields]
            for i, (x, y) in enumerate(zip(b.column("left_rows").to_pylist(), b.column("right_rows").to_pylist(), strict=True)):
                for row in rule(x or [], y or []):
                    place.append(i)
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
            at = pa.array(place, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in keys), *(pa.array(c, target.field(f.name).type) for c, f in zip(columns, fields, strict=True))], schema=target)

    return both.mapInArrow(run, schema)


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
