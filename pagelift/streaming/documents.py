"""Streams of document revisions: the batch operators, run over what has changed.

A micro-batch plays the part of a debounced edit: its trigger interval gathers edits, and of each document only the latest revision of a batch is
worked on. Late results cannot overwrite newer ones, as every row carries its revision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def revisions(spark: SparkSession, path: str, schema: str = "doc_id bigint, revision bigint, text string", files_per_batch: int = 64) -> DataFrame:
    """A stream of Parquet files of revisions below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest(df: DataFrame, key: str = "doc_id", order: str = "revision") -> DataFrame:
    """Of each document the row of the highest revision; rows without a key go. Combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"), F.max(order).alias(order))
    return best.select(key, order, "x.*").select(*df.columns)


def refreshed(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Writes ``transform`` of each batch's latest revisions to a folder of its own below ``out`` (so a batch that is run again replaces itself);
    ``interval`` gathers edits, without it what is there is worked off and the query ends. Metrics of a batch are observed as ``refreshed``."""
    def put(batch: DataFrame, number: int) -> None:
        rows = transform(latest(batch)).observe("refreshed", F.count(F.lit(1)).alias("rows"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def current(spark: SparkSession, out: str, key: str = "doc_id", order: str = "revision") -> DataFrame:
    """What a batch run over the latest revisions gives: of each document the rows of its highest revision."""
    rows = spark.read.parquet(out).drop("batch")
    newest = rows.groupBy(key).agg(F.max(order).alias(order))
    return rows.join(newest, [key, order], "left_semi")
