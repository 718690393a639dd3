"""Session defaults."""

from __future__ import annotations

import atexit
import os
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def session(name: str = "pagelift", **settings: str) -> SparkSession:
    """A session with the defaults; settings (dots as double underscores) come on top."""
    return reachable(SparkSession.builder.appName(name).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate())


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers that see this folder import the package, whatever folder the driver runs in. Where they do not, ship it with ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def checkpoints(spark: SparkSession) -> None:
    """Sets the folder of checkpoints that ``spark.checkpoint.dir`` names. Where nothing is named, a local run takes a folder of its own and a cluster is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        context.setCheckpointDir(folder)


def written(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a plan that uses it several times computes it once and a lost executor costs no earlier step."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """As ``written``, but as Parquet: compressed (``codec``: where not as the session says), and a step that reads few columns reads only these. The files go when the session ends."""
    checkpoints(df.sparkSession)
    spark, path = df.sparkSession, f"{df.sparkSession.sparkContext.getCheckpointDir()}/rows-{uuid4().hex}"
    df.write.parquet(path, compression=codec)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
