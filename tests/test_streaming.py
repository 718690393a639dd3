from __future__ import annotations

from pyspark.sql import functions as F

from pagelift.sources import documents as S
from pagelift.streaming import documents as stream


def test_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id bigint, revision bigint, text string"
    first = spark.createDataFrame([(1, 1, "a\n\nb"), (2, 1, "c"), (None, 1, "x")], schema)
    second = spark.createDataFrame([(1, 2, "a\n\nd\n\ne"), (1, 3, "f"), (3, 1, None)], schema)
    transform = lambda df: S.plain_text(df, ("doc_id", "revision"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(source)
        stream.refreshed(stream.revisions(spark, source), transform, out, state).awaitTermination(60)
    got = sorted(map(tuple, stream.current(spark, out).select("doc_id", "revision", "text").collect()))
    want = sorted(map(tuple, transform(stream.latest(first.unionByName(second))).select("doc_id", "revision", "text").collect()))
    assert got == want == [(1, 3, "f"), (2, 1, "c")]


def test_latest_of_nothing(spark):
    assert stream.latest(spark.createDataFrame([], "doc_id bigint, revision bigint, text string")).agg(F.count("*")).first()[0] == 0
