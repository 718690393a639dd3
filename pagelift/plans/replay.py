"""Registered queries that hold comparisons against SQL: what their operations replay to, and that no shorter way exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff
from .catalog import _WS, doc_lines, query, table


def _common(a: str, b: str) -> str:
    """SQL for the length of a longest common subsequence of two lists, row by row; 0 beyond the cells that a comparison takes."""
    row = f"list_reduce(range(1, len({b}) + 1), lambda acc, j: list_append(acc, CASE WHEN {b}[j] = t THEN best[j] + 1 ELSE greatest(best[j + 1], acc[j]) END), [CAST(0 AS BIGINT)])"
    whole = f"list_reduce({a}, lambda best, t: {row}, list_transform(range(0, len({b}) + 1), lambda x: CAST(0 AS BIGINT)))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 OR len({a}) * len({b}) > 250000 THEN 0 ELSE ({whole})[len({b}) + 1] END"


@query(rf"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations),
w AS (SELECT conv_id, turn, regexp_extract_all(earlier, '[^{_WS[1:]}+') AS a, regexp_extract_all(text, '[^{_WS[1:]}+') AS b FROM p WHERE earlier IS NOT NULL AND NOT regexp_matches(earlier, '^#{{1,6}} ') AND NOT regexp_matches(text, '^#{{1,6}} '))
SELECT conv_id, turn, array_to_string(a, ' ') AS before, array_to_string(b, ' ') AS after, CAST({_common('a', 'b')} AS BIGINT) AS n_same FROM w""")
def word_diff_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-1, DIF-2: what goes and stays is the turn before, what stays and comes the turn, and as much stays as can."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null").withColumnRenamed("text", "after")
    pairs = pairs.where(~F.col("before").rlike("^#{1,6} ") & ~F.col("after").rlike("^#{1,6} "))
    said = lambda *kinds: F.array_join(F.transform(F.filter("ops", lambda o: o["type"].isin(*kinds)), lambda o: o["text"]), " ")
    ops = diff.word_diff(pairs, ("conv_id", "turn"))
    return ops.select("conv_id", "turn", said("same", "del").alias("before"), said("same", "add").alias("after"), F.size(F.filter("ops", lambda o: o["type"] == "same")).cast("long").alias("n_same"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents), k AS (SELECT doc_id, seq, lower(regexp_replace(regexp_replace(line, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')) AS key FROM l),
a AS (SELECT doc_id, list(key ORDER BY seq) AS a FROM k GROUP BY 1), b AS (SELECT doc_id, list(key ORDER BY CASE WHEN seq % 11 = 3 THEN seq * 2 + 11 ELSE seq * 2 END) AS b FROM k WHERE seq % 7 <> 2 GROUP BY 1),
s AS (SELECT doc_id, len(a) AS n, len(b) AS m, {_common('a', 'b')} AS same FROM a JOIN b USING (doc_id)) SELECT doc_id, CAST(n - same AS BIGINT) AS gone, CAST(m - same AS BIGINT) AS come FROM s WHERE n > same OR m > same""")
def document_diff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-3, DIF-5, JN-13: of each document with changes, how many blocks of the one revision are not in their place in the other: no more than need be."""
    lines = doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("seq"), X.match_key(F.col("line")).alias("key"), F.lit("").alias("signature"))
    moved = F.when(F.col("seq") % 11 == 3, F.col("seq") * 2 + 11).otherwise(F.col("seq") * 2)
    found = diff.block_changes(lines, lines.where("seq % 7 <> 2").withColumn("seq", moved))
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return found.groupBy("doc_id").agg(n("moved", "removed", "replaced").alias("gone"), n("moved", "added", "replaced").alias("come"))
