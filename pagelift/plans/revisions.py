"""Registered queries over revisions of formatted text and of whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff, revision
from .catalog import _WS, query, table
from .replay import _common

_RUNS = "SELECT conv_id, turn, r AS run_no, substr({text}, r * {size} + 1, {size}) AS text, CASE (r + turn) % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'i' ELSE 'p' END AS mark FROM t, unnest(range(0, CAST(ceil(length({text}) / {size}.0) AS BIGINT))) AS x(r)"


@query(rf"""
WITH t AS (SELECT conv_id, turn, text AS old, 'Note: ' || replace(replace(text, 'en', 'an'), ', ', ' ') AS new FROM conversations),
b AS ({_RUNS.format(text="old", size=17)}), a AS ({_RUNS.format(text="new", size=23)}),
bs AS (SELECT conv_id, turn, md5(string_agg(text, '' ORDER BY run_no)) AS before, md5(string_agg(repeat(mark, CAST(length(text) AS INTEGER)), '' ORDER BY run_no)) AS before_format FROM b GROUP BY 1, 2),
ns AS (SELECT conv_id, turn, md5(string_agg(text, '' ORDER BY run_no)) AS after, md5(string_agg(repeat(mark, CAST(length(text) AS INTEGER)), '' ORDER BY run_no)) AS after_format FROM a GROUP BY 1, 2),
w AS (SELECT conv_id, turn, regexp_extract_all(old, '[^{_WS[1:]}+') AS x, regexp_extract_all(new, '[^{_WS[1:]}+') AS y FROM t)
SELECT conv_id, turn, before, before_format, after, after_format, CAST({_common('x', 'y')} AS BIGINT) AS n_same FROM ns LEFT JOIN bs USING (conv_id, turn) JOIN w USING (conv_id, turn)""")
def tracked_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-9: every turn in runs of 17 characters against an edited one in runs of 23: by position, both revisions' texts and formats come out of the overlay, and as many words stay as can."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    edited = F.concat(F.lit("Note: "), F.replace(F.replace("text", F.lit("en"), F.lit("an")), F.lit(", "), F.lit(" ")))

    def runs(text, size: int) -> DataFrame:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int")), lambda r: F.substring(text, r * size + 1, F.lit(size)))
        mark = F.element_at(F.array(F.lit("b"), F.lit("i"), F.lit("p")), ((F.col("run_no") + F.col("turn")) % 3 + 1).cast("int"))
        return turns.select("conv_id", "turn", F.posexplode(cut).alias("run_no", "text")).where("text <> ''").withColumn("mark", mark)

    parts = revision.revised_runs(runs(F.col("text"), 17), runs(edited, 23), ("conv_id", "turn"), ("mark",))

    def told(c, *kinds: str):
        rows = F.array_sort(F.collect_list(F.when(F.col("change").isin(*kinds), F.struct("seq", c.alias("c")))))
        return F.when(F.size(rows) > 0, F.md5(F.array_join(F.transform(rows, lambda r: r["c"]), "")))

    size = F.length("text")
    stays = F.array_sort(F.collect_list(F.when(F.col("change") == "same", F.struct("change_no", "seq", "text"))))
    same = F.array_join(F.transform(stays, lambda r, i: F.concat(F.when((i > 0) & (F.get(stays, i - 1)["change_no"] != r["change_no"]), F.lit(" ")).otherwise(F.lit("")), r["text"])), "")
    rows = parts.groupBy("conv_id", "turn").agg(
        told(F.col("text"), "same", "del").alias("before"), told(F.expr("repeat(coalesce(was.mark, format.mark), length(text))"), "same", "del").alias("before_format"), told(F.col("text"), "same", "ins").alias("after"),
        told(F.expr("repeat(format.mark, length(text))"), "same", "ins").alias("after_format"), same.alias("same"), F.sum(size).alias("n"),
    )
    return rows.select("conv_id", "turn", "before", "before_format", "after", "after_format", F.size(F.regexp_extract_all("same", F.lit(rf"[^{X.WS}]+"), F.lit(0))).cast("long").alias("n_same"))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
o AS (SELECT doc_id, n // 12 AS page, n AS seq, lower(trim(regexp_replace(line, '{_WS}+', ' ', 'g'))) AS key FROM l),
c AS (SELECT doc_id, CASE WHEN seq % 13 = 4 THEN page + 1 ELSE page END AS page, CASE WHEN seq % 13 = 4 THEN seq * 2 + 31 WHEN seq % 10 = 7 THEN seq * 2 - 5 ELSE seq * 2 END AS seq, CASE WHEN seq % 17 = 3 THEN key || ' more' ELSE key END AS key FROM o WHERE seq % 7 <> 2),
a AS (SELECT doc_id, page, list(key ORDER BY seq) AS a FROM o GROUP BY 1, 2), b AS (SELECT doc_id, page, list(key ORDER BY seq) AS b FROM c GROUP BY 1, 2),
p AS (SELECT doc_id, page, coalesce(a, []) AS a, coalesce(b, []) AS b FROM a FULL JOIN b USING (doc_id, page)), s AS (SELECT *, {_common('a', 'b')} AS same FROM p),
x AS (SELECT doc_id, key, max(page) AS page FROM o WHERE key <> '' GROUP BY 1, 2 HAVING count(*) = 1), y AS (SELECT doc_id, key, max(page) AS page FROM c WHERE key <> '' GROUP BY 1, 2 HAVING count(*) = 1),
m AS (SELECT doc_id, y.page, count(*) AS n FROM x JOIN y USING (doc_id, key) WHERE x.page <> y.page GROUP BY 1, 2)
SELECT doc_id, page, md5(array_to_string(list_sort(b), chr(10))) AS keys, CAST(len(a) - same AS BIGINT) AS gone, CAST(len(b) - same AS BIGINT) AS come, coalesce(m.n, 0) AS moved_here FROM s LEFT JOIN m USING (doc_id, page)""")
def page_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-8, JN-3, JN-11, SET-2: documents in pages of twelve lines against a revision with lines dropped, edited, moved within pages and across: every page after is replayed from the page before and its changes, no more differs than must, and a move across pages is one row."""
    old = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    key = F.lower(F.trim(F.regexp_replace("line", rf"[{X.WS}]+", " ")))
    old = old.select("doc_id", F.floor(F.col("seq") / 12).alias("page"), F.col("seq").cast("long").alias("seq"), key.alias("key"), F.lit("").alias("signature"))
    n, moves = F.col("seq"), F.col("seq") % 13 == 4
    new = old.where("seq % 7 <> 2").select(
        "doc_id", F.when(moves, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.when(moves, n * 4 + 62).when(n % 10 == 7, n * 4 - 9).otherwise(n * 4).alias("seq"),  # twice the SQL's; where a line would come to stand on an earlier one's place, it follows it
        F.when(n % 17 == 3, F.concat("key", F.lit(" more"))).otherwise(F.col("key")).alias("key"), "signature",
    )
    changes = revision.document_changes(old, new)
    across = (F.col("kind") == "moved") & (F.col("before_page") != F.col("after_page"))
    marks = [changes.where(f"{side}_seq is not null").select("doc_id", F.col(f"{side}_page").alias("page"), F.col(f"{side}_seq").alias("seq"), F.lit(side).alias("side"), F.lit(1).alias("changed"), across.cast("int").alias("across")) for side in ("before", "after")]
    blocks = [df.select("doc_id", "page", "seq", "key", F.lit(side).alias("side")) for df, side in ((old, "before"), (new, "after"))]
    rows = blocks[0].unionByName(blocks[1]).unionByName(marks[0], allowMissingColumns=True).unionByName(marks[1], allowMissingColumns=True).repartition("doc_id")
    place = W.partitionBy("doc_id", "page", "side", "seq")
    said = lambda c: F.coalesce(F.max(c).over(place), F.lit(0))
    rows = rows.withColumns({"changed": said("changed"), "across": said("across")}).where("key is not null")
    gone, come = (F.when(F.col("side") == side, F.col("changed")).otherwise(0) for side in ("before", "after"))
    stays = ((F.col("side") == "before") & (F.col("changed") == 0)) | ((F.col("side") == "after") & (F.col("changed") == 1))
    rows = rows.select("doc_id", "page", F.when(stays, F.col("key")).alias("key"), gone.alias("gone"), come.alias("come"), F.when(F.col("side") == "after", F.col("across")).otherwise(0).alias("here"))
    return rows.groupBy("doc_id", "page").agg(F.md5(F.array_join(F.array_sort(F.collect_list("key")), "\n")).alias("keys"), *(F.sum(c).cast("long").alias(a) for c, a in (("gone", "gone"), ("come", "come"), ("here", "moved_here"))))


@query(rf"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS earlier FROM conversations),
w AS (SELECT conv_id, turn, regexp_extract_all(earlier, '[^{_WS[1:]}+') AS a, regexp_extract_all(text, '[^{_WS[1:]}+') AS b FROM p WHERE earlier IS NOT NULL AND NOT regexp_matches(earlier, '^#{{1,6}} ') AND NOT regexp_matches(text, '^#{{1,6}} ')),
s AS (SELECT *, {_common('a', 'b')} AS same FROM w WHERE len(a) + len(b) > 0) SELECT conv_id, turn, CAST(len(b) - same AS BIGINT) AS added, CAST(len(a) - same AS BIGINT) AS removed, CAST(0 AS BIGINT) AS heading_changes FROM s""")
def word_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9: words that came and went between consecutive turns, but for turns that begin with a heading mark."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null").withColumnRenamed("text", "after")
    pairs = pairs.where(~F.col("before").rlike("^#{1,6} ") & ~F.col("after").rlike("^#{1,6} "))
    ops = diff.word_diff(pairs, ("conv_id", "turn")).select("conv_id", "turn", F.posexplode("ops").alias("seq", "op")).select("conv_id", "turn", "seq", "op.*")
    return diff.counters(ops, ("conv_id", "turn")).withColumn("heading_changes", F.col("heading_changes").cast("long"))
