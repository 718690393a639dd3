"""Registered queries over markup, tables of positioned lines, runs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import markup, tables
from .catalog import _SEQ, DEVICE_TABLE, query, sequenced, table


@query("""
WITH p AS (SELECT p_partkey, p_size % 7 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS bold, CASE k WHEN 0 THEN true WHEN 3 THEN false END AS italic, CASE k WHEN 4 THEN true WHEN 5 THEN false END AS underline, CASE k WHEN 4 THEN true WHEN 5 THEN false END AS strike FROM p""")
def css_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-2, MAP-7."""
    styles = ["font-weight: 700; FONT-STYLE:Italic", "font-weight:normal;font-weight:Bold", "font-weight:400", "font-weight:lighter;font-style:normal", "text-decoration: underline line-through", "text-decoration-line:none;text-decoration:underline", "color:red"]
    t = markup.css_traits(F.get(F.array(*[F.lit(s) for s in styles]), F.col("p_size") % 7))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS up, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN false END AS bold FROM part), c AS (SELECT id, id AS at, up, 0 AS d FROM n UNION ALL SELECT c.id, n.id, n.up, d + 1 FROM c JOIN n ON n.id = c.up)
SELECT c.id AS node_id, coalesce(min_by(bold, d) FILTER (WHERE bold IS NOT NULL), false) AS bold FROM c JOIN n ON n.id = c.at GROUP BY 1""")
def inherited_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17: a tree in which node n hangs from n / 3."""
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.reverse(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.floor(k / F.pow(F.lit(3.0), i)).cast("long"))))
    nodes = table(spark, sf_dir, "part").select(F.lit(1).alias("doc_id"), k.alias("node_id"), path.alias("path"), F.when(size % 4 == 0, F.lit(True)).when(size % 4 == 1, F.lit(False)).alias("bold"))
    return markup.inherited_traits(nodes, traits=("bold",)).drop("doc_id")


@query("""
WITH p AS (SELECT p_partkey, p_size % 6 AS k, p_name FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '<h2 class="a">x</h2>' WHEN 1 THEN '<h1>' || p_name || ' &amp; co</h1><p>x</p>' WHEN 2 THEN '<div class="page-break"></div><h1>x</h1>' WHEN 3 THEN '<section><h2>x</h2></section>' WHEN 4 THEN '<h1>' || p_name || ' &amp; co</h1>' ELSE '<h1>' || p_name || ' &amp; co</h1><h3>x</h3>' END AS html FROM p""")
def chapter_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-24."""
    bodies = ['<h2 class="a">x</h2>', " <p>x</p>", '<div class="page-break"></div><h1>x</h1>', "<section><h2>x</h2></section>", "", "<h3>x</h3>"]
    return table(spark, sf_dir, "part").select("p_partkey", markup.titled(F.get(F.array(*[F.lit(b) for b in bodies]), F.col("p_size") % 6), F.concat("p_name", F.lit(" & co"))).alias("html"))


@query("""
WITH p AS (SELECT p_partkey, p_size % 3 AS k, p_name FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '|' || p_name || '|b' WHEN 1 THEN '||' || p_name ELSE p_name || '|x|' END AS runs, 'When: Monday ' || p_name || '; 9am' AS line, CASE k WHEN 0 THEN 'left' WHEN 1 THEN 'start' ELSE 'none' END AS alignment, len(regexp_extract_all(p_name, 'o')) AS breaks FROM p""")
def run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26, STR-27, STR-28, AGG-16."""
    k, name = F.col("p_size") % 3, F.col("p_name")
    runs = F.when(k == 0, F.array(F.lit(" 1."), F.concat(F.lit(" "), name), F.lit("b"))).when(k == 1, F.array(F.lit("1"), F.lit(". "), name)).otherwise(F.array(name, F.lit("x"), F.lit("")))
    line = markup.joined_runs(F.array(F.lit("When:"), F.lit("Monday "), name, F.lit(";"), F.lit("9am")))
    classes = F.when(k == 0, F.array(F.lit("a"), F.lit("align-left"), F.lit("align-right"))).when(k == 1, F.array(F.lit("align-start"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(markup.without_marker(runs, F.lit("1.")), "|").alias("runs"), line.alias("line"), markup.class_value(classes, "align-", "none").alias("alignment"), markup.line_breaks(F.replace(name, F.lit("o"), F.lit("<BR>"))).alias("breaks"))


@query("""
WITH p AS (SELECT p_partkey, '<p></p><p>' || p_name || '</p><pre>a' || chr(10) || 'b</pre><p> &nbsp;</p><table class="t" style="x:y"><tr style=''z''><td>1</td></tr></table><img alt="n"><img src="s">' AS h, p_name FROM part)
SELECT p_partkey, '<p>' || p_name || '</p><p>a<br/>b</p><table class="t"><tr><td>1</td></tr></table><img src="s">' AS html FROM p""")
def prepared_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-3."""
    h = F.concat(F.lit("<p></p><p>"), "p_name", F.lit("</p><pre>a\nb</pre><p> &nbsp;</p><table class=\"t\" style=\"x:y\"><tr style='z'><td>1</td></tr></table><img alt=\"n\"><img src=\"s\">"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.prepared(h).alias("html"))


@query("""
WITH d(device, sw, sh, colour) AS (VALUES ('clara-bw', 1072, 1448, false), ('clara-colour', 1072, 1448, true), ('libra-colour', 1264, 1680, true), ('sage', 1440, 1920, false), ('elipsa-2e', 1404, 1872, false)), o AS (SELECT device, 'portrait' AS orientation, sw AS w, sh AS h, colour FROM d UNION ALL SELECT device, 'landscape', sh, sw, colour FROM d),
i AS (SELECT p_partkey AS image_id, p_size * 60.0 AS iw, p_retailprice * 2 AS ih, CASE WHEN p_size % 2 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mt FROM part), s AS (SELECT *, least(1, w / iw, h / ih) AS k FROM i, o)
SELECT image_id, device, orientation, CAST(greatest(1, floor(iw * k + 0.5)) AS INTEGER) AS out_width, CAST(greatest(1, floor(ih * k + 0.5)) AS INTEGER) AS out_height, CASE WHEN colour THEN 'colour' ELSE 'dither' END AS tone, CASE WHEN colour AND mt = 'image/jpeg' THEN mt ELSE 'image/png' END AS out_type FROM s""")
def image_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-4, IMG-6, IMG-7."""
    rows = [(d, o, w, h, "colour" in d) for d, sw, sh, *_ in DEVICE_TABLE for o, w, h in (("portrait", sw, sh), ("landscape", sh, sw))]
    devices = spark.createDataFrame(rows, "device string, orientation string, width_px int, height_px int, colour boolean")
    uses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 60.0).alias("width"), (F.col("p_retailprice") * 2).alias("height"), F.when(F.col("p_size") % 2 == 0, F.lit("image/jpeg")).otherwise(F.lit("image/png")).alias("media_type"))
    return markup.image_variants(uses, devices)


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, {_SEQ} AS seq FROM lineitem), c AS (SELECT l_orderkey AS doc_id, seq // 3 AS r, seq % 3 AS c, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'p' || l_partkey END AS t FROM s), f AS (SELECT * FROM c WHERE t <> ''),
g AS (SELECT doc_id FROM f GROUP BY 1 HAVING count(DISTINCT r) >= 2 AND count(DISTINCT c) >= 2), rr AS (SELECT doc_id, r, dense_rank() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS row_no FROM (SELECT DISTINCT doc_id, r FROM f)), cc AS (SELECT doc_id, c, dense_rank() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS column_no FROM (SELECT DISTINCT doc_id, c FROM f))
SELECT doc_id, CAST(row_no AS INTEGER) AS row_no, CAST(column_no AS INTEGER) AS column_no, coalesce(f.t, '') AS text FROM rr JOIN cc USING (doc_id) JOIN g USING (doc_id) LEFT JOIN f ON f.doc_id = rr.doc_id AND f.r = rr.r AND f.c = cc.c""")
def built_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-1."""
    k = F.col("l_partkey")
    cells = sequenced(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("seq") / 3).alias("row"), (F.col("seq") % 3).alias("column"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("text"))
    return tables.built(cells, ("doc_id",))


@query("""
WITH t AS (SELECT page_id, url, page_id % 3 AS k FROM pages)
SELECT page_id, CASE k WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'top' END AS zone, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 3 END AS INTEGER) AS "offset", CAST(CASE k WHEN 0 THEN 0.0 WHEN 1 THEN 0.8 ELSE 0.25 END AS DOUBLE) AS top, CASE WHEN page_id > 0 THEN page_id END AS source_page, k <> 2 AS changed FROM t""")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-1 page clamps, DIF-7."""
    k, none = F.col("page_id") % 3, F.lit(None)
    meta = markup.page_metadata(F.when(k == 0, F.lit("left")).when(k == 1, F.lit("middle")), F.when(k == 0, F.lit(-3)).when(k == 1, F.lit(99)).otherwise(F.lit(3)), F.when(k == 0, none.cast("double")).when(k == 1, F.lit(7.0)).otherwise(F.lit(0.25)), F.col("page_id"))
    plain = markup.page_metadata(F.lit("top"), F.lit(3), F.lit(0.25), F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", meta.alias("m"), markup.page_metadata_changed(meta, plain).alias("changed")).select("page_id", "m.*", "changed")


@query()
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-11, FLT-7, TRE-7: an order is a page of lines of three cells."""
    s = sequenced(spark, sf_dir, "l_quantity")
    x = F.col("seq") % 3 * 150 + F.col("l_quantity") / 10
    cell = F.struct(x.alias("x"), (x + 30).alias("end"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("text"))
    lines = s.groupBy("l_orderkey", F.floor((F.col("seq") - 1) / 3).alias("line_no")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    lines = lines.select("l_orderkey", "line_no", (700.0 - 14 * F.col("line_no")).alias("y"), F.lit(12.0).alias("line_height"), (F.col("line_no") == 0).alias("bold"), F.lit(4.0).alias("char_width"), "cells")
    return tables.regions(lines, s.select("l_orderkey").distinct().withColumn("has_grid", F.col("l_orderkey") % 2 == 0), ("l_orderkey",))


@query()
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-2: an order is a line of parts."""
    x = F.sum("l_quantity").over(_so_far()) * 3
    parts = sequenced(spark, sf_dir, "l_quantity").select(
        "l_orderkey", F.col("seq").alias("part_no"), x.alias("x"), F.col("l_quantity").alias("width"), F.lit(4.0).alias("char_width"), (9 + F.col("l_linenumber") % 4).alias("height"), F.lit(700.0).alias("y"), F.col("l_partkey").cast("string").alias("text"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("serif")).otherwise(F.lit("sans")).alias("signature"), F.lit(False).alias("space_before"),
    )
    return tables.runs_of_line(parts, ("l_orderkey",))


def _so_far():
    from pyspark.sql import Window as W

    return W.partitionBy("l_orderkey").orderBy("seq")


@query("""
SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key FROM conversations""".replace("\\\\", "\\"))
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, STR-8: a turn's words as runs of a paragraph."""
    runs = F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"), F.lower(X.plain_paragraph(runs)).alias("key"))
