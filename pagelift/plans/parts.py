"""Registered queries over parts of the larger operators: items, runs, conditional styles, lists of documents, entries, rendering, presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff, layout, markup, structure
from .catalog import _SEQ, doc_lines, query, sequenced, table


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_linenumber, {_SEQ} AS seq FROM lineitem), i AS (SELECT *, CASE WHEN l_partkey % 5 = 0 THEN ' ' WHEN l_partkey % 5 = 1 THEN 'Day:Monday' ELSE 'w' || l_partkey END AS str, CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 6 END AS n FROM s),
b AS (SELECT *, coalesce(lag(str = ' ' AND l_quantity > 0) OVER (PARTITION BY l_orderkey ORDER BY seq), false) AS sp FROM i)
SELECT l_orderkey, CAST(seq AS INTEGER) AS item_seq, CASE WHEN l_partkey % 5 = 1 THEN 'Day: Monday' ELSE str END AS text, l_quantity * 3 AS x, l_discount * 100 AS y, CASE WHEN l_linenumber % 2 = 0 THEN 9.5 ELSE 12.0 END::DOUBLE AS height, greatest(l_quantity / length(CASE WHEN l_partkey % 5 = 1 THEN 'Day: Monday' ELSE str END), 2) AS char_width, sp AS space_before FROM b WHERE str <> ' ' AND n = 6""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-1, STR-9: an order is a page of text items."""
    k = F.col("l_partkey")
    transform = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(-12.0), F.col("l_quantity") * 3, F.col("l_discount") * 100)
    items = sequenced(spark, sf_dir, "l_quantity", "l_discount").select(
        "l_orderkey", F.col("seq").cast("int").alias("item_seq"), F.when(k % 5 == 0, F.lit(" ")).when(k % 5 == 1, F.lit("Day:Monday")).otherwise(F.concat(F.lit("w"), k.cast("string"))).alias("str"), F.when(k % 7 == 0, F.slice(transform, 1, 4)).otherwise(transform).alias("transform"),
        F.col("l_quantity").alias("width"), F.when(F.col("l_linenumber") % 2 == 0, F.lit(9.5)).alias("height"), F.lit("f").alias("font_name"),
    )
    return layout.text_items(items, ("l_orderkey",)).select("l_orderkey", "item_seq", "text", "x", "y", "height", "char_width", "space_before")


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS id, p_partkey // 4 AS based, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS head, CASE p_size % 7 WHEN 0 THEN true WHEN 1 THEN false END AS band FROM part),
c AS (SELECT id AS style_id, id AS at, based, 0 AS d FROM s UNION ALL SELECT c.style_id, s.id, s.based, c.d + 1 FROM c JOIN s ON s.id = c.based AND c.based <> c.at), u AS (SELECT p_partkey AS use_id, p_partkey AS style_id, p_size % 2 = 0 AS h, p_size % 3 = 0 AS b FROM part),
v AS (SELECT use_id, d, 0 AS r, bold AS x FROM u JOIN c USING (style_id) JOIN s ON s.id = c.at UNION ALL SELECT use_id, d, 1, band FROM u JOIN c USING (style_id) JOIN s ON s.id = c.at WHERE b UNION ALL SELECT use_id, d, 2, head FROM u JOIN c USING (style_id) JOIN s ON s.id = c.at WHERE h)
SELECT use_id, min_by(x, d * 10 - r) FILTER (WHERE x IS NOT NULL) AS bold FROM v GROUP BY 1""")
def table_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-6: cells with a banded and a header part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    tri = lambda m: F.when(size % m == 0, F.lit(True)).when(size % m == 1, F.lit(False))
    part = table(spark, sf_dir, "part").withColumn("doc_id", F.lit(1))
    styles = part.select("doc_id", k.alias("style_id"), F.floor(k / 4).alias("based_on"), tri(3).alias("bold"))
    conditional = part.select("doc_id", k.alias("style_id"), F.lit("firstRow").alias("part"), tri(5).alias("bold")).unionByName(part.select("doc_id", k.alias("style_id"), F.lit("band1Horz").alias("part"), tri(7).alias("bold")))
    uses = part.select("doc_id", k.alias("use_id"), k.alias("style_id"), F.array_compact(F.array(F.when(size % 2 == 0, F.lit("firstRow")), F.when(size % 3 == 0, F.lit("band1Horz")))).alias("parts"))
    return structure.table_traits(uses, styles, conditional, ("band1Horz", "firstRow"), ("bold",)).drop("doc_id")


@query("""
WITH p AS (SELECT p_partkey, p_name, p_size % 3 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '<del>' || p_name || '</del> <ins>&amp;</ins> x' WHEN 1 THEN p_name || ' <ins>&amp;</ins> x' ELSE '<ins>' || p_name || '</ins> <ins>&amp;</ins> x' END AS html, CASE k WHEN 0 THEN '& x' ELSE p_name || ' & x' END AS after, 'change-' || (p_partkey % 10 + 1) AS change_id FROM p""")
def rendered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-9, STR-25, AGG-10, SRC-9 acceptance."""
    k = F.col("p_size") % 3
    op = lambda t, x: F.struct(t.alias("type"), x.alias("text"))
    ops = F.array(op(F.when(k == 0, F.lit("del")).when(k == 1, F.lit("same")).otherwise(F.lit("add")), F.col("p_name")), op(F.lit("add"), F.lit("&")), op(F.lit("same"), F.lit("x")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("doc_id"), diff.rendered(ops).alias("html"), diff.accepted(ops).alias("after"))
    return markup.numbered_changes(rows, ("doc_id",), "p_partkey").drop("doc_id")


@query("""
WITH p AS (SELECT p_partkey, p_size, p_brand FROM part)
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'align-left,size-88' WHEN p_size % 4 = 1 THEN 'size-88' ELSE '' END AS classes, CASE p_size % 3 WHEN 0 THEN 'inline-right' WHEN 1 THEN 'block' ELSE 'inline-left' END AS layout, CAST(CASE WHEN p_size % 5 = 0 THEN 100 ELSE greatest(25, least(100, floor(p_size * 3 / 5.0 + 0.5) * 5)) END AS INTEGER) AS width,
 CASE p_size % 3 WHEN 1 THEN 'figure' ELSE 'image' END AS shown_on, CASE WHEN p_size % 2 = 0 THEN 'data:image/png;base64,' || to_base64(encode(p_brand)) END AS src, least(2.5, greatest(1.0, p_size / 10.0))::DOUBLE AS scale FROM p""")
def presentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-2, TRE-6, MTH-7, SRC-13, SRC-14."""
    size = F.col("p_size")
    classes = F.when(size % 4 == 0, F.array(F.lit("align-left"), F.lit("evil"), F.lit("size-88"))).when(size % 4 == 1, F.array(F.lit("size-88"), F.lit("x"))).otherwise(F.array(F.lit("y")))
    p = markup.image_presentation(F.when(size % 3 == 0, F.lit("inline-right")).when(size % 3 == 1, F.lit("odd")), F.when(size % 5 == 0, F.lit(0)).otherwise(size * 3), size % 3 == 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(markup.allowed_classes(classes, "^(align|size)-"), ",").alias("classes"), p["layout"].alias("layout"), p["width"].alias("width"), p["on"].alias("shown_on"),
        markup.data_url(F.when(size % 2 == 0, F.lit("image/png")).otherwise(F.lit("text/css")), F.col("p_brand").cast("binary")).alias("src"), markup.raster_scale(size / 10).alias("scale"),
    )


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, {_SEQ} AS seq, l_partkey % 4 AS k FROM lineitem), r AS (SELECT l_orderkey, seq, k IN (0, 1) AS shown, k IN (1, 2) AS brk, CASE WHEN k < 3 THEN k = 2 END AS counted FROM s)
SELECT l_orderkey, max(shown) AS visible, max(brk) AND NOT max(shown) AS only_breaks, coalesce(min_by(counted, seq) FILTER (WHERE counted IS NOT NULL), false) AS starts_with_break, coalesce(max_by(counted, seq) FILTER (WHERE counted IS NOT NULL), false) AS ends_with_break FROM r GROUP BY 1""")
def run_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-13, FLT-15: an order is a paragraph of runs."""
    k = F.col("l_partkey") % 4
    runs = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").alias("r_seq"), F.when(k == 0, F.lit("x")).otherwise(F.lit(" ")).alias("text"), F.when(k == 1, 1).otherwise(0).alias("drawings"), k.isin(1, 2).alias("page_break"))
    return structure.run_breaks(runs, ("l_orderkey",))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_size % 2 AS k FROM part) SELECT p_partkey, 1 AS r_seq, CAST(0 AS INTEGER) AS part_no, p_brand AS text, false AS complex, false AS is_break FROM p UNION ALL SELECT p_partkey, 1, 1, chr(10), false, true FROM p UNION ALL SELECT p_partkey, 1, 2, CASE k WHEN 0 THEN 'b' ELSE chr(1513) END, k = 1, false FROM p UNION ALL SELECT p_partkey, 1, 3, 'c', false, false FROM p WHERE k = 1""")
def split_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-4: runs at breaks and changes of script."""
    text = F.concat(F.col("p_brand"), F.lit("\n"), F.when(F.col("p_size") % 2 == 0, F.lit("b")).otherwise(F.lit("שc")))
    return structure.split_runs(table(spark, sf_dir, "part").select("p_partkey", F.lit(1).alias("r_seq"), text.alias("text")), ("p_partkey",))


@query()
def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-18, SEQ-12, JN-1: lines of documents, every third marked as an item, against a plan of every fifth."""
    n = F.col("line_no")
    lines = doc_lines(spark, sf_dir).select("doc_id", n.cast("long").alias("seq"), F.when(n % 3 == 0, F.concat(F.lit("1. "), "line")).when(n % 3 == 1, F.concat(F.lit("a) "), "line")).otherwise(F.col("line")).alias("text"))
    plan = lines.where("seq % 5 = 2").select("doc_id", F.col("seq").alias("plan_seq"), X.match_key(F.col("text")).alias("text_key"), F.lit("bullet").alias("format"), F.lit(0).alias("level"))
    return structure.normalized_lists(lines, plan)


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, {_SEQ} AS seq FROM lineitem), n AS (SELECT l_orderkey, seq, CASE WHEN seq = 1 THEN 'div' WHEN seq = 2 AND l_orderkey % 2 = 0 THEN 'table' WHEN l_partkey % 5 = 0 THEN 'hr' WHEN l_partkey % 5 = 1 THEN 'img' ELSE 'p' END AS tag, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'T' || l_partkey END AS t FROM s),
k AS (SELECT *, CASE WHEN tag = 'hr' THEN 'break' WHEN l_orderkey % 2 = 0 AND seq > 2 THEN NULL WHEN tag = 'table' THEN 'table' WHEN tag = 'img' THEN 'image' WHEN tag = 'p' AND t <> '' THEN 'text' END AS type FROM n)
SELECT l_orderkey, CAST(seq AS INTEGER) AS seq, type, type || ':' || lower(t) AS key FROM k WHERE type IS NOT NULL""")
def layout_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: an order is a tree whose second node holds all later ones."""
    k, seq = F.col("l_partkey"), F.col("seq")
    table_in = (F.col("l_orderkey") % 2 == 0)
    tag = F.when(seq == 1, F.lit("div")).when((seq == 2) & table_in, F.lit("table")).when(k % 5 == 0, F.lit("hr")).when(k % 5 == 1, F.lit("img")).otherwise(F.lit("p"))
    path = F.when(seq == 1, F.array(F.lit(1))).when(seq == 2, F.array(F.lit(1), F.lit(2))).when(table_in, F.array(F.lit(1), F.lit(2), seq)).otherwise(F.array(F.lit(1), seq))
    nodes = sequenced(spark, sf_dir).select("l_orderkey", seq.cast("int").alias("node_id"), path.alias("path"), seq.cast("int").alias("seq"), tag.alias("tag"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("text"))
    return structure.entries(nodes, ("l_orderkey",))


@query(f"""
WITH s AS (SELECT l_orderkey, l_quantity, l_partkey, {_SEQ} AS seq FROM lineitem) SELECT l_orderkey, CAST(seq AS INTEGER) AS line_no, CASE WHEN l_partkey % 6 = 0 THEN 3 END AS space_lines, CASE WHEN l_partkey % 6 = 0 THEN 2 ELSE 0 END + 1 AS height FROM s""")
def line_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8: a sparse join of writing spaces by line."""
    lines = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("line_no"), "l_partkey")
    spaces = lines.where("l_partkey % 6 = 0").select("l_orderkey", "line_no", F.lit(3).alias("space_lines"))
    return lines.join(spaces, ["l_orderkey", "line_no"], "left").select("l_orderkey", "line_no", "space_lines", F.when(F.col("space_lines").isNotNull(), 3).otherwise(1).alias("height"))


@query("""
WITH c AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)), f AS (SELECT doc_id, substring(line, 1, 48) AS prefix FROM c WHERE no = 2)
SELECT f.doc_id, CAST(min(no) AS INTEGER) AS line_no FROM f JOIN c ON c.doc_id = f.doc_id AND contains(c.line, f.prefix) GROUP BY 1""")
def change_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15: the first line that holds the beginning of a change, here of each document's second line."""
    lines = doc_lines(spark, sf_dir).withColumn("no", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no")))
    prefix = lines.where("no = 2").select("doc_id", F.substring("line", 1, 48).alias("prefix"))
    return lines.join(prefix, "doc_id").where(F.contains("line", "prefix")).groupBy("doc_id").agg(F.min("no").alias("line_no"))
