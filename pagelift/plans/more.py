"""Further registered queries: columns of pages, paragraphs, numbering, tables, scripts, diff parts, outlines, settings of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import diff, images, layout, package, structure
from ..sources import documents as S
from .catalog import _SEQ, _WS, doc_lines, query, sequenced, table


@query("""
WITH i AS (SELECT p_partkey // 40 AS page, p_partkey % 40 AS n, p_size FROM part), t AS (SELECT page, n, CASE WHEN n % 2 = 0 THEN 72.0 ELSE 330.0 END AS x, CAST(800 - 18 * (n // 2) - p_size % 19 AS DOUBLE) AS y, CASE WHEN page % 3 < 2 THEN 150.0 + p_size ELSE 150.0 + 3 * p_size END AS width, count(*) OVER (PARTITION BY page) AS n_items FROM i),
c AS (SELECT *, x < 201 AS l, x < 201 AND x + width > 330 - 596 * 0.008 AS crosses FROM t WHERE n_items >= 14),
b AS (SELECT page, l, list_reduce(list(y ORDER BY n), lambda acc, v: CASE WHEN len(list_filter(acc, lambda w: abs(w - v) <= 3)) > 0 THEN acc ELSE list_append(acc, v) END, CAST([] AS DOUBLE[])) AS ys FROM c GROUP BY page, l),
d AS (SELECT page, max(CASE WHEN l THEN len(ys) END) AS ll, max(CASE WHEN NOT l THEN len(ys) END) AS rl, max(CASE WHEN l THEN list_max(ys) - list_min(ys) END) AS ls, max(CASE WHEN NOT l THEN list_max(ys) - list_min(ys) END) AS rs FROM b GROUP BY page),
a AS (SELECT page, count(*) FILTER (WHERE crosses) AS nc, coalesce(sum(CASE WHEN crosses THEN 10 END), 0) AS ct, coalesce(sum(CASE WHEN l THEN 10 END), 0) AS lt FROM c GROUP BY page)
SELECT page, CAST(201.0 AS DOUBLE) AS split, 258.0 + 4 * least(ll, rl) + 40 * (least(ls, rs) / 842.0) AS score FROM a JOIN d USING (page) WHERE least(ll, rl) >= 7 AND least(ls, rs) / 842.0 >= 0.38 AND NOT (nc >= 3 AND ct > 0.2 * lt)""")
def reading_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-4, SEQ-5, JN-10, AGG-15, SRT-4: pages of 40 parts in two columns, whose baselines come close to one another in no order."""
    n, page, size = F.col("p_partkey") % 40, F.floor(F.col("p_partkey") / 40), F.col("p_size")
    items = table(spark, sf_dir, "part").select(page.alias("page"), n.alias("item_seq"), F.when(n % 2 == 0, F.lit(72.0)).otherwise(F.lit(330.0)).alias("x"), (800 - 18 * F.floor(n / 2) - size % 19).cast("double").alias("y"), F.when(page % 3 < 2, 150.0 + size).otherwise(150.0 + 3 * size).alias("width"), F.lit("ten letter").alias("text"))
    return layout.reading_columns(items, 596.0, 842.0, ("page",))


@query(f"""
WITH s AS (SELECT l_orderkey, l_quantity, l_suppkey, l_extendedprice, {_SEQ} AS seq FROM lineitem), c AS (SELECT l_orderkey, seq // 3 AS line_no, l_extendedprice % 300 AS x, l_extendedprice % 300 + l_quantity AS e, seq, l_suppkey FROM s),
r AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey, line_no ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(e) OVER (PARTITION BY l_orderkey, line_no ORDER BY x, seq) AS prev FROM c),
k AS (SELECT *, sum(CASE WHEN x - reach > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, line_no ORDER BY x, seq) AS col FROM r), t AS (SELECT l_orderkey, line_no, count(*) >= 3 AND count(*) FILTER (WHERE x - prev > 18) >= 2 AS tabular FROM r GROUP BY 1, 2)
SELECT l_orderkey, line_no, CAST(col AS INTEGER) AS column_no, min(x) AS x, max(e) AS "end", string_agg(CAST(l_suppkey AS VARCHAR), ' ' ORDER BY x, seq) AS text, max(tabular) AS tabular FROM k JOIN t USING (l_orderkey, line_no) GROUP BY 1, 2, 3""")
def line_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-6, FLT-3: cells of lines into columns."""
    x = F.col("l_extendedprice") % 300
    cells = sequenced(spark, sf_dir, "l_quantity").select("l_orderkey", F.floor(F.col("seq") / 3).alias("line_no"), F.col("seq").alias("cell_no"), x.alias("x"), (x + F.col("l_quantity")).alias("end"), F.lit(4.0).alias("char_width"), F.col("l_suppkey").cast("string").alias("text"))
    keys = ("l_orderkey", "line_no")
    return layout.line_columns(cells, keys).join(layout.tabular_lines(cells, keys), list(keys))


@query(f"""
WITH s AS (SELECT l_orderkey, l_quantity, l_partkey, {_SEQ} AS seq FROM lineitem), r AS (SELECT l_orderkey, seq AS line_no, l_partkey % 4 <> 0 AS two, 800 - 14 * seq - CASE WHEN l_partkey % 11 = 0 THEN 40 ELSE 0 END AS y, 200 + l_quantity AS x FROM s),
b AS (SELECT *, CASE WHEN two AND lag(two) OVER w AND lag(y) OVER w - y <= 28.8 THEN 0 ELSE 1 END AS broken FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY line_no)), u AS (SELECT *, sum(broken) OVER (PARTITION BY l_orderkey ORDER BY line_no) AS run FROM b),
m AS (SELECT *, median(x) OVER (PARTITION BY l_orderkey, run) AS mid, count(*) OVER (PARTITION BY l_orderkey, run) AS n FROM u WHERE two), z AS (SELECT *, min(abs(x - mid) <= 20) OVER (PARTITION BY l_orderkey, run) AS near FROM m)
SELECT l_orderkey, line_no FROM z WHERE n >= 3 AND near""")
def stable_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-9, FLT-4."""
    k = F.col("l_partkey")
    lines = sequenced(spark, sf_dir, "l_quantity").select(
        "l_orderkey", F.col("seq").cast("long").alias("line_no"), (k % 4 != 0).alias("two"), (800 - 14 * F.col("seq") - F.when(k % 11 == 0, 40).otherwise(0)).cast("double").alias("y"), (200 + F.col("l_quantity")).alias("second_x"),
        F.lit(12.0).alias("line_height"), F.lit(4.0).alias("char_width"),
    )
    return layout.stable_columns(lines, ("l_orderkey",))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), i AS (SELECT doc_id, n, trim(t) AS t, 800.0 - 14 * n - 30 * (n // 9) AS y, 72.0 + n % 5 * 3 AS x, 72.0 + n % 5 * 3 + least(length(t) * 4, 440) AS e FROM l),
p AS (SELECT *, lag(t) OVER w AS lt, lag(y) OVER w AS ly, lag(x) OVER w AS lx, lag(e) OVER w AS le FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT doc_id, n, CASE WHEN ly IS NULL OR ly - y > 1.72 * 12 OR regexp_matches(t, '^(?:[•●▪◦‣∙·]|\\(?[0-9A-Za-z]{1,3}[.)])\\s+\\S') OR t = '' OR lt = '' THEN true WHEN regexp_matches(t, '^[a-z,;)]') OR regexp_matches(lt, '[,;:(-]$') OR (le - lx) / 450 >= 0.74 THEN false
 WHEN regexp_matches(lt, '[.!?]["''”’)]?$') AND regexp_matches(t, '^["''“‘(]?[A-Z]') AND ((le - lx) / 450 < 0.68 OR abs(x - lx) / 4 >= 2.5) THEN true ELSE false END AS breaks FROM p)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, breaks, CAST(sum(CASE WHEN breaks THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS paragraph_no FROM b""".replace("\\\\", "\\"))
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5, FLT-6, SEQ-8: lines of documents as positioned lines."""
    n = F.col("line_no")
    x = 72.0 + n % 5 * 3
    lines = doc_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.col("line").alias("text"), (800.0 - 14 * n - 30 * F.floor(n / 9)).alias("y"), x.alias("x_start"), (x + F.least(F.length("line") * 4, F.lit(440))).alias("x_end"), F.lit(12.0).alias("line_height"),
        F.lit(4.0).alias("char_width"), F.lit("serif").alias("family"), F.lit(11.0).alias("size"),
    )
    return layout.paragraph_breaks(lines, 14.0, 450.0, ("doc_id",)).select("doc_id", "line_no", "breaks", "paragraph_no")


@query("""
WITH p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_suppkey * 3 // 2 AS num_id, l_linenumber % 4 AS ilvl FROM lineitem), n AS (SELECT s_suppkey AS num_id, s_suppkey % 5 AS abstract_id FROM supplier),
v AS (SELECT k AS abstract_id, l AS ilvl, CASE (k + l) % 4 WHEN 0 THEN 'lowerLetter' WHEN 1 THEN 'bullet' WHEN 2 THEN 'decimal' ELSE 'upperRoman' END AS format, '%' || (l + 1) || '.' AS txt FROM range(4) a(k), range(3) b(l))
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, coalesce(o.format, z.format, 'decimal') AS format, coalesce(o.txt, z.txt) AS level_text FROM p LEFT JOIN n USING (num_id) LEFT JOIN v o ON o.abstract_id = n.abstract_id AND o.ilvl = p.ilvl LEFT JOIN v z ON z.abstract_id = n.abstract_id AND z.ilvl = 0""")
def numbering_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-4, STR-21."""
    paragraphs = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.floor(F.col("l_suppkey") * 3 / 2).alias("num_id"), (F.col("l_linenumber") % 4).cast("long").alias("ilvl"))
    nums = table(spark, sf_dir, "supplier").select(F.lit(1).alias("doc_id"), F.col("s_suppkey").alias("num_id"), (F.col("s_suppkey") % 5).alias("abstract_id"))
    kinds = F.array(*[F.lit(k) for k in ("lowerLetter", "bullet", "decimal", "upperRoman")])
    levels = spark.range(4).select(F.col("id").alias("abstract_id"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("ilvl"))
    levels = levels.select(F.lit(1).alias("doc_id"), "abstract_id", "ilvl", F.get(kinds, ((F.col("abstract_id") + F.col("ilvl")) % 4).cast("int")).alias("format"), F.concat(F.lit("%"), (F.col("ilvl") + 1).cast("string"), F.lit(".")).alias("level_text"))
    return structure.numbered(paragraphs, nums, levels).select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "format", "level_text")


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, {_SEQ} AS seq FROM lineitem), b AS (SELECT l_orderkey, seq, l_partkey % 3 = 0 AS brk, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS n FROM s WHERE seq > 1),
p AS (SELECT l_orderkey, seq, sum(CASE WHEN brk AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY seq) AS part FROM b)
SELECT l_orderkey, CAST(seq AS INTEGER) AS row_no, CAST(part AS INTEGER) AS part FROM p UNION ALL SELECT DISTINCT l_orderkey, 1, CAST(part AS INTEGER) FROM p""")
def table_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-20: an order is a table whose first row is its header."""
    rows = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("row_no"), (F.col("seq") == 1).alias("is_header"), (F.col("l_partkey") % 3 == 0).alias("break_before"))
    return structure.split_tables(rows, ("l_orderkey",)).select("l_orderkey", "row_no", "part")


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, {_SEQ} AS seq, l_partkey % 3 = 0 AS blk, CASE WHEN l_partkey % 4 = 1 THEN '' ELSE 'x' || l_partkey END AS t FROM lineitem),
r AS (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY seq) AS run FROM (SELECT *, CASE WHEN blk OR coalesce(lag(blk) OVER (PARTITION BY l_orderkey ORDER BY seq), true) THEN 1 ELSE 0 END AS f FROM s)), g AS (SELECT l_orderkey, min(seq) AS seq, max(blk) AS is_block, string_agg(t, '' ORDER BY seq) AS text FROM r GROUP BY l_orderkey, run)
SELECT l_orderkey, CAST(seq AS INTEGER) AS seq, is_block, text FROM g WHERE is_block OR text <> ''""")
def wrapped_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-19."""
    k = F.col("l_partkey")
    nodes = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("seq"), (k % 3 == 0).alias("is_block"), F.when(k % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("x"), k.cast("string"))).alias("text"))
    return structure.wrapped_inline(nodes, ("l_orderkey",))


@query("""
WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN 'Courier' WHEN 1 THEN 'Times' ELSE 'Arial' END AS family, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem), w AS (SELECT l_orderkey, family, sum(length(CAST(l_partkey AS VARCHAR))) AS weight, min(seq) AS first FROM s GROUP BY 1, 2)
SELECT l_orderkey, family FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, first) AS r FROM w) WHERE r = 1""")
def dominant_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4, SRT-5, SET-4."""
    family = F.when(F.col("l_linenumber") % 3 == 0, F.lit("Courier")).when(F.col("l_linenumber") % 3 == 1, F.lit("Times")).otherwise(F.lit("Arial"))
    runs = sequenced(spark, sf_dir).select("l_orderkey", family.alias("family"), F.col("l_partkey").cast("string").alias("text"), F.col("seq").alias("run_no"))
    return layout.dominant_family(runs, ("l_orderkey",))


@query("""
WITH o AS (SELECT l_orderkey, l_suppkey % 4 AS object_id, l_partkey, l_suppkey, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS op_seq, l_linenumber % 5 AS f FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, object_id ORDER BY op_seq) AS r FROM o WHERE f < 4)
SELECT l_orderkey, object_id, CAST(op_seq AS INTEGER) AS op_seq FROM k WHERE r = 1 AND l_quantity * 4 >= 24 AND l_quantity * 3 >= 24 AND l_quantity * 4 * l_quantity * 3 >= 2048""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10, SRC-11."""
    kinds = F.array(*[F.lit(k) for k in ("paintImageXObject", "paintJpegXObject", "paintImageXObjectRepeat", "paintInlineImageXObject", "fill")])
    ops = sequenced(spark, sf_dir, "l_quantity").select("l_orderkey", (F.col("l_suppkey") % 4).alias("object_id"), F.col("seq").cast("int").alias("op_seq"), F.get(kinds, F.col("l_linenumber") % 5).alias("fn"), (F.col("l_quantity") * 4).alias("width"), (F.col("l_quantity") * 3).alias("height"))
    return layout.page_images(ops, ("l_orderkey",)).select("l_orderkey", "object_id", "op_seq")


@query("""
WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'abc ' || chr(1513) || chr(1500) || ' x' WHEN 1 THEN ' ' || p_brand WHEN 2 THEN chr(1513) || ' ' ELSE p_brand || chr(2309) END AS t, p_size % 4 AS k, p_brand FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'abc |' || chr(1513) || chr(1500) || ' |x' WHEN 1 THEN t WHEN 2 THEN t ELSE p_brand || '|' || chr(2309) END AS parts, CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS n_complex FROM p""")
def script_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-17, STR-23."""
    k = F.col("p_size") % 4
    text = F.when(k == 0, F.lit("abc של x")).when(k == 1, F.concat(F.lit(" "), "p_brand")).when(k == 2, F.lit("ש ")).otherwise(F.concat("p_brand", F.lit("अ")))
    s = X.script_segments(text)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(s, lambda x: x["text"]), "|").alias("parts"), F.size(F.filter(s, lambda x: x["complex"])).alias("n_complex"))


@query(f"""
WITH s AS (SELECT l_orderkey, {_SEQ} AS seq, CASE l_partkey % 9 WHEN 0 THEN 'add' WHEN 1 THEN 'del' ELSE 'same' END AS type, CAST(l_partkey AS VARCHAR) AS text FROM lineitem),
n AS (SELECT *, max(type <> 'same') OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM s), f AS (SELECT *, CASE WHEN near OR coalesce(lag(near) OVER (PARTITION BY l_orderkey ORDER BY seq), true) THEN 1 ELSE 0 END AS fresh FROM n), r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY seq) AS run FROM f)
SELECT l_orderkey, CAST(min(seq) AS INTEGER) AS seq, CASE WHEN max(near) THEN min_by(type, seq) ELSE 'ellipsis' END AS type, CASE WHEN max(near) THEN min_by(text, seq) ELSE '…' END AS text FROM r GROUP BY l_orderkey, run""")
def diff_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-14."""
    k = F.col("l_partkey") % 9
    ops = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("seq"), F.when(k == 0, F.lit("add")).when(k == 1, F.lit("del")).otherwise(F.lit("same")).alias("type"), F.col("l_partkey").cast("string").alias("text"))
    return diff.with_context(ops, ("l_orderkey",))


@query("""
WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS b1, p_size % 3 = 0 AS b2, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'left' END AS a1, CASE WHEN p_size % 5 = 0 THEN 'right' ELSE 'left' END AS a2 FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN b1 <> b2 THEN 'bold: ' || CAST(b1 AS VARCHAR) || ' to ' || CAST(b2 AS VARCHAR) END, CASE WHEN a1 IS DISTINCT FROM a2 THEN 'alignment: ' || coalesce(a1, 'none') || ' to ' || a2 END], lambda x: x IS NOT NULL), '; ') AS told FROM p""")
def format_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-3, DIF-4, STR-25."""
    size = F.col("p_size")
    both = table(spark, sf_dir, "part").select(
        "p_partkey", F.struct((size % 2 == 0).alias("bold"), F.when(size % 4 != 0, F.lit("left")).alias("alignment")).alias("a"), F.struct((size % 3 == 0).alias("bold"), F.when(size % 5 == 0, F.lit("right")).otherwise(F.lit("left")).alias("alignment")).alias("b"),
    )
    return both.select("p_partkey", F.array_join(diff.described_changes("a", "b", ("bold", "alignment")), "; ").alias("told"))


@query(rf"""
WITH p AS (SELECT p_partkey, '<p>' || p_name || ' & ' || p_brand || '<br>' || chr(160) || '1 < 2 &amp; <IMG src="a&amp;b' || p_size || '"><img src=''c''></p><p>x</p>' AS h, p_name, p_brand, p_size FROM part)
SELECT p_partkey, '<p>' || p_name || ' &amp; ' || p_brand || '<br/>&#160;1 &lt; 2 &amp; <IMG src="a&amp;b' || p_size || '"/><img src=''c''/></p><p>x</p>' AS xhtml, replace(h, '</p><p>', '</p>' || chr(10) || '<p>') AS pretty, 'a&b' || p_size || '|c' AS sources, len(regexp_extract_all(h, '(?i)<p\b')) AS n_p FROM p""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5, STR-16, STR-17, STR-18, SRC-8."""
    h = F.concat(F.lit("<p>"), "p_name", F.lit(" & "), "p_brand", F.lit('<br> 1 < 2 &amp; <IMG src="a&amp;b'), F.col("p_size").cast("string"), F.lit("\"><img src='c'></p><p>x</p>"))
    return table(spark, sf_dir, "part").select("p_partkey", X.xhtml_fragment(h).alias("xhtml"), X.pretty_html(h).alias("pretty"), F.array_join(X.image_sources(h), "|").alias("sources"), F.regexp_count(h, F.lit(r"(?i)<p\b")).cast("long").alias("n_p"))


@query("""
WITH a AS (SELECT p_partkey // 20 AS doc_id, p_partkey % 20 AS img_no, CASE WHEN p_size % 5 = 0 THEN 'https://example.com/x.png' ELSE 'data:image/png,' || p_size % 7 END AS src FROM part), f AS (SELECT doc_id, src, min(img_no) AS first FROM a WHERE src LIKE 'data:%' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS k FROM f)
SELECT a.doc_id, img_no, CAST(k AS INTEGER) AS asset_no, 'image-' || k || '.png' AS file_name FROM a LEFT JOIN n ON a.doc_id = n.doc_id AND a.src = n.src""")
def image_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-3, JN-14."""
    size = F.col("p_size")
    src = F.when(size % 5 == 0, F.lit("https://example.com/x.png")).otherwise(F.concat(F.lit("data:image/png,"), (size % 7).cast("string")))
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc_id"), (F.col("p_partkey") % 20).alias("img_no"), src.alias("src"), F.lit("image/png").alias("media_type"))
    return images.packaged(rows).select("doc_id", "img_no", "asset_no", "file_name")


@query("""
WITH p AS (SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE 'urn:' || o_orderkey END AS ident FROM orders), c AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_id, CASE WHEN n IS NULL THEN 'no chapter' ELSE 'no identifier' END AS problem FROM p LEFT JOIN c USING (doc_id) WHERE n IS NULL OR ident = ' '""")
def publication_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PKG-1."""
    pubs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_custkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("urn:"), F.col("o_orderkey").cast("string"))).alias("identifier"))
    return package.publication_violations(pubs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query(f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CAST(greatest(0, floor((l_quantity - 3) / 4 + 0.5)) AS INTEGER) AS spaces, CAST(CASE WHEN floor((l_quantity - 3) / 4 + 0.5) >= 9 THEN 3 WHEN floor((l_quantity - 3) / 4 + 0.5) >= 5 THEN 2 WHEN floor((l_quantity - 3) / 4 + 0.5) >= 2 THEN 1 ELSE 0 END AS INTEGER) AS level, CAST(greatest(1, ceil((l_extendedprice - 0.5) / 700)) AS BIGINT) AS pages,
 (l_partkey % 3 = 0) OR (l_partkey % 3 = 1 AND (l_suppkey & 32) <> 0) AS flag, CASE WHEN l_linenumber > 1 THEN least(8, l_linenumber * 2) END AS list_level, lower(CASE l_linenumber % 3 WHEN 0 THEN ' Always' WHEN 1 THEN 'auto' ELSE 'recto' END) IN (' always', 'recto') AS forced FROM lineitem""")
def layout_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-9, MTH-10, MAP-5, MAP-6, FLT-14."""
    q, k = F.col("l_quantity"), F.col("l_partkey") % 3
    indent = N.line_indent(q, F.lit(3.0), F.lit(4.0))
    info = N.list_info(F.when(F.col("l_linenumber") > 1, F.lit("7")), (F.col("l_linenumber") * 2).cast("string"))
    css = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" Always")).when(F.col("l_linenumber") % 3 == 1, F.lit("auto")).otherwise(F.lit("recto"))
    flag = N.look_flag(F.when(k == 0, F.lit(True)).when(k == 2, F.lit(False)), F.hex(F.col("l_suppkey")), 32)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", indent["spaces"].alias("spaces"), indent["level"].alias("level"), N.page_count(F.col("l_extendedprice"), F.lit(700)).alias("pages"), flag.alias("flag"), info["level"].alias("list_level"), X.forced_break(css).alias("forced"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_quantity, l_extendedprice, {_SEQ} AS seq FROM lineitem)
SELECT l_orderkey, min(72 + l_quantity) AS "left", max(200 + l_quantity) AS "right", min(l_extendedprice / 150) AS bottom, least(0.8, greatest(0, (842 - max(l_extendedprice / 150 + 10)) / 842)) AS top_ratio, least(0.92, greatest(0.2, min(l_extendedprice / 150) / 842)) AS remaining_ratio,
 CASE WHEN least(0.8, greatest(0, (842 - max(l_extendedprice / 150 + 10)) / 842)) < 0.28 THEN 'top' WHEN least(0.8, greatest(0, (842 - max(l_extendedprice / 150 + 10)) / 842)) < 0.64 THEN 'middle' ELSE 'bottom' END AS start_zone, CAST(least(8, greatest(0, floor(least(0.8, greatest(0, (842 - max(l_extendedprice / 150 + 10)) / 842)) * 16 + 0.5))) AS INTEGER) AS offset_level FROM s GROUP BY 1""")
def page_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5."""
    q = F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (72 + q).alias("x_start"), (200 + q).alias("x_end"), (F.col("l_extendedprice") / 150).alias("y"), F.lit(10.0).alias("max_height"))
    return layout.page_extents(lines, 842.0, ("l_orderkey",))


@query(f"""
WITH RECURSIVE s AS (SELECT l_orderkey, {_SEQ} AS seq, l_extendedprice - floor(l_extendedprice / 50) * 50 AS y, l_quantity AS x FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, x, seq) AS n FROM s),
g AS (SELECT *, 0 AS row_no, y AS row_y FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN row_y - o.y <= 3 THEN row_no ELSE row_no + 1 END, CASE WHEN row_y - o.y <= 3 THEN row_y ELSE o.y END FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.n = g.n + 1)
SELECT l_orderkey, CAST(seq AS BIGINT) AS item_seq, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no, x, seq) AS INTEGER) AS rank FROM g""")
def item_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-21, SRT-1: items in reading order."""
    price = F.col("l_extendedprice")
    items = sequenced(spark, sf_dir, "l_quantity").select("l_orderkey", F.col("seq").cast("long").alias("item_seq"), (price - F.floor(price / 50) * 50).alias("y"), F.col("l_quantity").alias("x"))
    return layout.ordered_items(items, 3.0, ("l_orderkey",)).select("l_orderkey", "item_seq", "rank")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), t AS (SELECT doc_id, n, CASE WHEN n % 5 = 0 THEN '## ' || line ELSE line END AS t FROM l)
SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(len(regexp_extract_all(t, '[^{_WS[1:]}+')) AS INTEGER) AS n_tokens, CASE WHEN n % 5 = 0 THEN 'H2:' ELSE coalesce(regexp_extract_all(t, '[^{_WS[1:]}+')[1], '') END AS first FROM t""")
def diff_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, FLT-16, STR-29."""
    tokens = X.diff_tokens(F.when(F.col("line_no") % 5 == 0, F.concat(F.lit("## "), "line")).otherwise(F.col("line")))
    return doc_lines(spark, sf_dir).select("doc_id", "line_no", F.size(tokens).alias("n_tokens"), F.coalesce(F.get(tokens, F.lit(0)), F.lit("")).alias("first"))


@query()
def list_plan_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-1, FLT-17: blocks of an order against a plan of every second, by supplier as key."""
    s = sequenced(spark, sf_dir).select("l_orderkey", "seq", F.concat(F.lit("item of supplier "), (F.col("l_suppkey") % 5).cast("string")).alias("text_key"))
    return structure.planned(s, s.where("seq % 2 = 0").withColumnRenamed("seq", "plan_seq"), ("l_orderkey",))


@query()
def spacing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-2: writing spaces onto blocks whose keys repeat."""
    s = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("long").alias("seq"), (F.col("l_suppkey") % 3).cast("string").alias("text_key"))
    follows = F.lead("text_key").over(W.partitionBy("l_orderkey").orderBy("seq"))
    plan = s.withColumn("next_key", follows).where("seq % 3 = 1").select("l_orderkey", F.col("seq").alias("after_seq"), F.col("text_key").alias("after_key"), "next_key", F.lit(3).alias("lines"))
    return structure.spaced(s, plan, ("l_orderkey",))


@query()
def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, AGG-11, AGG-12, TRE-1: per page its blocks by kind, words, headings, and one observation."""
    blocks = S.html_blocks(table(spark, sf_dir, "pages"), ("page_id",))
    out = blocks.groupBy("page_id").agg(F.count_if(F.col("tag") == "p").alias("paragraphs"), F.count_if(F.col("tag").rlike("^h[1-6]")).alias("headings"), F.count_if(F.col("tag") == "img").alias("images"), F.sum(X.word_count(F.col("text"))).alias("words"))
    return out.withColumn("observation", F.when(F.col("words") == 0, F.lit("blank")).when(F.col("images") > 0, F.lit("images kept")).otherwise(F.lit("ready"))).withColumn("words_shown", F.format_number("words", 0))
