"""Registered queries over the supplied tables, each with the SQL that its rows are held against.

The tables hold few of the inputs that the operators are for, so most queries derive theirs (page items from line items, styles from parts); the SQL derives
them in the same way. Queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import diff, images, layout, package, structure
from ..sources import documents as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The white space class in the oracles' dialect.
_WS = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_SEQ = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def sequenced(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *columns)
    return items.withColumn("seq", F.row_number().over(order))


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(line, '[^{_WS[1:]}+'))) AS BIGINT) AS n_words, count(*) FILTER (WHERE regexp_matches(line, '^{_WS}*[A-Z][.)]{_WS}+')) AS n_letter_items,
 CAST(sum(length(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS n_escaped FROM l GROUP BY doc_id""")
def doc_line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6, AGG-1, STR-1, STR-13: a profile of every document's lines."""
    line = F.col("line")
    return doc_lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum(X.word_count(line)).alias("n_words"), F.count_if(X.list_marker(line)["format"] == "upperLetter").alias("n_letter_items"),
        F.sum(F.length(X.escape_html(line)).cast("long")).alias("n_escaped"),
    )


@query("""
WITH d AS (SELECT doc_id, replace(replace(text, chr(10), chr(10) || chr(10)), '. ', '.' || chr(12)) AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(t, chr(12))) AS body, generate_subscripts(string_split(t, chr(12)), 1) - 1 AS page FROM d),
b AS (SELECT doc_id, page, unnest(string_split(body, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS i FROM p),
c AS (SELECT doc_id, page, i, regexp_replace(raw, '\\s+$', '') AS text FROM b)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS INTEGER) AS block, text FROM c WHERE text <> ''""".replace("\\\\", "\\"))
def doc_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-6: pages and blocks of plain text; sentence ends are made form feeds, line feeds doubled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit(". "), F.lit(".\f")).alias("text"))
    return S.plain_text(docs)


@query("""
WITH t AS (SELECT doc_id, replace(replace(replace(text, 'a ', '<a '), 'e ', 'e" '), 'n ', chr(1) || 'n'' ') AS t FROM documents), s AS (SELECT doc_id, replace(t, chr(1), '') AS t, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS h FROM t)
SELECT doc_id, md5(h) AS html, md5(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml FROM s""")
def doc_escape_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-2, STR-3, STR-4."""
    t = F.replace(F.replace(F.replace("text", F.lit("a "), F.lit("<a ")), F.lit("e "), F.lit('e" ')), F.lit("n "), F.lit("\x01n' "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.escape_html(t)).alias("html"), F.md5(X.escape_xml(t)).alias("xml"))


_PREFIX = ["• ", "- ", "1. ", "2) ", "a. ", "B) ", "i. ", "iv. ", "XI) ", "13:1 ", "33 A", ""]


@query("""
WITH p AS (SELECT p_partkey, p_size % 12 AS k, p_name FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'bullet' WHEN 1 THEN 'bullet' WHEN 2 THEN 'decimal' WHEN 3 THEN 'decimal' WHEN 4 THEN 'lowerLetter' WHEN 5 THEN 'upperLetter' WHEN 6 THEN 'lowerLetter' WHEN 7 THEN 'lowerRoman' WHEN 8 THEN 'upperRoman' END AS format,
 CAST(CASE WHEN k < 4 THEN 0 WHEN k < 7 THEN 1 WHEN k < 9 THEN 2 END AS INTEGER) AS level,
 CASE k WHEN 0 THEN '•' WHEN 1 THEN '-' WHEN 2 THEN '1.' WHEN 3 THEN '2)' WHEN 4 THEN 'a.' WHEN 5 THEN 'B)' WHEN 6 THEN 'i.' WHEN 7 THEN 'iv.' WHEN 8 THEN 'XI)' END AS marker, CASE WHEN k < 9 THEN p_name END AS body FROM p""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13."""
    prefix = F.get(F.array(*[F.lit(p) for p in _PREFIX]), F.col("p_size") % 12)
    return table(spark, sf_dir, "part").select("p_partkey", X.list_marker(F.concat(prefix, "p_name")).alias("m")).select("p_partkey", "m.format", "m.level", "m.marker", "m.body")


@query(rf"""
WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_extendedprice, CAST(l_linenumber AS VARCHAR) || CASE p_size % 4 WHEN 0 THEN ' ' WHEN 1 THEN '. ' WHEN 2 THEN ':' ELSE '.' END || p_name AS t, p_size % 4 AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CASE WHEN k IN (0, 3) THEN CAST(l_linenumber AS VARCHAR) END AS number, CASE WHEN k IN (0, 3) THEN regexp_replace(t, '^[0-9]+[.{_WS[1:-1]}]+', '') END AS rest FROM t""")
def verse_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sep = F.get(F.array(*[F.lit(s) for s in (" ", ". ", ":", ".")]), F.col("p_size") % 4)
    v = X.verse_marker(F.concat(F.col("l_linenumber").cast("string"), sep, "p_name"))
    return items.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", v["number"].alias("number"), v["rest"].alias("rest"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '## ' || p_name WHEN 2 THEN '- ' || p_name || chr(10) || '- ' || p_brand WHEN 3 THEN '1. ' || p_name WHEN 4 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' ELSE p_name END AS b, p_size % 6 AS k, p_name FROM part)
SELECT p_partkey, CAST(block AS INTEGER) AS block, type, CAST(level AS INTEGER) AS level, text FROM (
 SELECT p_partkey, 0 AS block, CASE WHEN k < 2 THEN 'heading' WHEN k < 4 THEN 'list' WHEN k = 4 THEN 'table' ELSE 'paragraph' END AS type, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 END AS level, CASE WHEN k < 2 THEN p_name ELSE b END AS text FROM p
 UNION ALL SELECT p_partkey, 1, 'break', NULL, '\\pagebreak' FROM p UNION ALL SELECT p_partkey, 2, 'paragraph', NULL, p_name FROM p)""".replace("\\\\", "\\"))
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, FLT-8, FLT-9."""
    k = F.col("p_size") % 6
    body = (
        F.when(k == 0, F.concat(F.lit("# "), "p_name")).when(k == 1, F.concat(F.lit("## "), "p_name")).when(k == 2, F.concat(F.lit("- "), "p_name", F.lit("\n- "), "p_brand")).when(k == 3, F.concat(F.lit("1. "), "p_name"))
        .when(k == 4, F.concat(F.lit("| a | b |\n|---|---|\n| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |"))).otherwise(F.col("p_name"))
    )
    return S.markdown(table(spark, sf_dir, "part").select("p_partkey", F.concat(body, F.lit("\f"), "p_name").alias("text")), ("p_partkey",))


@query("""
WITH p AS (SELECT p_partkey, '**' || p_name || '** and *' || p_brand || '* or `' || p_type || '` & <' || p_size || '>' AS t, p_name, p_brand, p_type, p_size FROM part)
SELECT p_partkey, '<strong>' || p_name || '</strong> and <em>' || p_brand || '</em> or <code>' || p_type || '</code> &amp; &lt;' || p_size || '&gt;' AS html, p_name || ',' || p_brand || ',' AS row1, CAST(2 AS INTEGER) AS n_items, p_size % 2 = 0 AS ordered FROM p""")
def markdown_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10, STR-11, STR-12."""
    text = F.concat(F.lit("**"), "p_name", F.lit("** and *"), "p_brand", F.lit("* or `"), "p_type", F.lit("` & <"), F.col("p_size").cast("string"), F.lit(">"))
    grid = F.concat(F.lit("|a|b|c|\n|-|-|-|\n|"), "p_name", F.lit("|"), "p_brand", F.lit("|"))
    mark = F.when(F.col("p_size") % 2 == 0, F.lit("1. ")).otherwise(F.lit("- "))
    items = X.list_block(F.concat(mark, "p_name", F.lit("\n* "), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", X.inline_markdown(text).alias("html"), F.array_join(F.get(X.markdown_table(grid)["body"], F.lit(0)), ",").alias("row1"), F.size(items["items"]).alias("n_items"), items["ordered"].alias("ordered"))


@query(rf"""
WITH t AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g'), '(?i)<br\b[^>]*>|</(?:p|div|h[1-6]|li|ul|ol|table|thead|tbody|tfoot|tr|td|th|blockquote|figure|figcaption|pre|section|article|header|footer|nav|aside|dl|dt|dd|hr)\s*>', ' ', 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS t FROM pages)
SELECT page_id, CAST(len(regexp_extract_all(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[^{_WS[1:]}+')) AS BIGINT) AS n_words, CAST(len(regexp_extract_all(html, '(?i)<h[12]\b')) AS BIGINT) AS n_headings FROM t""")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-2."""
    return table(spark, sf_dir, "pages").select("page_id", X.word_count(X.rendered_text(F.col("html"))).alias("n_words"), X.heading_count(F.col("html")).alias("n_headings"))


@query("""
WITH b AS (SELECT page_id % 10 AS doc_id, page_id AS seq, page_id % 3 = 1 AS is_h1, url AS text FROM pages),
r AS (SELECT *, sum(CASE WHEN is_h1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY seq) AS raw, count(*) FILTER (WHERE is_h1) OVER (PARTITION BY doc_id) AS n_h1 FROM b),
c AS (SELECT doc_id, seq, text, CASE WHEN raw = 0 AND n_h1 > 0 THEN 'Front matter' ELSE max(CASE WHEN is_h1 THEN text END) OVER (PARTITION BY doc_id, raw) END AS title, raw + CASE WHEN min(raw) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END AS no FROM r),
e AS (SELECT doc_id, no, max(title) AS title, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS many FROM e)
SELECT doc_id, CAST(CASE WHEN many > 12 THEN 1 ELSE no END AS INTEGER) AS chapter_no, min(title) AS title, CAST(sum(n) AS BIGINT) AS n_blocks FROM m GROUP BY 1, 2""")
def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-13, FLT-12, LIM-1, SNK-4: chapters of pages, and the spine of a publication."""
    blocks = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.col("page_id").alias("seq"), (F.col("page_id") % 3 == 1).alias("is_h1"), F.col("url").alias("text"), F.lit(False).alias("has_object"))
    return structure.spine(structure.chapters(blocks)).withColumn("chapter_no", F.col("chapter_no").cast("int"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_quantity, l_extendedprice, {_SEQ} AS seq FROM lineitem), y AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, seq) AS line_no, l_extendedprice / 100 AS y, 8 + l_quantity % 5 AS h FROM s),
g AS (SELECT *, y - lead(y) OVER (PARTITION BY l_orderkey ORDER BY line_no) AS gap, median(h) OVER (PARTITION BY l_orderkey) AS mh FROM y), k AS (SELECT * FROM g WHERE gap > mh * 0.55),
t AS (SELECT *, coalesce(nullif(median(CASE WHEN gap <= greatest(mh * 2.6, 842 * 0.045) THEN gap END) OVER (PARTITION BY l_orderkey), 0), median(gap) OVER (PARTITION BY l_orderkey)) AS typical FROM k)
SELECT l_orderkey, line_no, gap, CAST(greatest(2, least(12, floor((gap - typical) / mh + 0.5))) AS INTEGER) AS space_lines FROM t WHERE gap >= greatest(typical * 1.65, mh * 2.75, 842 * 0.045) AND gap - typical >= greatest(mh * 1.05, 842 * 0.018)""")
def line_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-3, AGG-3: writing spaces between the lines of a page; an order is a page."""
    s = sequenced(spark, sf_dir, "l_quantity")
    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "seq"))
    lines = s.select("l_orderkey", no.cast("long").alias("line_no"), (F.col("l_extendedprice") / 100).alias("y"), (8 + F.col("l_quantity") % 5).alias("max_height"), F.lit(None).cast("double").alias("line_height"))
    return layout.whitespace(lines, 842.0, ("l_orderkey",))


@query(f"""
WITH RECURSIVE s AS (SELECT l_orderkey, l_quantity, l_extendedprice, {_SEQ} AS seq FROM lineitem), i AS (SELECT l_orderkey, seq, l_extendedprice % 37 AS x, l_extendedprice - floor(l_extendedprice / 50) * 50 AS y, 8 + CAST(l_quantity AS INT) % 5 AS h FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY y DESC, x, seq) AS n FROM i),
g AS (SELECT *, 0 AS row_no, y AS row_y FROM o WHERE n = 1 UNION ALL SELECT o.*, CASE WHEN row_y - o.y <= 2 THEN row_no ELSE row_no + 1 END, CASE WHEN row_y - o.y <= 2 THEN row_y ELSE o.y END FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.n = g.n + 1),
k AS (SELECT l_orderkey, seq, x, y, h, row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no, x, seq) AS n FROM g),
f AS (SELECT l_orderkey, seq, x, n, 0 AS line_no, y AS line_y, CAST(h AS DOUBLE) AS top FROM k WHERE n = 1
 UNION ALL SELECT k.l_orderkey, k.seq, k.x, k.n, CASE WHEN abs(f.line_y - k.y) <= greatest(2.5, greatest(k.h, f.top) * 0.45) THEN f.line_no ELSE f.line_no + 1 END, CASE WHEN abs(f.line_y - k.y) <= greatest(2.5, greatest(k.h, f.top) * 0.45) THEN f.line_y ELSE k.y END,
  CASE WHEN abs(f.line_y - k.y) <= greatest(2.5, greatest(k.h, f.top) * 0.45) THEN greatest(f.top, k.h) ELSE k.h END FROM f JOIN k ON k.l_orderkey = f.l_orderkey AND k.n = f.n + 1)
SELECT l_orderkey, CAST(seq AS BIGINT) AS item_seq, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY l_orderkey, line_no ORDER BY x, seq) - 1 AS INTEGER) AS item_no FROM f""")
def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-1, SRT-1: items of a page into lines, those of a line by x."""
    price = F.col("l_extendedprice")
    items = sequenced(spark, sf_dir, "l_quantity").select("l_orderkey", F.col("seq").alias("item_seq"), (price % 37).alias("x"), (price - F.floor(price / 50) * 50).alias("y"), (8 + F.col("l_quantity").cast("int") % 5).alias("height"))
    return layout.cluster_lines(items, ("l_orderkey",)).drop("line_y")


_CENTRES = f"""s AS (SELECT l_orderkey, l_extendedprice % 500 AS x, l_partkey, {_SEQ} AS seq FROM lineitem), o AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS n FROM s),
f AS (SELECT l_orderkey, n, 0 AS c, x AS total, 1 AS k FROM o WHERE n = 1 UNION ALL SELECT o.l_orderkey, o.n, CASE WHEN abs(x - total / k) <= 20 THEN c ELSE c + 1 END, CASE WHEN abs(x - total / k) <= 20 THEN total + x ELSE x END, CASE WHEN abs(x - total / k) <= 20 THEN k + 1 ELSE 1 END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.n = f.n + 1),
m AS (SELECT l_orderkey, c, max_by(total / k, n) AS centre FROM f GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_CENTRES} SELECT l_orderkey, CAST(c AS INTEGER) AS centre_no, round(centre, 6) AS centre FROM m")
def column_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-7, SRT-2."""
    xs = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") % 500).alias("x"))
    return layout.column_centres(xs, 20.0, ("l_orderkey",)).withColumn("centre", F.round("centre", 6))


@query(f"""WITH RECURSIVE {_CENTRES}, r AS (SELECT s.l_orderkey, seq, c, row_number() OVER (PARTITION BY s.l_orderkey, seq ORDER BY abs(centre - x), c) AS near, abs(centre - x) AS d, l_partkey FROM s JOIN m ON s.l_orderkey = m.l_orderkey)
SELECT l_orderkey, CAST(seq AS INTEGER) AS line_no, CAST(c AS INTEGER) AS centre_no, CAST(l_partkey AS VARCHAR) AS text FROM r WHERE near = 1 AND d <= 50""")
def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-9."""
    cells = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("line_no"), (F.col("l_extendedprice") % 500).alias("x"), F.col("l_partkey").cast("string").alias("text"))
    return layout.assign_columns(cells, layout.column_centres(cells, 20.0, ("l_orderkey",)), 20.0, ("l_orderkey",))


@query("""
WITH p AS (SELECT p_partkey // 8 AS page, p_size * 4.0 AS width, p_size % 3 * 1.0 + (p_size % 7) * 8 AS height, p_size % 2 = 0 AS stroked FROM part), b AS (SELECT *, stroked AND width >= 12 AND height >= 8 AS box FROM p),
m AS (SELECT *, median(CASE WHEN box THEN width END) OVER (PARTITION BY page) AS mw, median(CASE WHEN box THEN height END) OVER (PARTITION BY page) AS mh FROM b),
a AS (SELECT page, count(*) FILTER (WHERE width >= 24 AND height <= greatest(3, width * 0.012)) AS horizontal, count(*) FILTER (WHERE height >= 24 AND width <= greatest(3, height * 0.012)) AS vertical, count(*) FILTER (WHERE box AND abs(width - mw) <= greatest(2, mw * 0.22) AND abs(height - mh) <= greatest(2, mh * 0.22)) AS boxes FROM m GROUP BY page)
SELECT page, horizontal, vertical, boxes, (horizontal >= 2 AND vertical >= 2) OR boxes >= 4 AS has_grid FROM a""")
def grid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7."""
    size = F.col("p_size")
    rules = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 8).alias("page"), (size * 4.0).alias("width"), (size % 3 * 1.0 + (size % 7) * 8).alias("height"), (size % 2 == 0).alias("stroked"))
    return layout.grid_geometry(rules, ("page",))


@query("""
WITH l AS (SELECT l_orderkey, 72 + l_quantity AS x_start, 72 + l_quantity + l_discount * 3000 AS x_end, l_extendedprice / 130 AS top FROM lineitem),
a AS (SELECT l_orderkey, count(*) AS n, min(x_start) AS lft, max(x_end) AS rgt, max((x_start + x_end) / 2) - min((x_start + x_end) / 2) AS cs, max(x_start) - min(x_start) AS ss, max(x_end) - min(x_end) AS es, max(top) AS top FROM l GROUP BY 1),
r AS (SELECT *, greatest(0, lft / 596) AS lr, greatest(0, (596 - rgt) / 596) AS rr, least(1, greatest(0, (rgt - lft) / 596)) AS occ, least(1, greatest(0, (842 - top) / 842)) AS tr FROM a)
SELECT l_orderkey, CASE WHEN occ < 0.86 AND abs(lr - rr) <= 0.075 AND (n = 1 OR cs <= 596 * 0.045) THEN 'center' WHEN n >= 2 AND es <= 596 * 0.025 AND ss > 596 * 0.04 THEN 'right' WHEN n >= 2 AND ss <= 596 * 0.025 THEN 'left' WHEN lr > 0.24 AND lr - rr >= 0.12 THEN 'right' ELSE 'left' END AS alignment,
 CASE WHEN tr < 0.28 THEN 'top' WHEN tr < 0.64 THEN 'middle' ELSE 'bottom' END AS vertical_position FROM r""")
def block_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-6, MTH-2."""
    x = 72 + F.col("l_quantity")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", x.alias("x_start"), (x + F.col("l_discount") * 3000).alias("x_end"), (F.col("l_extendedprice") / 130).alias("top"))
    return layout.block_position(lines, 596.0, 842.0, ("l_orderkey",))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, CAST(CASE WHEN r < 0.78 THEN 75 WHEN r < 0.92 THEN 88 WHEN r < 1.09 THEN 100 WHEN r < 1.21 THEN 112 WHEN r < 1.39 THEN 125 WHEN r < 1.64 THEN 150 ELSE 175 END AS INTEGER) AS size_class,
 CASE WHEN z < 0.28 THEN 'top' WHEN z < 0.64 THEN 'middle' ELSE 'bottom' END AS zone, CAST(least(8, greatest(0, floor(z * 16 + 0.5))) AS INTEGER) AS offset_level, CAST(CASE WHEN c >= 8 THEN 2 WHEN c >= 3.5 THEN 1 ELSE 0 END AS INTEGER) AS indent,
 least(255, greatest(0, (l_quantity * 5 - 128) * 1.05 + 128)) AS channel, CAST(floor(l_quantity * 5 / 17 + 0.5) * 17 AS INTEGER) AS gray FROM (SELECT *, greatest(0.1, l_quantity / 25) AS r, l_discount * 8 AS z, greatest(0, l_quantity - 3) / 4 AS c FROM lineitem)""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-1, MTH-2, MTH-3, MTH-8, AGG-5 offsets, IMG-5 gray levels."""
    q, z = F.col("l_quantity"), F.col("l_discount") * 8
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", N.size_class(q, F.lit(25.0)).alias("size_class"), N.vertical_zone(z).alias("zone"), N.offset_level(z).alias("offset_level"), N.indent_level(q, F.lit(3.0), F.lit(4.0)).alias("indent"),
        N.contrast_channel(q * 5, 1.05).alias("channel"), N.gray_level(q * 5).alias("gray"),
    )


@query(r"""
WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN '1. ' || p_name WHEN 2 THEN 'Part ' || p_name ELSE p_name END AS t, 1 + p_size / 60.0 AS r, p_size % 5 = 0 AS b FROM part),
f AS (SELECT *, length(t) BETWEEN 3 AND 80 AND NOT (t LIKE '%.' AND length(t) > 30) AND NOT (regexp_matches(t, '^[0-9]+\s+["A-Za-z]') AND length(t) > 45) AS ok, length(t) <= 50 AND t = upper(t) AND regexp_matches(t, '[A-Z]') AND len(string_split_regex(t, '\s+')) <= 10 AS caps FROM p)
SELECT p_partkey, CAST(CASE WHEN NOT ok THEN NULL WHEN regexp_matches(t, '(?i)^(chapter|part|section|appendix)\b') OR (caps AND r >= 1.4) THEN 1 WHEN (regexp_matches(t, '^[0-9]{1,2}[.)]\s+\S') AND length(t) <= 70 AND (r >= 1.15 OR b)) OR (caps AND r >= 1.22) OR (b AND r >= 1.25) OR r >= 1.55 THEN 2 END AS INTEGER) AS level FROM f""")
def heading_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2."""
    size = F.col("p_size")
    text = F.when(size % 4 == 0, F.upper("p_name")).when(size % 4 == 1, F.concat(F.lit("1. "), "p_name")).when(size % 4 == 2, F.concat(F.lit("Part "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.heading_level(text, 1 + size / 60.0, size % 5 == 0).alias("level"))


_FONTS = ["AAAAAA+Amsterdam-Four", "CAAAAA+Montserrat-Bold", "DAAAAA+PlayfairDisplay-Regular", "Subset+Courier-Oblique", "Unknown_Thing", "BAAAAA+Times_New-SemiBold"]


@query("""
WITH p AS (SELECT p_partkey, p_size % 6 AS k, p_brand FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'Amsterdam Four' WHEN 1 THEN 'Montserrat Bold' WHEN 2 THEN 'PlayfairDisplay Regular' WHEN 3 THEN 'Subset+Courier Oblique' WHEN 4 THEN 'Unknown Thing' ELSE 'Times New SemiBold' END AS source_name,
 CASE k WHEN 0 THEN 'script' WHEN 2 THEN 'serif' WHEN 3 THEN 'mono' WHEN 5 THEN 'serif' ELSE 'sans' END AS family, k IN (1, 5) AS bold, k = 3 AS italic, k = 4 AS light, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM p""")
def font_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6, STR-19, STR-20, JN-7."""
    name = F.get(F.array(*[F.lit(f) for f in _FONTS]), F.col("p_size") % 6)
    return table(spark, sf_dir, "part").select("p_partkey", X.font_traits(name, "sans-serif").alias("f"), X.slug(F.col("p_brand")).alias("slug")).select("p_partkey", "f.*", "slug")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), h AS (SELECT doc_id, line_no, CASE WHEN line_no % 4 = 1 THEN 'reconstruc-' WHEN line_no % 4 = 2 THEN 'tion ' || line ELSE line END AS t FROM l),
s AS (SELECT *, coalesce(regexp_matches(lag(t) OVER w, '[A-Za-z]-$') AND regexp_matches(t, '^[a-z]'), false) AS soft FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), r AS (SELECT *, sum(CASE WHEN soft THEN 0 ELSE 1 END) OVER w AS run, coalesce(lead(soft) OVER w, false) AS follows FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS line_no, string_agg(CASE WHEN follows THEN regexp_replace(t, '-$', '') ELSE t END, '' ORDER BY line_no) AS text FROM r GROUP BY doc_id, run""")
def hyphen_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-8: soft hyphens over line ends."""
    n = F.col("line_no") % 4
    lines = doc_lines(spark, sf_dir).select("doc_id", "line_no", F.when(n == 1, F.lit("reconstruc-")).when(n == 2, F.concat(F.lit("tion "), "line")).otherwise(F.col("line")).alias("text"))
    return layout.joined_hyphens(lines, ("doc_id",))


@query("""
WITH RECURSIVE s AS (SELECT p_partkey AS id, p_partkey // 2 AS based, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bold, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false END AS italic FROM part),
c AS (SELECT id AS style_id, id AS ancestor, based, 0 AS depth FROM s UNION ALL SELECT c.style_id, s.id, s.based, c.depth + 1 FROM c JOIN s ON s.id = c.based AND c.based <> c.ancestor WHERE c.depth < 31)
SELECT c.style_id, min_by(bold, depth) FILTER (WHERE bold IS NOT NULL) AS bold, min_by(italic, depth) FILTER (WHERE italic IS NOT NULL) AS italic, CAST(max(depth) AS INTEGER) AS depth FROM c JOIN s ON s.id = c.ancestor GROUP BY 1""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-5, MAP-1: the nearest value in a chain of styles; style 0 is based on itself."""
    k = F.col("p_partkey")
    trait = lambda m: F.when(F.col("p_size") % m == 0, F.lit(True)).when(F.col("p_size") % m == 1, F.lit(False))
    styles = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), k.alias("style_id"), F.floor(k / 2).alias("based_on"), trait(3).alias("bold"), trait(5).alias("italic"))
    return structure.resolved_styles(styles, ("bold", "italic")).drop("doc_id")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, coalesce(direct, def OR (coalesce(t, false) <> coalesce(p, false)) <> coalesce(c, false)) AS toggle, coalesce(direct, c, p, t, def, false) AS override, CASE WHEN v THEN lower(l_returnflag) <> 'n' END AS on_off FROM (
 SELECT *, CAST(l_quantity AS INT) % 7 = 0 AS def, CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS t, CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false END AS p, CASE l_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS c, CASE l_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS direct, CASE WHEN l_linenumber > 1 THEN true END AS v FROM lineitem)""")
def trait_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-2, MAP-3, MAP-4."""
    tri = lambda c, m: F.when(c % m == 0, F.lit(True)).when(c % m == 1, F.lit(False))
    q = F.col("l_quantity").cast("int")
    default, t, p, c, direct = q % 7 == 0, tri(q, 3), tri(F.col("l_linenumber"), 3), tri(F.col("l_suppkey"), 3), tri(F.col("l_partkey"), 4)
    value = F.when(F.lower("l_returnflag") == "n", F.lit("No")).otherwise(F.lit("1"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", N.toggle(default, F.array(t, p, c), direct).alias("toggle"), N.override(default, t, p, c, direct).alias("override"), N.on_off(F.col("l_linenumber") > 1, value).alias("on_off"))


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, l_quantity, l_linenumber, {_SEQ} AS seq FROM lineitem), v AS (SELECT *, l_partkey % 3 = 0 AS visible, count(*) FILTER (WHERE l_partkey % 3 = 0) OVER (PARTITION BY l_orderkey ORDER BY seq) AS island FROM s),
g AS (SELECT l_orderkey, island, min(CASE WHEN visible THEN seq END) AS after_seq, max(CASE WHEN visible THEN 'part ' || l_partkey END) AS after_key, count(*) FILTER (WHERE NOT visible) AS empty_paragraphs, sum(CASE WHEN NOT visible THEN greatest(1, l_quantity * 10 / 240) + l_linenumber % 2 END) AS size FROM v GROUP BY 1, 2),
n AS (SELECT *, lead(after_key) OVER (PARTITION BY l_orderkey ORDER BY island) AS next_key FROM g)
SELECT l_orderkey, CAST(after_seq AS INTEGER) AS after_seq, after_key, next_key, empty_paragraphs, CAST(least(12, floor(size + 0.5)) AS INTEGER) AS lines FROM n WHERE island > 0 AND size >= 1.5""")
def spacing_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-10, AGG-13, STR-8."""
    s = sequenced(spark, sf_dir, "l_quantity")
    paragraphs = s.select(
        "l_orderkey", F.col("seq").cast("int").alias("seq"), (F.col("l_partkey") % 3 == 0).alias("visible"), F.concat(F.lit(" Part  "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("text"), (F.col("l_quantity") * 10).alias("spacing_line"),
        (F.col("l_linenumber") % 2).alias("breaks"), F.lit(0.0).alias("spacing_before"), F.lit(0.0).alias("spacing_after"),
    )
    return structure.writing_spaces(paragraphs, ("l_orderkey",))


@query(f"""
WITH s AS (SELECT l_orderkey, l_partkey, {_SEQ} AS seq, CASE WHEN l_partkey % 3 = 0 THEN 'break' ELSE 'paragraph' END AS type, CASE WHEN l_partkey % 3 = 1 THEN '' ELSE 'x' END AS text FROM lineitem),
c AS (SELECT *, last_value(CASE WHEN NOT (type = 'paragraph' AND text = '') THEN type END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT l_orderkey, CAST(seq AS INTEGER) AS seq, CASE WHEN type = 'break' AND (before IS NULL OR before = 'break') THEN 'blank_page' ELSE type END AS type FROM c""")
def page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-15."""
    k = F.col("l_partkey") % 3
    blocks = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("seq"), F.when(k == 0, F.lit("break")).otherwise(F.lit("paragraph")).alias("type"), F.when(k == 1, F.lit(" ")).otherwise(F.lit("x")).alias("text"))
    return structure.page_breaks(blocks, ("l_orderkey",)).select("l_orderkey", "seq", "type")


@query(f"""
WITH s AS (SELECT l_orderkey, {_SEQ} AS seq, CAST(l_quantity AS INT) % 3 AS level FROM lineitem)
SELECT a.l_orderkey, CAST(a.seq AS BIGINT) AS seq, CAST(a.level AS INTEGER) AS level, CAST(max(b.seq) AS BIGINT) AS parent_seq FROM s a LEFT JOIN s b ON b.l_orderkey = a.l_orderkey AND b.seq < a.seq AND b.level < a.level GROUP BY 1, 2, 3""")
def list_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-12."""
    items = sequenced(spark, sf_dir, "l_quantity").select("l_orderkey", "seq", (F.col("l_quantity").cast("int") % 3).alias("level"), F.lit(True).alias("is_list"), F.lit("decimal").alias("format"))
    return structure.nested(items, ("l_orderkey",)).select("l_orderkey", "seq", "level", "parent_seq")


@query(f"""
WITH s AS (SELECT l_orderkey, {_SEQ} AS seq, l_partkey % 2 = 0 AS is_list, l_suppkey % 3 <> 0 AS visible FROM lineitem),
n AS (SELECT *, lag(is_list AND true) OVER w AS li, lead(is_list) OVER w AS ri, lag(seq) OVER w IS NULL OR lead(seq) OVER w IS NULL AS edge, last_value(CASE WHEN visible THEN is_list END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lv, first_value(CASE WHEN visible THEN is_list END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS rv FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq))
SELECT l_orderkey, CAST(seq AS INTEGER) AS seq FROM n WHERE visible OR edge OR NOT ((coalesce(li, false) AND coalesce(ri, false)) OR (coalesce(lv, false) AND coalesce(rv, false)))""")
def list_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-16."""
    p = sequenced(spark, sf_dir).select("l_orderkey", F.col("seq").cast("int").alias("seq"), (F.col("l_partkey") % 2 == 0).alias("is_list"), (F.col("l_suppkey") % 3 != 0).alias("visible"))
    return structure.without_separators(p, ("l_orderkey",)).select("l_orderkey", "seq")


@query("""
WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS page, o_totalprice FROM orders), b AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS page, o_totalprice * 2 AS o_totalprice FROM orders)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.page, b.page) AS page, a.o_totalprice AS before_price, b.o_totalprice AS after_price, CASE WHEN a.page IS NOT NULL AND b.page IS NOT NULL THEN 'both' WHEN a.page IS NOT NULL THEN 'removed' ELSE 'added' END AS status FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.page = b.page""")
def page_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3, SET-1, SRT-3: all orders against a revision in which every third page has another number and all prices are doubled."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("price"))
    after = pages.select("doc_id", F.when(F.col("page") % 3 == 0, -F.col("page")).otherwise(F.col("page")).alias("page"), (F.col("price") * 2).alias("price"))
    return diff.pages_side_by_side(pages, after)


@query("""
WITH a AS (SELECT lang, md5(text) AS key FROM documents GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT lang, md5(CASE WHEN doc_id % 5 = 0 THEN text || '*' ELSE text END) AS key FROM documents GROUP BY 1, 2 HAVING count(*) = 1) SELECT lang, key FROM a JOIN b USING (lang, key)""")
def moved_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, SET-2: all documents against a revision in which every fifth has another text."""
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("*"))).otherwise(F.col("text"))
    return diff.unique_in_both(docs.select("lang", F.md5("text").alias("key")), docs.select("lang", F.md5(changed).alias("key")), ("lang", "key"))


@query("""
WITH r AS (SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_extendedprice, CASE l_linenumber % 4 WHEN 0 THEN 'https://example.com/' || l_partkey WHEN 1 THEN 'data:image/png,' || l_partkey ELSE 'images/p' || l_partkey || '.png' END AS src FROM lineitem), a AS (SELECT o_orderkey AS doc_id, 'p' || l_partkey || '.png' AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 2 = 0)
SELECT doc_id, l_partkey, l_suppkey, l_extendedprice, src, CASE WHEN src LIKE 'data:%' THEN 'unpackaged source' ELSE 'missing file' END AS problem FROM r WHERE src NOT LIKE 'https://%' AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = r.doc_id AND 'images/' || a.name = r.src)""")
def unresolved_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, PKG-7, SET-3."""
    items = table(spark, sf_dir, "lineitem")
    k, part = F.col("l_linenumber") % 4, F.col("l_partkey").cast("string")
    src = F.when(k == 0, F.concat(F.lit("https://example.com/"), part)).when(k == 1, F.concat(F.lit("data:image/png,"), part)).otherwise(F.concat(F.lit("images/p"), part, F.lit(".png")))
    refs = items.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", "l_extendedprice", src.alias("src"))
    assets = items.where("l_partkey % 2 = 0").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".png")).alias("file_name"))
    return package.unresolved_images(refs, assets)


@query("""
WITH a AS (SELECT p_partkey // 10 AS doc_id, p_partkey % 10 AS asset_no, p_size, CASE p_size % 9 WHEN 0 THEN '' WHEN 1 THEN 'a b' WHEN 2 THEN 'nav' WHEN 3 THEN 'same' ELSE 'i' || p_partkey END AS id, CASE p_size % 7 WHEN 0 THEN '../x.png' WHEN 1 THEN 'same.png' WHEN 2 THEN 'p' || p_partkey || '.jpg' ELSE 'p' || p_partkey || '.png' END AS file_name, CASE WHEN p_size % 11 = 0 THEN 'image/bmp' ELSE ' Image/PNG' END AS media, CASE WHEN p_size % 13 = 0 THEN 0 ELSE 3 END AS n FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY asset_no) > 1 AS ri, row_number() OVER (PARTITION BY doc_id, file_name ORDER BY asset_no) > 1 AS rf FROM a),
p AS (SELECT doc_id, asset_no, CASE WHEN id = '' THEN 'missing id' WHEN file_name LIKE '%/%' THEN 'bad file name' WHEN id LIKE '% %' THEN 'bad id' WHEN id = 'nav' OR ri THEN 'duplicate id' WHEN rf THEN 'duplicate file name' WHEN media LIKE '%bmp' THEN 'unsupported type' WHEN file_name NOT LIKE '%.png' THEN 'extension mismatch' WHEN n = 0 THEN 'empty content' END AS problem FROM r)
SELECT doc_id, asset_no, problem FROM p WHERE problem IS NOT NULL""")
def package_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PKG-2..6, SET-5."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    assets = table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 10).alias("doc_id"), (F.col("p_partkey") % 10).alias("asset_no"),
        F.when(size % 9 == 0, F.lit("")).when(size % 9 == 1, F.lit("a b")).when(size % 9 == 2, F.lit("nav")).when(size % 9 == 3, F.lit("same")).otherwise(F.concat(F.lit("i"), key)).alias("id"),
        F.when(size % 7 == 0, F.lit("../x.png")).when(size % 7 == 1, F.lit("same.png")).when(size % 7 == 2, F.concat(F.lit("p"), key, F.lit(".jpg"))).otherwise(F.concat(F.lit("p"), key, F.lit(".png"))).alias("file_name"),
        F.when(size % 11 == 0, F.lit("image/bmp")).otherwise(F.lit(" Image/PNG")).alias("media_type"), F.when(size % 13 == 0, F.lit("")).otherwise(F.lit("abc")).cast("binary").alias("content"),
    )
    return package.asset_violations(assets, assets.select("doc_id").distinct())


@query("""
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'malformed' WHEN 1 THEN 'not an image' WHEN 2 THEN 'unsupported type' WHEN 3 THEN 'invalid data' WHEN 4 THEN 'empty' WHEN 5 THEN 'signature mismatch' END AS problem, CAST(CASE p_partkey % 8 WHEN 4 THEN 0 WHEN 5 THEN 3 WHEN 6 THEN 9 WHEN 7 THEN 6 END AS INTEGER) AS n_bytes FROM part""")
def data_url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-1, IMG-2."""
    urls = ["nothing", "data:text/plain,x", "data:image/bmp;base64,AAAA", "data:image/png;base64,%%%%", "data:image/png,", "DATA:image/png;base64,AAAA", "data:image/png;base64,iVBORw0KGgoA", "data:image/gif;x=1;base64,R0lGODlh"]
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*[F.lit(u) for u in urls]), (F.col("p_partkey") % 8).cast("int")).alias("src"))
    return images.decoded(rows, check_svg=False).select("p_partkey", "problem", F.octet_length("content").alias("n_bytes"))


@query("""
WITH p AS (SELECT p_partkey, p_size * 40.0 AS w, p_retailprice AS h, p_size * 2.0 AS fit, p_size % 4 AS n, p_size % 2 = 0 AS b FROM part), c AS (SELECT *, greatest(1, CASE WHEN n = 0 THEN 1 ELSE n END) AS k, least(0.92, greatest(0.2, fit / 100)) AS room FROM p),
e AS (SELECT *, floor(1680 * greatest(0.18, (room - (k - 1) * 0.035) / k) * (w / h) / 1264 * 100 / 5) * 5 AS v, least(1, 1264 / w, 1680 / h) AS s FROM c)
SELECT p_partkey, CAST(greatest(25, least(CASE WHEN b THEN 100 ELSE 60 END, v)) AS INTEGER) AS width_percent, CAST(greatest(1, floor(w * s + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(h * s + 0.5)) AS INTEGER) AS height, CAST(greatest(25, least(100, floor(fit / 5 + 0.5) * 5)) AS INTEGER) AS rounded_width FROM e""")
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-6, MTH-7, IMG-4."""
    w, h, fit, n = F.col("p_size") * 40.0, F.col("p_retailprice"), F.col("p_size") * 2.0, F.col("p_size") % 4
    size = N.fitted(w, h, F.lit(1264.0), F.lit(1680.0))
    return table(spark, sf_dir, "part").select("p_partkey", N.image_width_for_page(w, h, fit, n, F.col("p_size") % 2 == 0, F.lit(1264.0), F.lit(1680.0)).alias("width_percent"), size["width"].alias("width"), size["height"].alias("height"), N.image_width(fit).alias("rounded_width"))


@query("""
WITH e AS (SELECT event_id, value, event_id % 5 AS k FROM events), v AS (SELECT *, CASE k WHEN 0 THEN value ELSE NULL END AS f FROM e)
SELECT event_id, CASE WHEN k = 0 THEN 'sage' ELSE 'libra-colour' END AS device, CASE WHEN k = 0 THEN 'landscape' ELSE 'portrait' END AS orientation,
 CASE WHEN k = 0 THEN least(4.8, greatest(2.6, round(2.6 + floor((least(4.8, greatest(2.6, value)) - 2.6) / 0.2 + 0.5) * 0.2, 6))) WHEN k = 1 THEN 2.6 ELSE 3.6 END AS font, CAST(CASE WHEN k = 0 THEN 12.0 WHEN k = 2 THEN 16.0 ELSE 8.0 END AS DOUBLE) AS margin, k <> 0 AS chrome FROM v""")
def prefs_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-1, MTH-4, SRC-15."""
    k = F.col("event_id") % 5
    json = (
        F.when(k == 0, F.concat(F.lit('{"device":"sage","orientation":"landscape","font":'), F.col("value").cast("string"), F.lit(',"margin":"12","chrome":false}')))
        .when(k == 1, F.lit('{"device":7,"orientation":"up","font":null,"chrome":"false"}')).when(k == 2, F.lit('{"device":"other","margin":99,"font":"large"}')).when(k == 3, F.lit("{broken")).otherwise(F.lit("{}"))
    )
    return S.preferences(table(spark, sf_dir, "events").select("event_id", json.alias("json"))).drop("json")


DEVICE_COLUMNS = ("device", "screen_width", "screen_height", "ppi", "body_width", "body_height", "screen_left")
# fixed values: pixels, pixels per inch, millimetres
DEVICE_TABLE = (
    ("clara-bw", 1072, 1448, 300, 112.0, 160.0, None), ("clara-colour", 1072, 1448, 300, 112.0, 160.0, None), ("libra-colour", 1264, 1680, 300, 144.6, 161.0, 8.5), ("sage", 1440, 1920, 300, 160.5, 181.4, 8.5),
    ("elipsa-2e", 1404, 1872, 227, 193.0, 227.0, 8.5),
)


@query("""
WITH d(device, sw, sh, ppi, bw, bh, lf) AS (VALUES ('clara-bw', 1072, 1448, 300, 112.0::DOUBLE, 160.0::DOUBLE, NULL::DOUBLE), ('clara-colour', 1072, 1448, 300, 112.0, 160.0, NULL), ('libra-colour', 1264, 1680, 300, 144.6, 161.0, 8.5), ('sage', 1440, 1920, 300, 160.5, 181.4, 8.5), ('elipsa-2e', 1404, 1872, 227, 193.0, 227.0, 8.5)),
m AS (SELECT *, CAST(sw AS DOUBLE) / ppi * 25.4 AS wm, CAST(sh AS DOUBLE) / ppi * 25.4 AS hm FROM d), g AS (SELECT *, coalesce(lf, (bw - wm) / 2) AS lm, (bh - hm) / 2 AS tm FROM m)
SELECT device, 'portrait' AS orientation, round(bw, 6) AS body_width, round(bh, 6) AS body_height, round(wm, 6) AS screen_width, round(hm, 6) AS screen_height, round(lm, 6) AS screen_left, round(tm, 6) AS screen_top, sw AS width_px, sh AS height_px FROM g
UNION ALL SELECT device, 'landscape', round(bh, 6), round(bw, 6), round(hm, 6), round(wm, 6), round(bh - tm - hm, 6), round(lm, 6), sh, sw FROM g""")
def device_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-5."""
    d = spark.createDataFrame(list(DEVICE_TABLE), "device string, sw int, sh int, ppi int, bw double, bh double, lf double")
    wm, hm = F.col("sw") / F.col("ppi") * 25.4, F.col("sh") / F.col("ppi") * 25.4
    left, top = F.coalesce("lf", (F.col("bw") - wm) / 2), (F.col("bh") - hm) / 2
    sides = {"portrait": ("bw", "bh", wm, hm, left, top, "sw", "sh"), "landscape": ("bh", "bw", hm, wm, F.col("bh") - top - hm, left, "sh", "sw")}
    names = ("body_width", "body_height", "screen_width", "screen_height", "screen_left", "screen_top")
    both = [d.select("device", F.lit(o).alias("orientation"), *[F.round(F.col(c) if isinstance(c, str) else c, 6).alias(n) for n, c in zip(names, v[:6], strict=True)], F.col(v[6]).alias("width_px"), F.col(v[7]).alias("height_px")) for o, v in sides.items()]
    return both[0].unionByName(both[1])


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS hit_no, CASE WHEN length(t) > 42 THEN substring(t, 1, 41) || '…' ELSE t END AS label FROM (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS t FROM l WHERE contains(lower(line), 'that the'))""".replace("\\\\", "\\"))
def find_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, STR-7."""
    hits = doc_lines(spark, sf_dir).where(F.contains(F.lower("line"), F.lower(X.trimmed(F.lit(" That the ")))))
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("line_no"))
    return hits.select("doc_id", "line_no", no.alias("hit_no"), X.shortened(F.col("line")).alias("label"))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * p_size * 97 AS n FROM part)
SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CASE WHEN n < 10240 THEN printf('%.1f', floor(n / 1024 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(n / 1024 + 0.5) AS BIGINT) AS VARCHAR) END || ' KB' ELSE CASE WHEN n < 10485760 THEN printf('%.1f', floor(n / 1048576 * 10 + 0.5) / 10) ELSE CAST(CAST(floor(n / 1048576 + 0.5) AS BIGINT) AS VARCHAR) END || ' MB' END AS size FROM p""")
def file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-22."""
    n = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", N.file_size(n * n * n * 97).alias("size"))


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-1, DIF-2, STR-15, SEQ-14, AGG-9: consecutive turns of a conversation as two revisions."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before is not null").withColumnRenamed("text", "after")
    ops = diff.word_diff(pairs, ("conv_id", "turn")).select("conv_id", "turn", F.posexplode("ops").alias("seq", "op")).select("conv_id", "turn", "seq", "op.*")
    shown = diff.with_context(ops, ("conv_id", "turn")).groupBy("conv_id", "turn").agg(F.count("*").alias("n_shown"))
    return diff.counters(ops, ("conv_id", "turn")).join(shown, ["conv_id", "turn"])


@query()
def document_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DIF-3..8, JN-13: each document against a revision of its lines."""
    lines = doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("seq"), X.match_key(F.col("line")).alias("key"), diff.signature(F.col("line")).alias("signature"))
    moved = F.when(F.col("seq") % 11 == 3, F.col("seq") + 5).otherwise(F.col("seq"))
    after = lines.where("seq % 7 <> 2").withColumn("signature", F.when(F.col("seq") % 5 == 0, F.sha2("signature", 256)).otherwise(F.col("signature"))).withColumn("seq", moved * 2 + F.when(moved != F.col("seq"), 1).otherwise(0))
    return diff.block_changes(lines, after)


@query()
def dither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-5: vectors as gray pixels of eight by eight."""
    gray = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x * 64 + 128)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", gray.alias("pixels"), F.lit(8).alias("width"))
    return images.dithered(rows, ("vec_id",)).select("vec_id", F.aggregate("pixels", F.lit(0), lambda a, x: a + F.when(x > 0, 1).otherwise(0)).alias("n_white"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: blocks of HTML pages."""
    return S.html_blocks(table(spark, sf_dir, "pages"), ("page_id",))


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, book, path, text, file_seq, content): the files of publications. Documents of a language and source are shelved by ranges of ids, so that chapters are numbered in groups of
    bounded size, however large a source is."""
    docs = table(spark, sf_dir, "documents").withColumn("shelf", F.floor(F.col("doc_id") / shelf_size()))
    no = F.row_number().over(W.partitionBy("lang", "source", "shelf").orderBy("doc_id"))
    chapters_of = docs.select("lang", "source", "shelf", no.alias("no"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("<p>"), X.escape_html(F.col("text")), F.lit("</p>")).alias("html"))
    keys = ("source", "book")
    book = F.concat_ws("-", "lang", F.col("shelf").cast("string"), F.floor((F.col("no") - 1) / package_size()).cast("string"))
    chapters_of = chapters_of.select("source", book.alias("book"), ((F.col("no") - 1) % package_size() + 1).alias("chapter_no"), "title", "html")
    pubs = chapters_of.select(*keys).distinct().select(*keys, F.concat("source", F.lit(" "), "book").alias("title"), F.lit("Unknown").alias("author"), F.substring("book", 1, 2).alias("lang"), F.concat(F.lit("urn:"), "source", F.lit(":"), "book").alias("identifier"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("modified"))
    none = spark.createDataFrame([], "source string, book string, asset_no int, id string, file_name string, media_type string, content binary")
    return package.package_files(pubs, chapters_of, none, keys)


@query()
def publication_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1..4, PKG-8, DAT-1: publications of documents, with a chapter for each document."""
    keys = ("source", "book")
    return package.archives(_publications(spark, sf_dir), keys).select(*keys, F.octet_length("archive").alias("n_bytes"), F.sha2("archive", 256).alias("digest"))


@query("""
WITH d AS (SELECT doc_id, lang, source, text, doc_id // 4096 AS shelf, row_number() OVER (PARTITION BY lang, source, doc_id // 4096 ORDER BY doc_id) AS no FROM documents),
c AS (SELECT source, lang || '-' || shelf || '-' || (no - 1) // 64 AS book, lang, (no - 1) % 64 + 1 AS chapter_no, 'Document ' || doc_id AS title, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body FROM d),
f AS (SELECT source, book, count(*) AS n FROM c GROUP BY 1, 2),
e AS (SELECT source, book, 0 AS entry_no, 'mimetype' AS path, true AS stored, CAST(20 AS BIGINT) AS n_bytes FROM f
 UNION ALL SELECT source, book, unnest([1, 2]), unnest(['META-INF/container.xml', 'OEBPS/style.css']), false, NULL FROM f
 UNION ALL SELECT source, book, 3, 'OEBPS/nav.xhtml', false, NULL FROM f UNION ALL SELECT source, book, 4, 'OEBPS/toc.ncx', false, NULL FROM f
 UNION ALL SELECT source, book, 4 + chapter_no, 'OEBPS/chapter-' || chapter_no || '.xhtml', false, CASE WHEN regexp_matches(body, '[\x00-\x08\x0B\x0C\x0E-\x1F]') THEN NULL ELSE 255 + strlen(substr(lang, 1, 2)) + strlen(title) + strlen('<p></p>') + strlen(body) END FROM c
 UNION ALL SELECT source, book, 5 + n, 'OEBPS/content.opf', false, NULL FROM f)
SELECT source, book, CAST(entry_no AS INTEGER) AS entry_no, path, stored, n_bytes FROM e""".replace("\\\\", "\\"))
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2, PKG-8: the archives read back: their entries in order, which are stored, and how long chapters are."""
    keys = ("source", "book")
    out = package.listed(package.archives(_publications(spark, sf_dir), keys), keys)
    known = (F.col("path") == "mimetype") | F.col("path").startswith("OEBPS/chapter-")
    return out.withColumn("n_bytes", F.when(known, F.col("n_bytes")))


def shelf_size() -> int:
    """Ids of a shelf."""
    return 4096


def package_size() -> int:
    """Chapters of a publication at most, so that one archive is a task of bounded size."""
    return 64
