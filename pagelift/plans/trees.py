"""Registered queries over pages as trees of labelled nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import body, structure
from ..session import stored
from ..sources import html
from .catalog import doc_lines, query, table

_PLAIN = r"regexp_replace(regexp_replace({}, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '<\1>', 'gs')"
#: The references that stand in the pages of these tables, with what they mean; some lack the end. The ampersand's own comes last.
_REFERENCES = {"&quot;?": '"', "&copy;?": "©", "&middot;?": "·", "&amp;?": "&"}


def _decoded(sql: str) -> str:
    for name, char in _REFERENCES.items():
        sql = f"regexp_replace({sql}, '{name}', '{char}', 'g')"
    return sql


@query(rf"""
WITH t AS (SELECT page_id, lower(unnest(regexp_extract_all({_PLAIN.format("html")}, '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1))) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n, CAST(0 AS BIGINT) AS misplaced FROM t WHERE tag NOT IN ('html', 'head', 'body') GROUP BY 1, 2""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: every page as a tree has the elements of its markup, and labels that nest."""
    labels = ["page_id", "enter", "leave", "depth", "parent"]
    tree = stored(html.nodes(table(spark, sf_dir, "pages"), ("page_id",)).select(*labels, "tag", "implied"))  # read twice, parsed once
    wrong = html.misplaced(tree.select(*labels), ("page_id",)).select("page_id", "enter", F.lit(1).alias("wrong"))
    found = tree.join(wrong, ["page_id", "enter"], "left").where("tag <> '#text' and not implied")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.count("wrong").alias("misplaced"))


_SPANS = ("title", "nav", "li", "article", "h1", "footer", "div")


@query(
    f"WITH p AS (SELECT page_id, {_PLAIN.format('html')} AS h FROM pages), "
    + "e AS ("
    + " UNION ALL ".join(rf"SELECT page_id, '{t}' AS tag, generate_subscripts(regexp_extract_all(h, '<{t}(?:\s[^>]*)?>(.*?)</{t}>', 1, 's'), 1) AS nth, unnest(regexp_extract_all(h, '<{t}(?:\s[^>]*)?>(.*?)</{t}>', 1, 's')) AS body FROM p" for t in _SPANS)
    + f") SELECT page_id, tag, nth, {_decoded("regexp_replace(body, '<[^>]*>', '', 'g')")} AS text FROM e"
)
def element_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-9: the whole text of elements of seven kinds, nested and flat, from the ranges of their labels."""
    tree = html.with_text(stored(html.nodes(table(spark, sf_dir, "pages"), ("page_id",))), ("page_id",))  # read twice, parsed once
    nth = F.row_number().over(W.partitionBy("page_id", "tag").orderBy("enter")).cast("long")
    return tree.where(F.col("tag").isin(*_SPANS)).select("page_id", "tag", nth.alias("nth"), F.col("inner").alias("text"))


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markup that the passes have something to do with: twelve kinds of elements in turn, one for each line."""
    def marked(line: Column, n: Column) -> Column:
        text, no = F.concat(F.lit("x"), F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))), n.cast("string")
        kinds = (
            ('<p class="align-right x">', text, "</p>"), ('<div class="chapter-marker"><b>', text, "</b></div>"), ('<div class="page-label" data-page="', no, '">', text, "</div>"), ('<hr class="page-break"/>',),
            ('<div class="note-space" title="t" data-space-lines="', no, '">', text, "</div>"), ('<p style="font-weight: bold; page-break-before: always">', text, "</p>"), ('<table class="big user-table"><tr><td class="c align-left">', text, "</td></tr></table>"),
            ("<p>33 And ", text, "</p>"), ("<ul><li>", text, "</ul>"), ("<p> </p>",), ('<img class="selected" title="t" src="', no, '" data-width="', no, '"/>'), ('<p class="size-88 size-100"><span class="tab more">', text, "</span><i>", text, "</i></p>"),
        )
        one: Column | None = None
        for i, parts in enumerate(kinds):
            made = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
            one = (F if one is None else one).when(n % len(kinds) == i, made)
        return one

    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), marked), "").alias("html"))


_KINDS = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), t AS (SELECT doc_id, n, n % 12 AS k, 'x' || line AS t, CAST(n AS VARCHAR) AS s, n = max(n) OVER (PARTITION BY doc_id) AS last FROM l),
r(k, sub, tag, classes, attrs, text) AS (VALUES (0, 0, 'p', 'x align-right', 'data-align=right', ''), (0, 1, '#text', '', '', '@'), (2, 0, 'hr', 'page-break', 'data-page=#', ''), (3, 0, 'div', 'blank-page', '', ''), (4, 0, 'div', 'note-space space-%', 'data-space-lines=%', ''),
 (5, 0, 'p', 'break-before bold', '', ''), (5, 1, '#text', '', '', '@'), (6, 0, 'table', 'body-table user-table', '', ''), (6, 1, 'tbody', '', '', ''), (6, 2, 'tr', '', '', ''), (6, 3, 'td', 'align-left', 'data-align=left', ''), (6, 4, '#text', '', '', '@'),
 (7, 0, 'p', '', '', ''), (7, 1, 'sup', 'verse-num', '', ''), (7, 2, '#text', '', '', '33'), (7, 3, '#text', '', '', ' And @'), (8, 0, 'ul', '', '', ''), (8, 1, 'li', '', 'data-list-format=bullet', ''), (8, 2, '#text', '', '', '@'), (9, 0, 'p', '', '', ''), (9, 1, '#text', '', '', ' '),
 (10, 0, 'img', '', 'data-width=^;src=#', ''), (11, 0, 'p', 'size-88', 'data-size=88', ''), (11, 1, 'span', 'tab', '', ''), (11, 2, 'i', '', '', ''), (11, 3, '#text', '', '', '@'))
"""


@query(
    _KINDS
    + """, o AS (SELECT doc_id, n, sub, tag, r.text AS said, t, s, n AS num, last, classes, attrs FROM t JOIN r USING (k) WHERE k <> 9 OR last)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, sub) AS seq, tag, replace(classes, '%', CAST(greatest(2, least(12, num)) AS VARCHAR)) AS classes,
 replace(replace(replace(attrs, '%', CAST(greatest(2, least(12, num)) AS VARCHAR)), '^', CAST(CAST(greatest(25, least(100, floor(num / 5.0 + 0.5) * 5)) AS INTEGER) AS VARCHAR)), '#', s) AS attrs, replace(said, '@', t) AS text FROM o"""
)
def canonical_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-1: every node of documents in twelve kinds of markup, in canonical form."""
    found = body.canonical(html.nodes(_marked_up(spark, sf_dir), ("doc_id",), inner_of=body.TOLD), ("doc_id",))
    said = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    seq = F.row_number().over(W.partitionBy("doc_id").orderBy("enter")).cast("long")
    return found.select("doc_id", seq.alias("seq"), "tag", F.array_join("classes", " ").alias("classes"), said.alias("attrs"), F.coalesce("text", F.lit("")).alias("text"))


@query(
    _KINDS
    + """, c AS (SELECT doc_id, k, n, last FROM t),
p(k, pass, changed, dropped) AS (VALUES (0, 'alignment', 1, 0), (1, 'markers', 1, 3), (2, 'labels', 1, 1), (2, 'breaks', 1, 0), (3, 'blank pages', 1, 0), (4, 'spaces', 1, 1), (5, 'forced breaks', 1, 0), (5, 'typography', 1, 0), (6, 'alignment', 1, 0), (6, 'tables', 1, 0), (6, 'cells', 1, 0), (7, 'verse numbers', 3, 0), (8, 'lists', 1, 0), (9, 'empty paragraphs', 1, 2), (10, 'images', 1, 0), (11, 'size', 1, 0), (11, 'tabs', 1, 1))
SELECT doc_id, pass, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(dropped) AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS unstable, CAST(0 AS BIGINT) AS misplaced FROM c JOIN p USING (k) WHERE k <> 9 OR NOT last GROUP BY 1, 2"""
)
def canonical_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRE-1: how many nodes each pass changed and dropped in a document, what a second run would still change, and labels that do not nest: none."""
    keys = ("doc_id",)
    rows = stored(body.traced(html.nodes(_marked_up(spark, sf_dir), keys, inner_of=body.TOLD), keys))
    kept = rows.where("gone_by is null").drop("passes", "gone_by")
    left = body.unstable(kept, keys).select("doc_id", F.lit(1).alias("unstable"), F.lit(0).alias("misplaced"))
    wrong = html.misplaced(kept.select("doc_id", "enter", "leave", "depth", "parent"), keys).select("doc_id", F.lit(0).alias("unstable"), F.lit(1).alias("misplaced"))
    odd = left.unionByName(wrong).groupBy("doc_id").agg(F.sum("unstable").alias("unstable"), F.sum("misplaced").alias("misplaced"))
    changed = rows.select("doc_id", F.explode(F.array_distinct("passes")).alias("pass"), F.lit(1).alias("changed"), F.lit(0).alias("dropped"))
    dropped = rows.where("gone_by is not null").select("doc_id", F.col("gone_by").alias("pass"), F.lit(0).alias("changed"), F.lit(1).alias("dropped"))
    total = changed.unionByName(dropped).groupBy("doc_id", "pass").agg(F.sum("changed").cast("long").alias("changed"), F.sum("dropped").cast("long").alias("dropped"))
    return total.join(odd, "doc_id", "left").select("doc_id", "pass", "changed", "dropped", F.coalesce("unstable", F.lit(0)).cast("long").alias("unstable"), F.coalesce("misplaced", F.lit(0)).cast("long").alias("misplaced"))


_ITEMS = r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
k AS (SELECT doc_id, seq, 'x' || line AS text, seq % 11 <> 10 AS is_list, (seq * seq + doc_id) % 4 AS level, CASE (seq // 3 + doc_id) % 3 WHEN 0 THEN 'bullet' WHEN 1 THEN 'decimal' ELSE 'lowerLetter' END AS format FROM l),
i AS (SELECT *, seq // 11 AS run FROM k WHERE is_list), p AS (SELECT a.doc_id, a.seq, a.run, a.text, a.level, a.format, max(b.seq) AS parent FROM i a LEFT JOIN i b ON a.doc_id = b.doc_id AND a.run = b.run AND b.seq < a.seq AND b.level < a.level GROUP BY ALL),
f AS (SELECT *, coalesce(lag(format) OVER w = format AND lag(level) OVER w = level, false) AS same FROM p WINDOW w AS (PARTITION BY doc_id, run, parent ORDER BY seq)),
d AS (SELECT doc_id, seq, 1 AS depth FROM f WHERE parent IS NULL UNION ALL SELECT f.doc_id, f.seq, d.depth + 1 FROM f JOIN d ON f.doc_id = d.doc_id AND f.parent = d.seq)
"""


@query(
    _ITEMS
    + """SELECT doc_id, run, CAST(count(*) AS BIGINT) AS items, CAST(count(*) FILTER (WHERE NOT same) AS BIGINT) AS lists, CAST(count(*) FILTER (WHERE NOT same AND format = 'bullet') AS BIGINT) AS unordered, CAST(max(depth) AS INTEGER) AS deepest,
 string_agg(CAST(depth AS VARCHAR), ',' ORDER BY seq) AS depths, md5(string_agg(text, '' ORDER BY seq)) AS text, CAST(0 AS BIGINT) AS unclosed, CAST(0 AS BIGINT) AS misplaced FROM f JOIN d USING (doc_id, seq) GROUP BY 1, 2"""
)
def rebuilt_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SEQ-18, SEQ-12: lines of documents as items of four levels and three kinds, rebuilt as lists and read again as a tree: items, lists and depths by run, text kept, all closed."""
    n, doc = F.col("seq"), F.col("doc_id")
    kind = F.element_at(F.array(F.lit("bullet"), F.lit("decimal"), F.lit("lowerLetter")), ((F.floor(n / 3) + doc) % 3 + 1).cast("int"))
    lines = doc_lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("seq"), F.concat(F.lit("x"), "line").alias("text"))
    items = lines.select("doc_id", "seq", "text", (n % 11 != 10).alias("is_list"), ((n * n + doc) % 4).cast("int").alias("level"), kind.alias("format"))
    events = stored(structure.list_events(structure.nested(items)))
    open_now = F.when(F.col("event") == "open", 1).otherwise(-1)
    run = F.floor(F.min("seq") / 11).cast("long").alias("place")
    lists = (F.col("event") == "open") & (F.col("tag") != "li")
    told = events.groupBy("doc_id", "run").agg(run, F.count_if((F.col("event") == "open") & (F.col("tag") == "li")).alias("items"), F.count_if(lists).alias("lists"), F.count_if(lists & (F.col("tag") == "ul")).alias("unordered"), F.sum(open_now).cast("long").alias("unclosed"))
    tree = stored(html.nodes(structure.lists_html(events), ("doc_id", "run")))
    wrong = html.misplaced(tree.select("doc_id", "run", "enter", "leave", "depth", "parent"), ("doc_id", "run")).groupBy("doc_id", "run").agg(F.count("*").alias("misplaced"))
    depth = (F.col("depth") / 2).cast("int")
    rows = F.array_sort(F.collect_list(F.when(F.col("tag") == "li", F.struct("enter", (depth + 1).cast("string").alias("d")))))
    text = F.array_sort(F.collect_list(F.when(F.col("tag") == "#text", F.struct("enter", "text"))))
    seen = tree.groupBy("doc_id", "run").agg(F.array_join(F.transform(rows, lambda r: r["d"]), ",").alias("depths"), F.md5(F.array_join(F.transform(text, lambda r: r["text"]), "")).alias("text"), F.max(F.when(F.col("tag") == "li", depth + 1)).alias("deepest"))
    return told.join(seen, ["doc_id", "run"]).join(wrong, ["doc_id", "run"], "left").select("doc_id", F.col("place").alias("run"), "items", "lists", "unordered", "deepest", "depths", "text", "unclosed", F.coalesce("misplaced", F.lit(0)).cast("long").alias("misplaced"))
