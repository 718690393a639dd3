"""Layout, structure, comparison, images and packages on small tables."""

from __future__ import annotations

import base64
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.operators import diff, images, layout, markup, package, structure, tables
from pagelift.sources import documents as S

PNG = base64.b64encode(bytes.fromhex("89504E470D0A1A0A") + b"rest").decode()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_whitespace(spark):
    ys = [(795, 18), (773.3, 18), (679.2, 13), (654.8, 13), (626.3, 13), (597.8, 13), (425.2, 13)]
    lines = spark.createDataFrame([(1, 1, i, float(y), float(h), None) for i, (y, h) in enumerate(ys)], "doc_id long, page int, line_no int, y double, max_height double, line_height double")
    got = rows(layout.whitespace(lines, 842.2).select("line_no", "space_lines"))
    assert [n for n, _ in got] == [1, 5] and got[1][1] >= 10
    even = spark.createDataFrame([(1, 1, i, y, 13.0, None) for i, y in enumerate((100.0, 78.0, 56.0, 34.0))], lines.schema)
    assert layout.whitespace(even, 842.2).count() == 0


def test_clusters(spark):
    xs = spark.createDataFrame([(1, float(x)) for x in (10, 12, 100, 102, 200)], "page int, x double")
    assert [c for _, _, c in rows(layout.column_centres(xs, 5.0, ("page",)))] == [11, 101, 200]
    items = spark.createDataFrame([(1, 0, 9.0, 748.0, 6.6), (1, 1, 5.0, 744.0, 11.0), (1, 2, 90.0, 700.0, 11.0), (1, 3, 40.0, 701.5, 11.0)], "page int, item_seq int, x double, y double, height double")
    assert [(s, n, k) for _, s, n, _, k in rows(layout.cluster_lines(items, ("page",)))] == [(0, 0, 1), (1, 0, 0), (2, 1, 1), (3, 1, 0)]


def test_baselines_come_first(spark):
    ys = spark.createDataFrame([([10.0, 12.9, 13.5, 7.5, 30.0, 16.4],)], "ys array<double>")
    assert ys.select(layout.baselines(F.col("ys")).alias("b")).first().b == [10.0, 13.5, 30.0]  # 16.4 is within 3 of 13.5


def test_hyphens_and_breaks(spark):
    lines = spark.createDataFrame([(1, 0, "reconstruc-"), (1, 1, "tion"), (1, 2, "hello"), (1, 3, "world")], "d int, line_no int, text string")
    assert [t for _, _, t in rows(layout.joined_hyphens(lines, ("d",)))] == ["reconstruction", "hello", "world"]


def test_reading_columns_need_a_gutter(spark):
    def items(width):
        out = []
        for i in range(20):
            y = 800.0 - 30 * i
            out += [(1, 2 * i, 72.0, y, width, "left words here"), (1, 2 * i + 1, 330.0, y, 150.0, "right words here")]
        return spark.createDataFrame(out, "page int, item_seq int, x double, y double, width double, text string")

    assert layout.reading_columns(items(150.0), 596.0, 842.0, ("page",)).first().split == pytest.approx(201.0)
    assert layout.reading_columns(items(315.0), 596.0, 842.0, ("page",)).count() == 0  # the left crosses it


def test_styles(spark):
    styles = spark.createDataFrame([(1, "a", None, True, None), (1, "b", "a", None, True), (1, "c", "b", False, None), (1, "x", "y", True, None), (1, "y", "x", None, False)], "doc_id int, style_id string, based_on string, bold boolean, italic boolean")
    got = {r.style_id: (r.bold, r.italic) for r in structure.resolved_styles(styles, ("bold", "italic")).collect()}
    assert got == {"a": (True, None), "b": (True, True), "c": (False, True), "x": (True, False), "y": (True, False)}
    uses = spark.createDataFrame([(1, 1, "b", ["firstRow"]), (1, 2, "b", [])], "doc_id int, use_id int, style_id string, parts array<string>")
    parts = spark.createDataFrame([(1, "a", "firstRow", False, True)], "doc_id int, style_id string, part string, bold boolean, italic boolean")
    assert rows(structure.table_traits(uses, styles, parts, ("firstRow",), ("bold", "italic"))) == [(1, 1, False, True), (1, 2, True, True)]


def test_writing_spaces_and_separators(spark):
    p = spark.createDataFrame([(1, 0, True, "Answer", 0.0), (1, 1, False, "", 120.0), (1, 2, False, "", 0.0), (1, 3, False, "", 0.0), (1, 4, True, "Next", 0.0), (1, 5, False, "", 0.0), (1, 6, True, "End", 0.0)], "doc_id int, seq int, visible boolean, text string, spacing_before double")
    p = p.withColumns({"spacing_line": F.lit(240.0), "spacing_after": F.lit(0.0), "breaks": F.lit(0)})
    assert rows(structure.writing_spaces(p)) == [(1, 0, "answer", "next", 3, 4)]
    runs = [(1, 0, True, True)] + [(1, i, False, False) for i in range(1, 26)] + [(1, 26, True, True)]
    assert structure.without_separators(spark.createDataFrame(runs, "doc_id int, seq int, visible boolean, is_list boolean")).count() == 2


def test_ordered_merges(spark):
    blocks = spark.createDataFrame([(1, 0, "notes"), (1, 1, "first answer"), (1, 2, "notes"), (1, 3, "second answer")], "doc_id long, seq long, text_key string")
    spacing = spark.createDataFrame([(1, 0, "notes", "second answer", 3)], "doc_id long, after_seq long, after_key string, next_key string, lines int")
    assert rows(structure.spaced(blocks, spacing)) == [(1, 2, 3)]
    plan = spark.createDataFrame([(1, 0, "first answer"), (1, 1, "notes")], "doc_id long, plan_seq long, text_key string")
    assert rows(structure.planned(blocks, plan)) == [(1, 0, 1), (1, 1, 0)]  # two back from the cursor
    assert structure.planned(blocks, plan.limit(0)).count() == 0


def test_chapters_and_breaks(spark):
    b = spark.createDataFrame([(1, 0, "paragraph", " ", False), (1, 1, "break", None, False), (1, 2, "break", None, False), (1, 3, "heading", "One", True)], "doc_id int, seq int, type string, text string, is_h1 boolean")
    assert [t for _, _, t in rows(structure.page_breaks(b).select("doc_id", "seq", "type"))] == ["paragraph", "blank_page", "blank_page", "heading"]
    assert rows(structure.chapters(b).select("seq", "chapter_no", "chapter_title")) == [(3, 1, "One")]
    t = spark.createDataFrame([(1, 1, 0, True, False), (1, 1, 1, False, True), (1, 1, 2, False, False), (1, 1, 3, False, True)], "doc_id int, table_id int, row_no int, is_header boolean, break_before boolean")
    assert rows(structure.split_tables(t).select("part", "row_no")) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 3)]


def test_sequence_diff_replays():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        ops = diff.sequence_diff(a, b)
        assert [t for k, t in ops if k != "add"] == a and [t for k, t in ops if k != "del"] == b
    assert [k for k, _ in diff.sequence_diff(["a", "b"], ["b", "c"], most_cells=3)] == ["del", "del", "add", "add"]
    assert diff.sequence_diff(["a"], ["b"]) == [("del", "a"), ("add", "b")]


def test_block_changes(spark):
    before = spark.createDataFrame([(1, i, k, "s") for i, k in enumerate(["moved", "one", "two", "three"])], "doc_id long, seq long, key string, signature string")
    after = spark.createDataFrame([(1, 0, "one", "t"), (1, 1, "two b", "s"), (1, 2, "three", "s"), (1, 3, "moved", "s"), (2, 0, "new", "s")], before.schema)
    kinds = [(d, k) for d, _, k, *_ in rows(diff.block_changes(before, after))]
    assert kinds == [(1, "moved"), (1, "formatted"), (1, "replaced"), (2, "added")] or kinds.count((1, "moved")) == 1


def test_word_diff(spark):
    pairs = spark.createDataFrame([(1, "# One two", "## One three two"), (2, None, "x")], "k int, before string, after string")
    ops = diff.word_diff(pairs, ("k",)).select("k", F.posexplode("ops").alias("seq", "o")).select("k", "seq", "o.*")
    assert rows(diff.counters(ops, ("k",))) == [(1, 1, 0, 1), (2, 1, 0, 0)]


def test_data_urls(spark):
    urls = ["x", "data:text/plain,a", "data:image/bmp,a", "data:image/png;base64,%%%", "data:image/png,", "data:image/jpeg;base64," + PNG, "DATA:image/png;base64," + PNG, "data:image/svg+xml,<svg xmlns='http://www.w3.org/2000/svg'/>", "data:image/svg+xml,<svg", None]
    got = [r.problem for r in images.decoded(spark.createDataFrame(list(enumerate(urls)), "n int, src string")).orderBy("n").collect()]
    assert got == [*images.PROBLEMS, None, None, images.PROBLEMS[5], images.PROBLEMS[0]]


def test_assets_once(spark):
    src = "data:image/png;base64," + PNG
    df = spark.createDataFrame([(1, 0, src, "image/png"), (1, 1, "https://x/y.png", None), (1, 2, src, "image/png")], "doc_id int, img_no int, src string, media_type string")
    assert rows(images.packaged(df).select("img_no", "file_name")) == [(0, "image-1.png"), (1, None), (2, "image-1.png")]


def test_dither(spark):
    out = images.diffused(np.full((8, 8), 100.0))
    assert set(out.ravel().tolist()) <= {0, 255} and abs(out.mean() - 100) < 25
    assert images.pixels(bytes([0b10100000, 0b01000000]), 3, 2)[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]


def test_archive(spark):
    pub = spark.createDataFrame([(1, "A & B", None, "en", "urn:x", None)], "doc_id long, title string, author string, lang string, identifier string, modified timestamp").withColumn("modified", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    chapters = spark.createDataFrame([(1, 1, "One", "<p>a<br>b</p>"), (1, 2, None, "<p>c</p>")], "doc_id long, chapter_no int, title string, html string")
    assets = spark.createDataFrame([(1, 1, "img1", "image-1.png", "image/png", bytearray(b"x"))], "doc_id long, asset_no int, id string, file_name string, media_type string, content binary")
    archive = bytes(package.archives(package.package_files(pub, chapters, assets)).first().archive)
    names = list(package.entries(archive))
    assert names[0] == ("mimetype", zipfile.ZIP_STORED) and all(m == zipfile.ZIP_DEFLATED for _, m in names[1:])
    assert [n for n, _ in names] == ["mimetype", "META-INF/container.xml", "OEBPS/style.css", "OEBPS/images/image-1.png", "OEBPS/nav.xhtml", "OEBPS/toc.ncx", "OEBPS/chapter-1.xhtml", "OEBPS/chapter-2.xhtml", "OEBPS/content.opf"]
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        assert b"<p>a<br/>b</p>" in z.read("OEBPS/chapter-1.xhtml") and b"A &amp; B" in z.read("OEBPS/content.opf") and b"2024-01-02T03:04:05Z" in z.read("OEBPS/content.opf")
    assert package.asset_violations(assets.withColumn("id", F.lit("ch2")), chapters).first().problem == "duplicate id"
    assert package.publication_violations(pub.withColumn("identifier", F.lit(" ")), chapters).first().problem == "no identifier"


def test_word_packages(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="H"/><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:rPr><w:b/><w:i w:val="0"/></w:rPr><w:t>Hi</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:type="paragraph" w:styleId="H"><w:name w:val="Head"/><w:basedOn w:val="N"/></w:style></w:styles>')
    docs = spark.createDataFrame([(1, bytearray(buffer.getvalue())), (2, bytearray(b"no zip")), (3, None)], "doc_id long, content binary")
    got = S.word_packages(docs).collect()
    by = {(r.doc_id, r.part): r for r in got}
    assert by[1, "paragraph"].num_id == "3" and by[1, "paragraph"].text == "Hi" and by[1, "run"].bold is True and by[1, "run"].italic is False and by[1, "style"].based_on == "N"
    assert by[2, "error"].error and by[3, "error"].error


def test_text_sources(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\nb  \fc"), (2, None), (3, "")], "doc_id long, text string")
    assert rows(S.plain_text(docs)) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")]
    md = spark.createDataFrame([(1, "# T\n\n- a\n- b\n\n|a|b|\n|-|-|\f text")], "doc_id long, text string")
    assert [t for _, _, t, _, _ in rows(S.markdown(md))] == ["heading", "list", "table", "break", "paragraph"]
    assert [(t, x) for t, _, x in S.html_rows("<h1>A &amp; B</h1><p>c<br>d<script>x</script><img src='s'>")] == [("h1", "A & B"), ("img", "s"), ("p", "c d")]


def test_preferences(spark):
    kept = '{"device":"sage","orientation":"landscape","font":4.2,"margin":12,"chrome":false}'
    poor = '{"device":"none","orientation":"up","font":99,"margin":-4,"chrome":"false"}'
    df = spark.createDataFrame([(1, kept), (2, poor), (3, "{broken"), (4, '{"font":null}'), (5, None)], "n int, json string")
    got = {r.n: (r.device, r.orientation, r.font, r.margin, r.chrome) for r in S.preferences(df).collect()}
    assert got[1] == ("sage", "landscape", pytest.approx(4.2), 12, False) and got[2] == ("libra-colour", "portrait", pytest.approx(4.8), 3, True)
    assert got[3] == got[5] == ("libra-colour", "portrait", 3.6, 8, True) and got[4][2] == pytest.approx(2.6)


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 2, "b"), (1, 1, 1, " "), (1, 2, 0, "c"), (2, 0, 0, "x"), (2, 1, 0, "y")], "doc_id int, row int, column int, text string")
    assert rows(tables.built(cells, ("doc_id",))) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c"), (1, 1, 1, "")]
    lines = []
    for n, texts in enumerate([("Name", "Size", "Place"), ("a", "1", "x"), ("b", "2", "y"), ("plain words",), ("p", "3", "q"), ("r", "4", "s")]):
        own = [(100.0 * i, 100.0 * i + 20, t) for i, t in enumerate(texts)]
        lines.append((1, n, 700.0 - 14 * n, 12.0, n == 0, 4.0, own))
    df = spark.createDataFrame(lines, "doc_id int, line_no int, y double, line_height double, bold boolean, char_width double, cells array<struct<x:double,end:double,text:string>>")
    pages = spark.createDataFrame([(1, False)], "doc_id int, has_grid boolean")
    got = rows(tables.regions(df, pages, ("doc_id",)))
    assert [(n, t, r, h) for _, n, t, r, _, h in got] == [(0, 0, 0, True), (1, 0, 1, False), (2, 0, 2, False)]  # without a grid or header the last two lines are prose
    got = rows(tables.regions(df, pages.withColumn("has_grid", F.lit(True)), ("doc_id",)))
    assert [(n, t) for _, n, t, *_ in got] == [(0, 0), (1, 0), (2, 0), (4, 1), (5, 1)]
    flat = df.where("line_no < 3").select("doc_id", "line_no", "bold", "char_width", F.posexplode("cells").alias("column_no", "c")).select("doc_id", "line_no", "bold", "char_width", "column_no", "c.x", "c.text")
    assert tables.header_evidence(flat, ("doc_id",)).first().header is True


def test_runs_of_a_line(spark):
    parts = spark.createDataFrame([(1, 0, 0.0, 10.0, 5.0, 6.6, 748.0, "1", "s"), (1, 1, 10.5, 40.0, 5.0, 11.0, 744.0, "And every", "s"), (1, 2, 90.0, 20.0, 5.0, 11.0, 744.0, "far", "s"), (1, 3, 110.0, 20.0, 5.0, 11.0, 744.0, "ther", "s")], "line int, part_no int, x double, width double, char_width double, height double, y double, text string, signature string").withColumn("space_before", F.lit(False))
    assert rows(tables.runs_of_line(parts, ("line",)).select("text", "gap_level", "run_no"), "run_no") == [("1 And every", 0, 0), ("far", 2, 1), ("ther", 0, 2)]


def test_markup(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    t = value(markup.css_traits(F.lit("font-weight:600; text-decoration:none; FONT-STYLE: oblique 10deg")))
    assert (t.bold, t.italic, t.underline, t.strike) == (True, True, False, False)
    assert value(markup.titled(F.lit("<p>x</p>"), F.lit("A & B"))) == "<h1>A &amp; B</h1><p>x</p>"
    assert value(markup.without_marker(F.array(F.lit("1"), F.lit(". He"), F.lit("llo")), F.lit("1."))) == ["", "He", "llo"]
    assert value(markup.data_url(F.lit("image/png"), F.lit(b"x"))) == "data:image/png;base64,eA==" and value(markup.data_url(F.lit("text/plain"), F.lit(b"x"))) is None
    assert value(markup.raster_scale(F.lit(9.0))) == 2.5


def test_chains_of_any_length(spark):
    """Chains longer than any limit, one that ends in a cycle, and one whose last style is not there."""
    based = {f"s{i}": f"s{i + 1}" for i in range(100)} | {"c1": "c2", "c2": "c3", "c3": "c2", "n": "nowhere", "own": "own"}
    styles = spark.createDataFrame([(1, k, v) for k, v in based.items()], "doc_id int, style_id string, based_on string")
    want = set()
    for k in based:
        seen = []
        while k in based and k not in seen:
            seen.append(k)
            k = based[k]
        want |= {(1, seen[0], x, d) for d, x in enumerate(seen)}
    assert {tuple(r) for r in structure.style_chains(styles).collect()} == want


def test_flattened_lists(spark):
    """Random trees against a walk that dissolves the list of each wrapper into the list around it."""
    rng, nodes, want = random.Random(5), [], []

    def grow(path: list[int], tag: str, depth: int) -> dict:
        node = {"tag": tag, "text": rng.choice(["", " ", "words"]) if tag == "li" else "", "children": [], "seq": len(nodes)}
        own = [*path, node["seq"]]
        nodes.append((1, node["seq"], own, node["seq"], tag, node["text"]))
        if depth < 6:
            inner = "li" if tag in ("ul", "ol") else None
            for _ in range(rng.choice([1, 1, 2, 3]) if inner or tag == "div" else rng.choice([0, 0, 1, 1, 2])):
                node["children"].append(grow(own, inner or rng.choice(["ul", "ol", "ul", "p"]), depth + 1))
        return node

    def walk(node: dict, lists: list[str], in_wrapper: bool) -> None:
        wrapper = node["tag"] == "li" and not node["text"].strip() and [c["tag"] in ("ul", "ol") for c in node["children"]] == [True]
        if node["tag"] in ("ul", "ol") and not in_wrapper:
            lists = [*lists, node["tag"]]
        if node["tag"] == "li" and not wrapper:
            want.append((node["seq"], node["text"], "decimal" if lists[-1:] == ["ol"] else "bullet", max(len(lists) - 1, 0)))
        for c in node["children"]:
            walk(c, lists, wrapper)

    for _ in range(30):
        walk(grow([], "div", 0), [], False)
    got = structure.flattened_lists(spark.createDataFrame(nodes, "doc_id int, node_id int, path array<int>, seq int, tag string, text string"))
    assert sorted((r.seq, r.text, r.format, r.level) for r in got.collect()) == sorted(want) and len({w[3] for w in want}) > 2
