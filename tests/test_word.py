"""Word-processor packages to documents."""

from __future__ import annotations

import io
import zipfile

from pagelift.plans import words
from pagelift.sources import word

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def packed(body: str) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", words._STYLES)
        z.writestr("word/numbering.xml", words._NUMBERING)
    return bytearray(out.getvalue())


def p(text: str, props: str = "", run: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr>" + (f"<w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r>" if text else "") + "</w:p>"


def test_blocks_runs_and_summary(spark):
    item = '<w:numPr><w:ilvl w:val="1"/><w:numId w:val="1"/></w:numPr>'
    body = (
        p("Title", '<w:pStyle w:val="Head"/>') + p("one", item) + p("") + p("two", item) + p("12 And a verse") + p("", '<w:spacing w:line="480"/>') + p("") + p("last", "<w:pageBreakBefore/>", '<w:b w:val="0"/><w:u w:val="single"/>')
        + '<w:p><w:r><w:t>x</w:t><w:br w:type="page"/></w:r></w:p>'
    )
    packages = spark.createDataFrame([(1, packed(body)), (2, bytearray(b"no zip")), (3, None)], "doc_id long, content binary")
    rows = word.rows(packages)
    blocks = word.blocks(rows).cache()
    got = [(r.type, r.text, r.format, r.level, r.lines) for r in blocks.orderBy("seq").collect() if r.type != "paragraph" or r.text]
    assert got == [
        ("paragraph", "Title", None, None, None), ("list_item", "one", "lowerLetter", 1, None), ("list_item", "two", "lowerLetter", 1, None), ("paragraph", "12 And a verse", None, None, None), ("space", None, None, None, 3),
        ("break", None, None, None, None), ("paragraph", "last", None, None, None), ("paragraph", "x", None, None, None), ("break", None, None, None, None),
    ]
    traits = {r.text: (r.bold, r.underline) for r in word.runs(rows).collect()}
    assert traits["Title"] == (True, False) and traits["last"] == (False, True) and traits["one"] == (False, False)
    s = {r.doc_id: r for r in word.summary(packages, rows, blocks).collect()}
    assert (s[1].paragraphs, s[1].list_items, s[1].spaces, s[1].page_breaks, s[1].verses, s[1].error) == (4, 2, 1, 2, 1, None)
    assert s[2].error and s[3].error and s[2].paragraphs == 0


def test_rows_move_once(spark):
    """Blocks of packages come of one partitioning by package: no step after it moves their text again."""
    long = packed("".join(p(f"line {i}", "<w:pageBreakBefore/>" if i % 1000 == 5 else "") for i in range(9000)))
    rows = word.rows(spark.createDataFrame([(1, long), (2, bytearray(b"no zip")), (3, packed(p("a") + p("b")))], "doc_id long, content binary").coalesce(1))
    assert {(r.doc_id, r.part): r["count"] for r in rows.groupBy("doc_id", "part").count().collect() if r.part in ("paragraph", "run", "error")} == {(1, "paragraph"): 9000, (1, "run"): 9000, (2, "error"): 1, (3, "paragraph"): 2, (3, "run"): 2}
    blocks = word.blocks(rows)
    assert "ENSURE_REQUIREMENTS" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.type): r["count"] for r in blocks.groupBy("doc_id", "type").count().collect()} == {(1, "paragraph"): 9000, (1, "break"): 9, (3, "paragraph"): 2}


def test_two_definitions_of_one_number(spark):
    """Of two the least holds, and no paragraph is doubled."""
    twice = words._NUMBERING.replace("</w:numbering>", '<w:num w:numId="1"><w:abstractNumId w:val="8"/></w:num></w:numbering>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{p("one", "<w:numPr><w:numId w:val=" + chr(34) + "1" + chr(34) + "/></w:numPr>")}</w:body></w:document>')
        z.writestr("word/numbering.xml", twice)
    rows = word.rows(spark.createDataFrame([(1, bytearray(out.getvalue()))], "doc_id long, content binary"))
    assert [(r.text, r.format, r.level) for r in word.blocks(rows).collect()] == [("one", "decimal", 0)]
