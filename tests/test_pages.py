"""Whole pages: grouping of lines, reading columns, tables, spaces, failures, kinds, counters."""

from __future__ import annotations

import pytest

from pagelift.operators import pages

LINES = "page int, line_no int, text string, y double, x_start double, x_end double, line_height double, max_height double, char_width double, family string, size double, bold boolean"
ITEMS = "doc_id long, page int, item_seq long, str string, transform array<double>, width double, height double, font_name string"
PAGES = "doc_id long, page int, has_grid boolean, error string, n_ops int, n_images int"


@pytest.fixture
def grouped(spark):
    def of(*lines):
        """(text, y, height, bold) of each line."""
        rows = [(1, i, t, float(y), 72.0, 72.0 + 4 * len(t), float(h), float(h), 4.0, "serif", float(h), b) for i, (t, y, h, b) in enumerate(lines)]
        out = pages.text_blocks(spark.createDataFrame(rows, LINES), ("page",)).orderBy("block_no").collect()
        return [(r.type, r.level, r.text) for r in out]

    return of


def test_paragraphs_and_headings(grouped):
    long = "these are words that fill the whole of a line on the page, as it seems"
    assert grouped(("Chapter One", 800, 20, True), (long + " inter-", 770, 11, False), ("national and more words here.", 756, 11, False), ("A new one begins.", 700, 11, False)) == [
        ("heading", 1, "Chapter One"), ("paragraph", None, f"{long} international and more words here."), ("paragraph", None, "A new one begins."),
    ]
    # headings of one level that follow closely are one; one that follows a paragraph closely is text
    assert grouped(("A BIG TITLE", 800, 22, True), ("OF TWO LINES", 776, 22, True), (long, 730, 11, False), (long, 716, 11, False), (long, 702, 11, False)) == [("heading", 1, "A BIG TITLE\nOF TWO LINES"), ("paragraph", None, " ".join([long] * 3))]
    close = grouped((long, 800, 11, False), ("and SO ON", 788, 11, False), (long, 776, 11, False))
    assert [k for k, _, _ in close] == ["paragraph"]


def item(doc, page, seq, text, x, y, height=11.0, font="Times"):
    return doc, page, seq, text, [height, 0.0, 0.0, height, float(x), float(y)], 4.0 * len(text), height, font


def test_columns_tables_spaces_and_failures(spark):
    items = []
    for k in range(16):  # document 1, page 1: two columns
        items += [item(1, 1, 2 * k, f"left words {k} of the text", 72, 780 - 24 * k), item(1, 1, 2 * k + 1, f"right words {k} of it", 330, 780 - 24 * k)]
    items += [item(1, 2, 0, "Before the gap there is a line of text.", 72, 780), item(1, 2, 1, "Another line of text follows it here.", 72, 766), item(1, 2, 2, "And one more.", 72, 752), item(1, 2, 3, "After the gap.", 72, 560), item(1, 2, 4, "1. An item", 72, 480)]
    items += [item(1, 3, 0, "lost", 72, 780)]  # a page that could not be read
    items += [(1, 4, 0, "no place", None, 1.0, 1.0, "x"), (1, 4, 1, None, [1.0] * 6, 1.0, 1.0, None)]
    for r in range(4):  # page 6: a table
        items += [item(1, 6, 3 * r + c, f"cell {r} {c}", 72 + 150 * c, 700 - 14 * r, font="Times-Bold" if r == 0 else "Times") for c in range(3)]
    known = [(1, p, p == 6, "broken" if p == 3 else None, 0 if p == 5 else 3, 0) for p in range(1, 7)]
    items_df, pages_df = spark.createDataFrame(items, ITEMS), spark.createDataFrame(known, PAGES)
    blocks = pages.blocks(items_df, pages_df).cache()
    got = {}
    for r in blocks.orderBy("page", "seq").collect():
        got.setdefault(r.page, []).append(r)
    one = got[1]
    assert {r.column for r in one} == {"left", "right"} and " ".join(r.text for r in one if r.column == "left").split() == [w for k in range(16) for w in f"left words {k} of the text".split()]
    assert [(r.type, r.text or r.space_lines) for r in got[2]][0] == ("paragraph", "Before the gap there is a line of text. Another line of text follows it here. And one more.")
    assert [r.type for r in got[2]] == ["paragraph", "spacer", "paragraph", "spacer", "list_item"] or [r.type for r in got[2]] == ["paragraph", "spacer", "paragraph", "list_item"]
    assert (got[2][-1].format, got[2][-1].text, got[2][-1].marker) == ("decimal", "An item", "1.")
    assert [(r.type, r.text) for r in got[3]] == [("failed", "(Failed to extract page 3: broken)")] and 4 not in got and 5 not in got
    assert [(r.type, r.cells) for r in got[6]] == [("table", [f"cell {r} {c}" for c in range(3)]) for r in range(4)]
    kinds = pages.kinds(blocks, pages_df)
    assert {r.page: r.kind for r in kinds.collect()} == {1: "text", 2: "text", 3: "failed", 4: "image", 5: "blank", 6: "text"}
    s = pages.summary(blocks, kinds).first()
    assert (s.pages, s.table_rows, s.list_items, s.column_pages, s.failed_pages, s.image_pages, s.blank_pages) == (6, 4, 1, 1, [3], [4], [5])
    assert pages.blocks(items_df.limit(0), pages_df.limit(0)).count() == 0


def test_texts_are_stored_once_and_not_joined(spark):
    """Lines carry their text from the items to the stored rows over one partitioning by page; what comes after reads these."""
    items = spark.createDataFrame([item(1, 1, k, f"some words {k}", 72, 780 - 14 * k) for k in range(9)], ITEMS)
    made = pages.lines(items.selectExpr("*", "transform[4] x", "transform[5] y", "str text", "4.0d char_width", "false space_before"), ("doc_id", "page"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert [(r.line_no, r.text) for r in made.orderBy("line_no").collect()] == [(k, f"some words {k}") for k in range(9)]
