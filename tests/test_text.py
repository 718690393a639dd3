"""Text and number functions against the expectations that their rules state."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagelift.functions import numbers as N
from pagelift.functions import text as X


@pytest.fixture
def value(spark):
    def of(column):
        return spark.range(1).select(column.alias("v")).first().v

    return of


def test_escaping(value):
    assert value(X.escape_html(F.lit("a < b & c"))) == "a &lt; b &amp; c"
    assert value(X.escape_xml(F.lit("\x01\"'<"))) == "&quot;&apos;&lt;"
    assert value(X.decode_attribute(F.lit("&amp;lt;"))) == "<"
    assert value(X.escape_html(F.lit(None).cast("string"))) is None


def test_white_space_has_the_no_break_space(value):
    assert value(X.compact(F.lit("  a \n  b﻿"))) == "a b"
    assert value(X.match_key(F.lit(" A B "))) == "a b"
    assert value(X.shortened(F.lit("x" * 50))) == "x" * 41 + "…"


@pytest.mark.parametrize(("line", "kind", "level", "body"), [
    ("1. God goes", "decimal", 0, "God goes"), ("a. Nested point", "lowerLetter", 1, "Nested point"), ("• Bullet item", "bullet", 0, "Bullet item"), ("iv) x", "lowerRoman", 2, "x"), ("i. x", "lowerLetter", 1, "x"),
    ("XI. x", "upperRoman", 2, "x"), ("13:1-24 Moses", None, None, None), ("33 And your children", None, None, None), ("", None, None, None),
])
def test_list_markers(value, line, kind, level, body):
    got = value(X.list_marker(F.lit(line)))
    assert (got and (got.format, got.level, got.body)) == (kind and (kind, level, body))


def test_verse_markers(value):
    assert value(X.verse_marker(F.lit("13 The Lord"))).number == "13"
    assert value(X.verse_marker(F.lit("12a “So"))).rest == "“So"
    for text in ("1. Outline", "13:1 x", "The Lord"):
        assert value(X.verse_marker(F.lit(text))) is None
    assert value(X.verse_number(F.lit(" 33 "))) == "33"


@pytest.mark.parametrize(("name", "family", "bold", "italic"), [("AAAAAA+Amsterdam-Four", "script", False, False), ("CAAAAA+Montserrat-Bold", "sans", True, False), ("DAAAAA+PlayfairDisplay-Regular", "serif", False, False), ("Subset+Courier-Oblique", "mono", False, True)])
def test_fonts(value, name, family, bold, italic):
    got = value(X.font_traits(F.lit(name), "sans-serif"))
    assert (got.family, got.bold, got.italic) == (family, bold, italic)


def test_markdown(value):
    assert value(X.is_markdown_table(F.lit("| a | b |\n| --- | --- |\n| 1 | 2 |")))
    assert value(X.is_list_block(F.lit("1. a\n2. b\n3. c"))) and not value(X.is_list_block(F.lit("not a list")))
    table = value(X.markdown_table(F.lit("a|b\n-|-\n1|2|3\n4")))
    assert table.header == ["a", "b"] and table.body == [["1", "2"], ["4", ""]]
    assert value(X.inline_markdown(F.lit("**a** *b* `c` <d>"))) == "<strong>a</strong> <em>b</em> <code>c</code> &lt;d&gt;"


def test_spacing_and_fragments(value):
    assert value(X.token_spacing(F.lit("Date:Monday at:9am 3rdJune a;Bc"))) == "Date: Monday at: 9am 3rd June a; Bc"
    assert value(X.xhtml_fragment(F.lit("a<br>b & c &amp; 1 < 2 <img src='x'/>"))) == "a<br/>b &amp; c &amp; 1 &lt; 2&#160;<img src='x'/>"
    assert value(X.pretty_html(F.lit("<p>a</p><p>b</p>"))) == "<p>a</p>\n<p>b</p>"
    assert value(X.image_sources(F.lit("<img src=\"a&amp;b\"><img alt='x' src='c'><img src=d>"))) == ["a&b", "c", "d"]
    assert value(X.word_count(X.rendered_text(F.lit("<h1>One two</h1><p>three<br>four</p><p>five</p>")))) == 5


def test_script_segments(value):
    got = [(s.text, s.complex) for s in value(X.script_segments(F.lit(" abc שלום x")))]
    assert got == [(" abc ", False), ("שלום ", True), ("x", False)]


@pytest.mark.parametrize(("given", "want"), [((4.2, 2.6, 4.8, 0.2, 0.0), 4.2), ((99, 2.6, 4.8, 0.2, 0.0), 4.8), ((-4, 3.0, 16.0, 1.0, 0.0), 3), (("nope", 3.0, 16.0, 1.0, 8.0), 8), ((3.7, 2.6, 4.8, 0.2, 0.0), 3.8)])
def test_sliders(value, given, want):
    v, low, high, step, default = given
    assert value(N.slider(F.lit(str(v)), low, high, step, default)) == pytest.approx(want)


def test_image_width_for_page(value):
    def width(w, h, fit, n, block):
        return value(N.image_width_for_page(F.lit(float(w)), F.lit(float(h)), F.lit(float(fit)), F.lit(n), F.lit(block), F.lit(1264.0), F.lit(1680.0)))

    assert width(1000, 1000, 72, 1, True) == 95 and width(600, 1200, 50, 1, True) == 30 and width(1600, 900, 80, 2, False) == 60


def test_toggles(value):
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert value(N.toggle(f, F.array(t, t), n)) is False and value(N.toggle(f, F.array(t, n), n)) is True
    assert value(N.toggle(t, F.array(t, t), n)) is True and value(N.toggle(t, F.array(t), f)) is False
    assert value(N.override(f, t, f, n, n)) is False


def test_file_sizes(value):
    assert [value(N.file_size(F.lit(n))) for n in (0, 1023, 1536, 20480, 3 << 20)] == ["0 B", "1023 B", "1.5 KB", "20 KB", "3.0 MB"]
