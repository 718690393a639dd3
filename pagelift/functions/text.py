"""Text functions as Column expressions: escaping, keys, markers, fonts, Markdown, HTML fragments.

White space is that of ECMAScript (with the no-break space and the byte-order mark), so ``trim`` and ``\\s`` are spelt out. Strings are counted in code
points. A null argument gives null, unless a docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Members of a character class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_QUOTE = "“\""


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def right_trimmed(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WS_CHARS))


def bound(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def compact(c: Column) -> Column:
    """White space made single spaces and cut at the ends."""
    return trimmed(F.regexp_replace(c, f"[{WS}]+", " "))


def shortened(c: Column, limit: int = 42) -> Column:
    text = compact(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def match_key(c: Column) -> Column:
    """What plans and blocks are matched by."""
    return F.lower(compact(c))


def plain_paragraph(parts: Column) -> Column:
    """Text of a paragraph from the texts of its runs."""
    return compact(F.array_join(parts, ""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def without_control(c: Column) -> Column:
    """Without characters that XML 1.0 forbids; tab, line feed and carriage return stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]", "")


def escape_xml(c: Column) -> Column:
    return F.replace(F.replace(escape_html(without_control(c)), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def decode_attribute(c: Column) -> Column:
    """References of an attribute, the ampersand first, so that a reference escaped twice is decoded twice."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def slug(c: Column, fallback: str = "document") -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), r"^-|-\z", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def token_spacing(c: Column) -> Column:
    """Spaces that page text lacks: after a colon or semicolon before a word or an hour, after an ordinal before a word."""
    c = F.regexp_replace(c, "([:;])(?=[A-Z][a-z])", "$1 ")
    c = F.regexp_replace(c, r"(?i):(?=\d{1,2}(?:am|pm)\b)", ": ")
    return F.regexp_replace(c, r"(\d(?:st|nd|rd|th))(?=[A-Z][a-z])", "$1 ")


def list_marker(c: Column, indent: Column | int = 0) -> Column:
    """struct(format, level, marker, body) of a line that starts as a list item, else null. Scripture references and verse numbers do not; a single
    letter is a letter, never a numeral."""
    indent = F.lit(indent) if isinstance(indent, int) else indent
    gap = f"[{WS}]+"
    # fixed values: kinds of markers in the order in which they are tried
    kinds = [
        ("bullet", "([•●▪◦‣∙·])", 0), ("bullet", "([-*+])", 0), ("decimal", r"(\d{1,3}[.)])", 0), ("lowerLetter", "([a-z][.)])", 1),
        ("upperLetter", "([A-Z][.)])", 1), ("lowerRoman", "([ivxlcdm]{1,6}[.)])", 2), ("upperRoman", "([ivxlcdmIVXLCDM]{1,6}[.)])", 2),
    ]

    def of(text: Column) -> Column:
        any_kind = rf"^(?:{'|'.join(marker for _, marker, _ in kinds)}){gap}.*\z"
        out = F.when(~text.rlike(any_kind) | text.rlike(r"^\d{1,3}:\d") | (text.rlike(rf'^\d{{1,3}}{gap}[{_QUOTE}A-Za-z]') & ~text.rlike(rf"^\d{{1,3}}[.)][{WS}]")), F.lit(None))
        for kind, marker, least in kinds:
            whole = rf"^{marker}{gap}(.*)\z"
            level = F.greatest(F.lit(least), F.when(indent == 0, F.lit(least)).otherwise(indent)).cast("int")
            out = out.when(text.rlike(whole), F.struct(F.lit(kind).alias("format"), level.alias("level"), F.regexp_extract(text, whole, 1).alias("marker"), F.regexp_extract(text, whole, 2).alias("body")))
        return out

    return bound(trimmed(F.replace(c, F.lit("\u00a0"), F.lit(" "))), of)


def verse_marker(c: Column) -> Column:
    """struct(number, rest) of a text that starts with a verse number, else null; ``1. x`` and ``13:1`` do not."""
    text = F.regexp_replace(c, rf"^[{WS}]+", "")
    whole = rf'^(\d{{1,3}}[a-zA-Z]?)([.{WS}]+)(?=[{_QUOTE}A-Za-z(])'
    numbered = rf"^\d{{1,3}}\.[{WS}]"
    return F.when(text.rlike(whole) & ~text.rlike(numbered), F.struct(F.regexp_extract(text, whole, 1).alias("number"), F.regexp_replace(text, whole, "").alias("rest")))


def verse_number(c: Column) -> Column:
    """The number that a raised or lowered run consists of, else null."""
    text = trimmed(F.replace(c, F.lit("\u00a0"), F.lit(" ")))
    return F.when(text.rlike(r"^\d{1,3}[a-zA-Z]?\z"), text)


def font_name(c: Column) -> Column:
    """A font's name without its subset tag."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"^[A-Z]{6}\+", ""), "[_-]+", " "))


# fixed values: parts of font names by family, in order of precedence
FAMILIES = {
    "script": "script|hand|brush|calligraph|amsterdam|cursive",
    "mono": "mono|courier|consolas|menlo|typewriter|code",
    "serif": "serif|times|georgia|garamond|baskerville|palatino|playfair|cooper|cambria|bookman|didot|bodoni|caslon|lora|merriweather|constantia",
    "sans": "sans|arial|helvetica|montserrat|garet|canva|roboto|calibri|avenir|verdana|futura|gotham|lato",
}
WEIGHTS = {"bold": "bold|black|heavy|semibold|semi bold|demi", "italic": "italic|oblique|slanted", "light": "light|thin|extralight|extra light"}


def font_traits(name: Column, fallback: Column | str = "") -> Column:
    """struct(source_name, family, bold, italic, light); a null name takes the fallback family's."""
    fallback = F.coalesce(F.lit(fallback) if isinstance(fallback, str) else fallback, F.lit(""))
    source = font_name(F.coalesce(F.nullif(name, F.lit("")), fallback))
    own, both = F.lower(source), F.lower(F.concat(source, F.lit(" "), fallback))
    given = F.lower(fallback)
    default = F.when(given.rlike(r"\bserif\b") & ~given.rlike(r"\bsans[- ]?serif\b"), F.lit("serif")).otherwise(F.lit("sans"))
    family = None
    for kind, pattern in FAMILIES.items():
        family = (F if family is None else family).when(own.rlike(pattern), F.lit(kind))
    shown = F.coalesce(F.nullif(source, F.lit("")), F.nullif(fallback, F.lit("")), F.lit("Unknown"))
    return F.struct(shown.alias("source_name"), family.otherwise(default).alias("family"), *[both.rlike(p).alias(k) for k, p in WEIGHTS.items()])


def word_list_format(c: Column) -> Column:
    """Our list format for a word processor's; null and blank are decimal."""
    v = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(v.isin("bullet", "none"), F.lit("bullet"))
    for name in ("lowerLetter", "upperLetter", "lowerRoman", "upperRoman"):
        out = out.when(v == name.lower(), F.lit(name))
    return out.when(v.isin("decimal", "decimalzero", ""), F.lit("decimal")).otherwise(v)


def list_tag(fmt: Column) -> Column:
    return F.when(fmt == "bullet", F.lit("ul")).otherwise(F.lit("ol"))


def list_style(fmt: Column) -> Column:
    """The CSS list style of a format."""
    out = F.when(fmt == "bullet", F.lit("disc"))
    for ours, css in (("lowerLetter", "lower-alpha"), ("upperLetter", "upper-alpha"), ("lowerRoman", "lower-roman"), ("upperRoman", "upper-roman")):
        out = out.when(fmt == ours, F.lit(css))
    return out.otherwise(F.lit("decimal"))


def inline_markdown(c: Column) -> Column:
    """Escaped, then bold, italic and code."""
    c = F.regexp_replace(escape_html(c), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"\*(.+?)\*", "<em>$1</em>")
    return F.regexp_replace(c, "`([^`]+)`", "<code>$1</code>")


def filled_lines(c: Column) -> Column:
    """The trimmed lines of a block that hold something."""
    return F.filter(F.transform(F.split(trimmed(c), "\n"), trimmed), lambda x: x != "")


def is_markdown_table(c: Column) -> Column:
    lines = filled_lines(c)
    separator = F.regexp_replace(F.get(lines, F.lit(1)), f"[{WS}]", "")
    return F.coalesce((F.size(lines) >= 2) & F.forall(lines, lambda x: F.contains(x, F.lit("|"))) & separator.rlike(r"^\|?[:\-]+(\|[:\-]+)+\|?\z"), F.lit(False))


_ITEM = rf"^[{WS}]*([-*+]|\d+\.)[{WS}]+"


def is_list_block(c: Column) -> Column:
    lines = F.filter(F.split(trimmed(c), "\n"), lambda x: trimmed(x) != "")
    return (F.size(lines) > 0) & F.forall(lines, lambda x: x.rlike(_ITEM))


def list_block(c: Column) -> Column:
    """struct(ordered, items): ordered by the first line alone."""
    lines = F.filter(F.split(trimmed(c), "\n"), lambda x: trimmed(x) != "")
    return F.struct(F.get(lines, F.lit(0)).rlike(rf"^[{WS}]*\d+\.").alias("ordered"), F.transform(lines, lambda x: inline_markdown(F.regexp_replace(x, _ITEM, ""))).alias("items"))


def table_row(c: Column) -> Column:
    """The cells of a line with pipes."""
    inner = F.regexp_replace(F.regexp_replace(trimmed(c), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(inner, r"\|"), trimmed)


def markdown_table(c: Column) -> Column:
    """struct(header, body): rows get the header's number of cells, by cutting or with empty ones."""
    lines = filled_lines(c)
    header = table_row(F.get(lines, F.lit(0)))
    width = F.size(header)
    body = F.transform(F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), lambda x: F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(table_row(x), i), F.lit(""))))
    return F.struct(header.alias("header"), body.alias("body"))


def diff_tokens(c: Column) -> Column:
    """Words for a diff; a heading line gives its level first."""
    hashes = F.length(F.regexp_extract(c, r"^(#{1,6}) ", 1))
    words = F.regexp_extract_all(c, F.lit(f"[^{WS}]+"), F.lit(0))
    return F.when(hashes > 0, F.concat(F.array(F.concat(F.lit("H"), hashes.cast("string"), F.lit(":"))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))))).otherwise(words)


def is_heading_token(c: Column) -> Column:
    return c.rlike(r"^H[1-6]:\z")


def image_sources(html: Column) -> Column:
    """The decoded sources of a fragment's images, in order."""
    pattern = r"""(?i)<img\b[^>]*?\ssrc\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda s: decode_attribute(F.regexp_replace(s, r"""^["']|["']\z""", "")))


_VOID = "br|hr|img|col|source|meta|link|input|area|base|embed|wbr"


def xhtml_fragment(html: Column) -> Column:
    """A fragment that an XML parser takes: void elements closed, references and stray signs escaped."""
    c = F.regexp_replace(without_control(html), rf"(?i)<({_VOID})(\s[^>]*?)?(?<!/)>", "<$1$2/>")
    c = F.replace(c, F.lit("\u00a0"), F.lit("&#160;"))
    c = F.regexp_replace(c, r"&(?![a-zA-Z][a-zA-Z0-9]*;|#[0-9]+;|#x[0-9a-fA-F]+;)", "&amp;")
    return F.regexp_replace(c, r"<(?![a-zA-Z/!])", "&lt;")


def pretty_html(html: Column) -> Column:
    c = F.regexp_replace(html, r"(?i)(</(?:div|p|h[1-6]|table|tr|figure|blockquote|ul|ol)>)(?=<)", "$1\n")
    return trimmed(F.regexp_replace(c, "\n{3,}", "\n\n"))


_BLOCK = "p|div|h[1-6]|li|ul|ol|table|thead|tbody|tfoot|tr|td|th|blockquote|figure|figcaption|pre|section|article|header|footer|nav|aside|dl|dt|dd|hr"


def rendered_text(html: Column) -> Column:
    """Text of a fragment: a space at breaks and at the ends of blocks, the commonest references decoded."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    c = F.regexp_replace(c, rf"(?i)<br\b[^>]*>|</(?:{_BLOCK})\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->|<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return compact(c)


def word_count(text: Column) -> Column:
    plain = F.translate(text, _WS_CHARS, " " * len(_WS_CHARS))
    return F.when(text.isNotNull(), F.size(F.array_remove(F.split(plain, " "), "")).cast("long"))


def heading_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)<h[12]\b")).cast("long")


def heading_level(text: Column, ratio: Column, bold: Column, tabular: Column | bool = False) -> Column:
    """1, 2 or null: whether a page's line is a heading, by its words, its height over the page's median, and its weight."""
    t = trimmed(text)
    tabular = F.lit(tabular) if isinstance(tabular, bool) else tabular
    length = F.length(t)
    # fixed values: names of books, words that begin chapters, and limits
    named = t.rlike(r"(?i)^(numbers|genesis|exodus|leviticus|deuteronomy|matthew|mark|luke|john)\b") & (length < 40) & ~t.rlike(r"^\d+\.")
    prose = (length < 3) | (length > 80) | (t.endswith(".") & (length > 30)) | tabular | (t.rlike(rf'^\d+[{WS}]+[{_QUOTE}A-Za-z]') & (length > 45)) | (named & (ratio < 1.5))
    numbered = t.rlike(rf"^\d{{1,2}}[.)][{WS}]+[^{WS}]") & (length <= 70)
    lettered = t.rlike(rf"^[A-Z][.)][{WS}]+[^{WS}]") & (length <= 70)
    capitals = (length <= 50) & (t == F.upper(t)) & t.rlike("[A-Z]") & (F.size(F.split(t, f"[{WS}]+")) <= 10)
    one = t.rlike(r"(?i)^(chapter|part|section|appendix)\b") | (capitals & (ratio >= 1.4))
    two = (numbered & ((ratio >= 1.15) | bold)) | (lettered & bold) | (capitals & (ratio >= 1.22)) | (bold & (ratio >= 1.25)) | (ratio >= 1.55)
    return F.when(F.coalesce(prose, F.lit(True)), F.lit(None).cast("int")).when(one, F.lit(1)).when(two, F.lit(2))


def starts_structured(text: Column) -> Column:
    """Whether a line begins with a bullet or an outline number."""
    return trimmed(text).rlike(rf"^(?:[•●▪◦‣∙·]|\(?[0-9A-Za-z]{{1,3}}[.)])[{WS}]+[^{WS}]")


def is_verse_boundary(before: Column, after: Column) -> Column:
    return before.rlike(r"^\d{1,3}\z") & after.rlike(rf'^[{_QUOTE}A-Za-z]')


#: Values of a page-break property that force a break.
FORCED_BREAKS = ("always", "page", "column", "all", "left", "right", "recto", "verso")


def forced_break(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c)).isin(*FORCED_BREAKS), F.lit(False))


def is_complex_script(char: Column) -> Column:
    """Whether a character is of a complex script; null for white space."""
    point = F.ascii(char)
    ranges = ((0x0590, 0x08FF), (0x0900, 0x0DFF), (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF))
    hit = F.lit(False)
    for a, z in ranges:
        hit = hit | point.between(a, z)
    return F.when(~char.rlike(f"^[{WS}]"), hit)


def script_segments(c: Column) -> Column:
    """Runs of one kind of script: array of struct(text, complex). White space goes with what stands before it, at the start with what follows."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")

    def step(acc: Column, ch: Column) -> Column:
        kind = is_complex_script(ch)
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (kind.isNull() | last["complex"].isNull() | (kind == last["complex"]))
        longer = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.concat(last["text"], ch).alias("text"), F.coalesce(last["complex"], kind).alias("complex"))))
        return F.when(joins, longer).otherwise(F.concat(acc, F.array(F.struct(ch.alias("text"), kind.alias("complex")))))

    found = F.aggregate(chars, F.array().cast("array<struct<text:string,complex:boolean>>"), step)
    return F.transform(found, lambda s: F.struct(s["text"].alias("text"), F.coalesce(s["complex"], F.lit(False)).alias("complex")))
