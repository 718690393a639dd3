"""Main text of HTML pages by the distribution of line blocks.

Markup is stripped into lines, one per block of the page, each with the length of the text that counts: none in menus, headers,
footers, sidebars, notices, adverts, forms and comments, half where a name only hints at one of these, less where much of it is links. A form, a notice, a header or a widget that
holds most of a page's text is a wrapper and no furniture, as where a whole page stands in a form. Lengths are summed over a sliding window of
lines; where the sums surge, the main text begins, and where they dive to nothing it ends; lines between that count are kept. Where a
page marks articles, lines in them and lines outside have a distribution each, and less makes a surge in the marked ones.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_batches, texts

#: Lines of a window, and the characters in it that make a surge.
WINDOW, SURGE = 3, 60
#: The share of SURGE that makes one in a marked article, and of a text that counts where a name only hints at furniture.
MARKED, HINTED = 1 / 3, 0.5

# fixed values: HTML elements by their part in a page
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_MATH = frozenset("math mi mn mo ms mspace mtext mrow msub msup msubsup munder mover munderover mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose mtable mtr mtd mmultiscripts mprescripts semantics".split())
_INLINE |= _MATH
#: Elements without text of the page; the first kind may stand within a line.
_WITHIN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas audio video select textarea button".split())
_INLINE |= _WITHIN
_NEVER = _WITHIN | frozenset("head datalist map".split())
_FURNITURE = frozenset("nav footer aside form header menu dialog fieldset".split())
_RAW = frozenset("script style textarea title".split())
#: Elements whose end tags may be left out, as kinds: what begins one ends those open of the kinds named, up to the elements that hold them.
_KIND = {"p": 0, "li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "thead": 5, "tbody": 5, "tfoot": 5, "a": 6}
_ENDS = {"p": (0,), "li": (1,), "dt": (2,), "dd": (2,), "td": (3,), "th": (3,), "tr": (3, 4), "thead": (3, 4, 5), "tbody": (3, 4, 5), "tfoot": (3, 4, 5), "a": (6,)}
_NONE = (-1,) * 7
#: Those that authors also wrap pages in: by tag, role and part of a name.
_SOFT = frozenset("form header dialog fieldset".split())
_SOFT_ROLES = frozenset("form dialog alert banner".split())
_SOFT_NAMES = frozenset("header masthead banner notice alert popup modal overlay dialog widget social signup login toolbar".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: Names of furniture; what may stand beside them in a name; names of a page's content.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription signup login comment comments reply "
    "replies disqus side sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer social share sharing related recommended recommendations widget pagination pager toolbar skip".split()
)
_BESIDE = frozenset(
    "site page main global top bottom left right center inner outer wrapper wrap container box bar block area section panel slot unit list item items link links content body text title image img icon icons buttons button primary "
    "secondary desktop mobile sticky fixed floating small large first last col column row grid region zone module component holder group form thread article articles post posts entry story stories news blog to by the js google".split()
)
_CONTENT = frozenset("article post entry story main content body text".split())
#: Names beside which a soft name only hints: text-widget, section-header.
_WRAPPED = _CONTENT | {"section"}
#: Names of furniture in which an article is no main text.
_ASIDE = frozenset("comment comments reply replies disqus related recommended recommendations".split())
_HEADED = re.compile(r"(?:article-|post-|entry-|story-)?header", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>|[^<]+|<", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*?)(/?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")  # a value is passed over whole, whatever it holds
_SPACES = re.compile(r"\s+")


@dataclass(slots=True)
class Open:
    """An open element; flags and places hold for all in it, so that an element is opened without a look at those around it."""

    name: str = ""
    dropped: bool = False
    weight: float = 1.0  # of a line's text: 0 in furniture, HINTED where a name hints at it
    article: bool = False
    aside: bool = False
    link: bool = False
    hint: float = 1.0  # the weight but for furniture
    marks: tuple[int, ...] = ()  # the furniture around, by number; a soft kind's numbers are negative
    at: tuple[int, ...] = _NONE  # by kind: the place in the stack of an element that another of the kind would end


def places(name: str, at: tuple[int, ...], own: int) -> tuple[int, ...]:
    """The places that hold in an element opened at ``own``: blocks hold paragraphs and links apart, all but div, address and p list items, tables cells and rows."""
    if name not in _INLINE:
        if name == "table":
            at = _NONE
        elif name in ("div", "address", "p"):
            at = (-1, *at[1:6], -1)
        else:
            at = (-1, -1, -1, *at[3:6], -1)
    kind = _KIND.get(name)
    return at if kind is None else (*at[:kind], own, *at[kind + 1 :])


@cache
def named_as(names: str) -> tuple[float, bool, bool]:
    """The weight that classes and ids give, whether they name comments or the like, and whether furniture is of a soft kind alone: 0 where a whole name is one of furniture, as ``site-header`` or ``adSlot3``; HINTED
    where only a part is, as in ``related-work``, or a name of content stands beside, also within the name if it is a soft one (``text-widget``)."""
    weight, content, aside, soft = 1.0, False, False, True
    for name in names.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        bad = [x for x in parts if x in _NAMES]
        if bad:
            mild = all(x in _SOFT_NAMES for x in bad)
            whole = all(x in _NAMES or x in _BESIDE for x in parts) and not (mild and any(x in _WRAPPED for x in parts))
            soft &= mild or not whole
            weight = min(weight, 0.0 if whole else HINTED)
            aside |= whole and any(x in _ASIDE for x in parts)
        content |= bool(parts) and not bad and all(x in _CONTENT for x in parts)
    return max(weight, HINTED) if content and weight < 1 and not aside else weight, aside, soft


@dataclass
class Line:
    text: str
    weight: float
    article: bool
    linked: int
    hint: float = 1.0
    marks: tuple[int, ...] = ()


def stripped(page: str) -> list[Line]:
    """The page's blocks in order, without markup; references decoded, white space of a block made one space."""
    out: list[Line] = []
    stack = [Open()]
    count: dict[str, int] = {}  # open elements by name
    parts: list[str] = []
    linked = marked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACES.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Line(text, stack[-1].weight, stack[-1].article, min(linked, len(text)), stack[-1].hint, stack[-1].marks))
        parts.clear()
        linked = 0

    def leave(k: int) -> None:
        for x in stack[k:]:
            count[x.name] -= 1
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m[0] == "<" and _LOOSE.match(page, at):  # a tag with an odd quote ends at the next >; one that never ends is no text
            m = _LOOSE.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            said = m[0]
            if said[0] != "<" or said == "<":
                if not stack[-1].dropped:
                    said = entities.unescape(said)
                    parts.append(said)
                    linked += len(said.strip()) * stack[-1].link
            elif said.startswith("<![CDATA[") and not stack[-1].dropped:
                parts.append(said[9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if name not in _INLINE and not stack[-1].dropped:
                flush()
            if count.get(name):
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            continue
        if name not in _INLINE and not stack[-1].dropped:
            flush()
        if name in _VOID or m[4]:
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        open_ones = [k for kind in _ENDS.get(name, ()) if (k := stack[-1].at[kind]) > 0]
        if open_ones:
            leave(min(open_ones))
        top = stack[-1]
        dropped, weight, article = top.dropped, top.weight, top.article
        said = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        dropped |= name in _NEVER or "hidden" in said or said.get("aria-hidden", "").lower() == "true"
        own, commented, soft = named_as(f"{said.get('class', '')} {said.get('id', '')}") if name not in ("body", "html") and ("class" in said or "id" in said) else (1.0, False, True)
        if article and name in ("header", "hgroup") or own == 0 and article and _HEADED.fullmatch(said.get("class") or said.get("id") or ""):
            own = 1.0  # an article's own header
        elif name in _FURNITURE or said.get("role", "").lower() in _ROLES:
            soft &= (name not in _FURNITURE or name in _SOFT) and (said.get("role", "").lower() not in _ROLES or said["role"].lower() in _SOFT_ROLES)
            own = 0.0
        marks, hint = top.marks, min(top.hint, own or 1.0)
        if own == 0:
            marked += 1
            marks = (*marks, -marked if soft and not commented else marked)
        if name in ("article", "main") or said.get("role", "").lower() in ("main", "article"):
            # a comment may be an article of its own; other furniture may be a wrapper, or never closed
            weight, article = min(own, top.weight if top.aside else 1.0), not top.aside and own > 0
            if not top.aside:
                marks = marks[len(top.marks) :]
        else:
            weight = min(weight, own)
        aside = top.aside or name in ("aside", "footer") or commented
        link = top.link or name == "a" and "href" in said
        count[name] = count.get(name, 0) + 1
        stack.append(Open(name, dropped, weight, article, aside, link, hint, marks, places(name, top.at, len(stack))))
    flush()
    return out if any(x.article and x.weight for x in out) else unwrapped(out)


def unwrapped(lines: list[Line]) -> list[Line]:
    """lines of a page without a marked article: soft furniture that holds more than half of the text that is no link gives its lines the weight that they have without it."""
    said: dict[int, int] = {}
    for x in lines:
        for m in {0, *x.marks}:
            said[m] = said.get(m, 0) + len(x.text) - x.linked
    wrappers = {m for m, n in said.items() if m < 0 and 2 * n > said[0]}
    return [replace(x, weight=x.hint) if x.marks and wrappers.issuperset(x.marks) else x for x in lines] if wrappers else lines


def main_lines(lines: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[str]:
    runs: list[list[Line]] = []  # lines that follow one another in marked articles, or outside
    between: list[Line] = []
    for x in lines:
        if not x.weight:
            between.append(x)
            continue
        if runs and runs[-1][0].article == x.article:
            runs[-1] += [*([] if x.article else between), x]  # furniture in an article is a part left out, no end of its text
        else:
            runs.append([x])
        between = []
    kept, short = [], {True: [], False: []}
    for run in runs:
        marked = run[0].article
        length = lengths(run)
        kept += surged(run, length, window, surge * MARKED if marked else surge)
        short[marked] += [x.text for x, n in zip(run, length, strict=True) if n]
    return kept or short[True] or short[False] or [x.text for x in lines if all(m < 0 for m in x.marks) and 2 * x.linked <= len(x.text)]


def lengths(run: list[Line]) -> list[float]:
    """The text of each line that counts: where most of a line is links, only the rest; in a marked article a lone such line (a headline, a source) counts whole."""
    listed = [2 * x.linked > len(x.text) for x in run]
    out = []
    for i, x in enumerate(run):
        alone = x.article and not any(listed[j] for j in (i - 1, i + 1) if 0 <= j < len(run))
        out.append((len(x.text) - x.linked * (listed[i] and not alone)) * x.weight)
    return out


def surged(run: list[Line], length: list[float], window: int, surge: float) -> list[str]:
    """The lines from a surge point to a dive point; in a marked article those before the surge too, back to the last dive."""
    block = [sum(length[i : i + window]) for i in range(len(run))]
    kept, before, inside = [], [], False
    for i, x in enumerate(run):
        if not inside and block[i] >= surge and length[i]:
            inside = True  # a surge point
            kept += before
        elif inside and not block[i]:
            inside = False  # a dive point
        if inside and length[i]:
            kept.append(x.text)
        if inside or not block[i]:
            before = []
        elif x.article and length[i]:
            before.append(x.text)
    return kept


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points), in one pass without a shuffle.

    Nulls: a null page has an empty text; a null id or url is carried. Very long pages are read whole, elements nested to any depth. Equal pages, and so repeated rows,
    have equal results. Empty table: no rows. Other columns are not
    carried, so clashing names cannot disturb. A page in which nothing surges gives all lines that count, those of marked articles if there are any; if no line counts, those in forms, notices, headers and widgets that are not mostly links.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {c: b.column(c) for c in ("page_id", "url")} | {"text": ["\n".join(main_lines(stripped(h))) for h in texts(b.column("html"))]}

    out = map_batches(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")), make, "text string", ("page_id", "url"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
