"""HTML as a table of labelled nodes.

A stack of open elements reads a page once. Every node gets two numbers from one counter, when it opens and when it closes, so that a node lies inside another exactly when its numbers lie between the other's:
ancestors and subtrees are ranges, not walks. Each node also has the span of its text in the text of the whole page.

End tags that authors leave out are put in (paragraphs before blocks, items, cells, rows, options), bold and the like that is open when its paragraph ends goes on in the next, end tags without a
start are passed over, tables get rows and bodies. What repair would have to move is left where it stands: text straight inside a table, and blocks inside an inline element that ends within them (it ends with its last block).
"""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reachable

# fixed values: elements by what the standard says of their tags
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUTER = frozenset("html head body".split())
CELLS, SECTIONS = frozenset(("td", "th", "caption")), frozenset(("tbody", "thead", "tfoot"))
#: Up to where an open element of a kind is looked for.
LIMITS = {"p": frozenset("button caption table td th".split()), "li": frozenset("ul ol menu table td th".split()), "dd": frozenset("dl table td th".split()), "tr": frozenset(("table",)), "td": frozenset(("tr", "table")), "tbody": frozenset(("table",)), "option": frozenset(("select", "datalist"))}
_CELL_LIMIT = frozenset(("table", "td", "th", "caption"))
_SAME = {"dt": "dd", "th": "td", "thead": "tbody", "tfoot": "tbody"}

#: Nodes that go out at once; the nodes of one page are never parted.
ROWS = 8192

ENTER, LEAVE, DEPTH, PARENT, UP, TAG, ATTRS, TEXT, START, END, IMPLIED = range(11)
NODE = "enter int, leave int, depth int, parent int, up string, tag string, attrs map<string,string>, text string, text_start int, text_end int, implied boolean"


class _Stack(html.parser.HTMLParser):
    """Rows of NODE for what is fed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.later: list[tuple[str, dict]] = []  # formatting that goes on when the next text comes
        self.outside: list[list] = []  # the same, around the cells that are open
        self.count = self.chars = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # no one asks for lines and columns

    def _begin(self, tag: str, attrs: dict, implied: bool = False) -> list:
        up = self.open[-1] if self.open else None
        row = [self.count, None, len(self.open), up and up[ENTER], up and up[TAG], tag, attrs, None, self.chars, None, implied]
        self.count += 1
        self.rows.append(row)
        return row

    def _end(self, row: list) -> None:
        row[LEAVE], row[END] = self.count, self.chars
        self.count += 1

    def _push(self, tag: str, attrs: dict, implied: bool = False) -> None:
        self.open.append(self._begin(tag, attrs, implied))
        if tag in CELLS:
            self.outside.append(self.later)
            self.later = []

    def _close_from(self, at: int) -> None:
        """Ends the open elements from place ``at`` on; formatting inside the first of them goes on later."""
        kept: list[tuple[str, dict]] = []
        for row in reversed(self.open[at:]):
            self._end(row)
            if row[TAG] in CELLS:  # what a cell leaves open ends with it
                kept, self.later = [], self.outside.pop()
            elif row[TAG] in FORMATTING and row is not self.open[at]:
                kept.append((row[TAG], row[ATTRS]))
        del self.open[at:]
        self.later = kept[::-1] + self.later

    def _find(self, tags: frozenset, limit: frozenset) -> int | None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][TAG] in tags:
                return at
            if self.open[at][TAG] in limit:
                return None
        return None

    def _close(self, tags: frozenset, limit: frozenset) -> bool:
        at = self._find(tags, limit)
        if at is not None:
            self._close_from(at)
        return at is not None

    def _resume(self) -> None:
        going, self.later = self.later, []
        for tag, attrs in going:
            self._push(tag, attrs, True)

    def _make_room(self, tag: str) -> None:
        """Ends, and begins, what must be before an element ``tag``."""
        if tag in ENDS_P:
            self._close(frozenset("p"), LIMITS["p"])
        kind = _SAME.get(tag, tag)
        if tag in HEADINGS and self.open and self.open[-1][TAG] in HEADINGS:
            self._close_from(len(self.open) - 1)
        if kind in ("li", "dd", "option"):
            self._close(frozenset(("dd", "dt")) if kind == "dd" else frozenset((kind,)), LIMITS[kind])
        if kind in ("td", "tr", "tbody") or tag == "caption":
            self._close(frozenset(("td", "th", "caption")), LIMITS["td"])
            if kind != "td":
                self._close(frozenset(("tr",)), LIMITS["tr"])
            if kind == "tbody" or tag == "caption":
                self._close(SECTIONS, LIMITS["tbody"])
            top = self.open[-1][TAG] if self.open else ""
            if kind in ("td", "tr") and top == "table":
                self._push("tbody", {}, True)
                top = "tbody"
            if kind == "td" and top in SECTIONS:
                self._push("tr", {}, True)
        if tag == "a":
            self._close(frozenset("a"), _CELL_LIMIT)
            self.later = [x for x in self.later if x[0] != "a"]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in OUTER:
            return
        self._make_room(tag)
        if tag not in ENDS_P and tag not in CELLS | SECTIONS | {"tr", "caption"}:
            self._resume()
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag in VOID:
            self._end(self._begin(tag, named))
        else:
            self._push(tag, named)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only, and these end by themselves

    def handle_endtag(self, tag: str) -> None:
        if tag in OUTER or tag in VOID:
            if tag == "br":
                self.handle_starttag("br", [])
        elif tag in FORMATTING:
            waiting = [i for i, x in enumerate(self.later) if x[0] == tag]
            at = self._find(frozenset((tag,)), _CELL_LIMIT)
            if waiting:
                del self.later[waiting[-1]]
            elif at is not None and not any(r[TAG] in ENDS_P for r in self.open[at:]):
                self._close_from(at)
        elif tag == "p":
            if not self._close(frozenset("p"), LIMITS["p"]):
                self._push("p", {}, True)
                self._close(frozenset("p"), LIMITS["p"])
        else:
            limit = frozenset(("table",)) if tag in CELLS | SECTIONS | {"tr"} else frozenset() if tag == "table" else LIMITS.get(tag, _CELL_LIMIT) if tag in ("li", "dd", "dt") else _CELL_LIMIT
            self._close(HEADINGS if tag in HEADINGS else frozenset((tag,)), limit)

    def handle_data(self, data: str) -> None:
        if not data:
            return
        top = self.open[-1][TAG] if self.open else ""
        if data.strip() and top not in ("script", "style", "title", "textarea"):
            self._resume()
        last = self.rows[-1] if self.rows else None
        if last and last[TAG] == "#text" and last[LEAVE] == self.count - 1:  # the parser hands out one text in several pieces
            last[TEXT].append(data)
            self.chars += len(data)
            last[END] = self.chars
            return
        row = self._begin("#text", {})
        row[TEXT] = [data]
        self.chars += len(data)
        self._end(row)

    def done(self) -> list[list]:
        self.close()
        while self.open:
            self._end(self.open.pop())
        for row in self.rows:
            if row[TEXT] is not None:
                row[TEXT] = "".join(row[TEXT])
        return self.rows


def page_nodes(page: str | None) -> list[list]:
    """Rows of NODE of one page; a null page has none."""
    reader = _Stack()
    reader.feed(page or "")
    return reader.done()


def nodes(pages: DataFrame, keys: tuple[str, ...], column: str = "html", inner_of: tuple[str, ...] = ()) -> DataFrame:
    """(keys, NODE): every element, and every text as a node ``#text``, of pages read as fragments of a body; comments and declarations have no node.

    ``enter`` and ``leave`` nest; ``parent`` is the parent's ``enter`` and ``up`` its tag, ``text_start`` to ``text_end`` a node's part of the page's text; ``implied`` are elements that the page's markup lacks. One page is in memory at a time.
    ``inner_of``: classes whose elements get all their text in a further column ``inner`` (null for all other nodes). Null and empty pages have no nodes; repeated rows give their nodes each; other columns are not carried.
    """
    schema = T.StructType([pages.schema[k] for k in keys] + T.StructType.fromDDL(NODE + ", inner string" * bool(inner_of)).fields)
    told = frozenset(inner_of)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.bool_(), *[pa.string()] * bool(told)]

    def made(b: pa.RecordBatch, places: list[int], rows: list[list]) -> pa.RecordBatch:
        own = pa.array(places, pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)] if rows else [pa.array([], k) for k in kinds]
        return pa.RecordBatch.from_arrays([*(b.column(f"k{n}").take(own) for n in range(len(keys))), *columns], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places: list[int] = []
            held: list[list] = []
            for i, page in enumerate(b.column("page").to_pylist()):
                rows = page_nodes(page)
                text = "".join(r[TEXT] for r in rows if r[TEXT] is not None) if told else ""
                for row in rows:
                    if told:
                        row.append(text[row[START] : row[END]] if told.intersection(row[ATTRS].get("class", "").split()) else None)
                    row[ATTRS] = list(row[ATTRS].items())
                places += [i] * len(rows)
                held += rows
                if len(held) >= ROWS:
                    yield made(b, places, held)
                    places, held = [], []
            yield made(b, places, held)

    reachable(pages.sparkSession)
    return pages.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), F.col(column).alias("page")).mapInArrow(run, schema)


def with_text(tree: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """tree with ``inner``, all text inside a node: its span of the page's text, which is put together once for each page."""
    own = tree.where("tag = '#text'").groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("enter", "text"))), lambda t: t["text"]), "").alias("_page"))
    return tree.join(own, list(keys), "left").withColumn("inner", F.coalesce(F.substring("_page", F.col("text_start") + 1, F.col("text_end") - F.col("text_start")), F.lit(""))).drop("_page")


def misplaced(tree: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Nodes whose labels break the nesting: not inside their parent, not one deeper, or reaching into what follows beside them. A right tree has none."""
    up = tree.select(*keys, F.col("enter").alias("parent"), F.col("enter").alias("_enter"), F.col("leave").alias("_leave"), F.col("depth").alias("_depth"))
    beside = F.lead("enter").over(W.partitionBy(*keys, "parent").orderBy("enter"))
    placed = tree.withColumn("_next", beside).join(up, [*keys, "parent"], "left")
    inside = F.when(F.col("parent").isNull(), F.col("depth") == 0).otherwise((F.col("enter") > F.col("_enter")) & (F.col("leave") < F.col("_leave")) & (F.col("depth") == F.col("_depth") + 1))
    right = F.coalesce(inside, F.lit(False)) & (F.col("enter") < F.col("leave")) & F.coalesce(F.col("_next") > F.col("leave"), F.lit(True))
    return placed.where(~right).select(*tree.columns)
