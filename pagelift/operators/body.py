"""The canonical body: ordered rewrite passes over a table of labelled nodes.

``PASSES`` is the order, as data. A ``Rewrite`` is a condition on a node and what becomes of its tag, classes and attributes, so that it is one projection; it may also drop what lies inside a node, or
the node with it, which is a running maximum over the labels. The other passes look at neighbours and are functions. Labels stay those of the page, spread apart so that new nodes fit between.

A body that went through once stays as it is: ``unstable`` lists what a second run would change.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..session import stored
from ..sources.html import with_text
from . import markup

Pass = Callable[[DataFrame, tuple[str, ...]], DataFrame]

# fixed values: bounds and names of a canonical body
SPACE_LINES, TOP, OFFSETS, SIZES = (2, 12), (0, 100), 8, ("75", "88", "100", "112", "125", "150", "175")
ALIGN, PLACE = ("center", "right", "justify", "left"), ("bottom", "middle", "top")
TRAITS = ("bold", "not-bold", "italic", "not-italic", "underline", "strike", "no-decoration")
#: What only an editor needs of an image.
TRANSIENT = ("tabindex", "draggable", "aria-selected", "data-tooltip", "title")
#: Classes of elements whose text decides what becomes of them.
TOLD = ("page-label", "page-break", "pagebreak")
#: Room between labels for nodes that a pass puts in.
ROOM = 8


def has(name: str) -> Column:
    return F.array_contains("classes", name)


def like(pattern: str) -> Column:
    return F.exists("classes", lambda c: c.rlike(pattern))


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def without(pattern: str, classes: Column | str = "classes") -> Column:
    return F.filter(classes, lambda c: ~c.rlike(pattern))


def whole(value: Column, least: int, most: int | None, default: int) -> Column:
    """A number as text, rounded and within bounds; the default where there is none."""
    n = F.coalesce(N.rounded(value.try_cast("double")), F.lit(default)).cast("long")
    n = F.greatest(F.lit(least), n)
    return (n if most is None else F.least(F.lit(most), n)).cast("string")


@dataclass(frozen=True)
class Rewrite:
    """Where ``on`` holds: a new tag, classes and attributes (a null value takes one away); ``keep`` names the only attributes that stay. ``empty`` drops what is inside, ``gone`` the node too."""

    name: str
    on: Callable[[], Column]
    tag: Callable[[], Column] | None = None
    classes: Callable[[], Column] | None = None
    attrs: dict[str, Callable[[], Column] | None] = field(default_factory=dict)
    keep: tuple[str, ...] | None = None
    empty: bool = False
    gone: bool = False

    def __call__(self, df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        hit = (F.col("tag") != "#text") & F.coalesce(self.on(), F.lit(False))
        new = {"tag": self.tag and self.tag(), "classes": self.classes and self.classes()}
        if self.attrs or self.keep is not None:
            stays = F.map_filter("attrs", lambda k, _: (k.isin(*self.keep) if self.keep is not None else F.lit(True)) & ~k.isin(*self.attrs))
            named = [x for k, v in self.attrs.items() if v for x in (F.lit(k), v())]
            new["attrs"] = F.map_filter(F.map_concat(stays, F.create_map(*named)), lambda _, v: v.isNotNull()) if named else stays
        df = df.withColumn("_hit", hit & F.col("gone_by").isNull())
        for name, value in new.items():
            if value is not None:
                df = df.withColumn(f"_{name}", F.when(F.col("_hit"), value).otherwise(F.col(name)))
        differs = [~F.col(f"_{n}").eqNullSafe(F.col(n)) if n != "attrs" else ~F.array_sort(F.map_entries("_attrs")).eqNullSafe(F.array_sort(F.map_entries("attrs"))) for n, v in new.items() if v is not None]
        changed = F.lit(self.gone)
        for d in differs:
            changed = changed | d
        df = df.withColumn("passes", F.when(F.col("_hit") & changed, F.array_append("passes", F.lit(self.name))).otherwise(F.col("passes")))
        df = df.withColumns({n: F.col(f"_{n}") for n, v in new.items() if v is not None})
        if self.empty or self.gone:
            inside = F.coalesce(F.max(F.when(F.col("_hit"), F.col("leave"))).over(W.partitionBy(*keys).orderBy("enter").rowsBetween(W.unboundedPreceding, -1)) > F.col("enter"), F.lit(False))
            drops = inside | F.col("_hit") if self.gone else inside
            df = df.withColumn("gone_by", F.coalesce("gone_by", F.when(drops, F.lit(self.name))))
        return df.drop("_hit", *(f"_{n}" for n in new))


def _standing(df: DataFrame) -> Column:
    return F.col("gone_by").isNull()


def forced_breaks(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Breaks that a style forces become classes and leave the style."""
    said = F.col("_style")
    df = df.withColumn("_style", markup.declarations(attr("style")))
    forced = lambda side: X.forced_break(F.try_element_at(said, F.lit(f"page-break-{side}"))) | X.forced_break(F.try_element_at(said, F.lit(f"break-{side}")))
    extra = F.array_compact(F.array(*(F.when(forced(side), F.lit(f"break-{side}")) for side in ("before", "after"))))
    df = df.withColumn("_more", F.when(_standing(df) & (F.col("tag") != "#text"), extra).otherwise(F.array().cast("array<string>")))
    return _restyled(df, "forced breaks", r"^(?:page-)?break-(?:before|after)$", F.size("_more") > 0, F.array_union("classes", "_more"))


def typography(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Weight, slant and lines that a style sets become classes, resets among them, and leave the style."""
    df = df.withColumn("_style", markup.declarations(attr("style"))).withColumn("_t", markup.css_traits(attr("style")))
    name = lambda trait, on, off: F.when(F.col(f"_t.{trait}"), F.lit(on)).when(~F.col(f"_t.{trait}"), F.lit(off))
    more = F.array_distinct(F.array_compact(F.array(name("bold", "bold", "not-bold"), name("italic", "italic", "not-italic"), name("underline", "underline", "no-decoration"), name("strike", "strike", "no-decoration"))))
    df = df.withColumn("_more", F.when(_standing(df) & (F.col("tag") != "#text"), more).otherwise(F.array().cast("array<string>")))
    return _restyled(df, "typography", r"^(?:font-weight|font-style|text-decoration|text-decoration-line)$", F.size("_more") > 0, F.array_union("classes", "_more")).drop("_t")


def _restyled(df: DataFrame, name: str, properties: str, hit: Column, classes: Column) -> DataFrame:
    """Where ``hit``: other classes, and a style without these properties."""
    left = F.array_join(F.transform(F.filter(F.map_entries("_style"), lambda e: ~e["key"].rlike(properties)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    rest = F.map_filter("attrs", lambda k, _: k != "style")
    attrs = F.when(left == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit("style"), left)))
    df = df.withColumn("_hit", hit)
    return df.withColumns({"classes": F.when(F.col("_hit"), classes).otherwise(F.col("classes")), "attrs": F.when(F.col("_hit"), attrs).otherwise(F.col("attrs")), "passes": F.when(F.col("_hit"), F.array_append("passes", F.lit(name))).otherwise(F.col("passes"))}).drop("_hit", "_more", "_style")


def _substance() -> Column:
    """Elements, and texts that are more than white space."""
    return (F.col("tag") != "#text") | (X.trimmed(F.coalesce("text", F.lit(""))) != "")


def blank_pages(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A break at the top of the tree before which nothing stands, or a break or blank page, is a blank page itself; so breaks in a row stay as many pages."""
    top = F.col("parent").isNull() & _standing(df) & _substance()
    marker = has("page-break") | has("blank-page")
    before = F.last(F.when(top, marker), True).over(W.partitionBy(*keys).orderBy("enter").rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_blank", top & has("page-break") & F.coalesce(before, F.lit(True)))
    as_blank = {"tag": F.lit("div"), "classes": F.array(F.lit("blank-page")), "attrs": F.create_map().cast("map<string,string>"), "passes": F.array_append("passes", F.lit("blank pages"))}
    return df.withColumns({c: F.when(F.col("_blank"), v).otherwise(F.col(c)) for c, v in as_blank.items()}).drop("_blank")


def empty_paragraphs(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A paragraph with neither text nor an image, break, tab, space or table inside, and none of these itself, goes if elements stand before and after it."""
    element = _standing(df) & (F.col("tag") != "#text")
    meant = has("page-break") | has("blank-page") | has("tab") | has("note-space")
    holds = _standing(df) & (F.col("tag").isin("img", "br", "table") | meant | has("verse-num") | ((F.col("tag") == "#text") & _substance()))
    back = lambda *by: W.partitionBy(*keys, *by).orderBy(F.desc("enter")).rowsBetween(W.unboundedPreceding, -1)  # noqa: E731  running from the end, as frames up to the end are computed anew for each row
    following = F.last(F.when(holds, F.col("enter")), True).over(back())
    df = df.withColumns({"_after": F.max(element).over(back("parent")), "_before": F.max(element).over(W.partitionBy(*keys, "parent").orderBy("enter").rowsBetween(W.unboundedPreceding, -1)), "_next": following})
    df = df.withColumn("_empty", element & (F.col("tag") == "p") & ~meant & F.col("_after") & F.col("_before") & F.coalesce(F.col("_next") > F.col("leave"), F.lit(True)))
    return Rewrite("empty paragraphs", lambda: F.col("_empty"), gone=True)(df, keys).drop("_empty", "_after", "_before", "_next")


def verse_numbers(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The number of a verse at the start of a block's own text becomes an element: a raised number, and the rest after it."""
    own = _standing(df) & (F.col("tag") == "#text") & _substance()
    first = F.row_number().over(W.partitionBy(*keys, "parent").orderBy(F.when(own, 0).otherwise(1), "enter")) == 1
    df = df.withColumn("_verse", F.when(own & first & F.col("up").isin("p", "li", "td", "th", "blockquote"), X.verse_marker(F.col("text"))))
    names, at = [c for c in df.columns if c not in ("_verse", *keys)], F.col("enter")

    def node(**new: Column) -> Column:
        return F.struct(*((new[c].cast(df.schema[c].dataType) if c in new else F.col(c)).alias(c) for c in names))

    none = {"classes": F.array(), "attrs": F.create_map(), "implied": F.lit(True), "passes": F.array(F.lit("verse numbers"))}
    mark = node(**none | {"tag": F.lit("sup"), "classes": F.array(F.lit("verse-num")), "text": F.lit(None), "enter": at + 1, "leave": at + 4})
    number = node(**none | {"text": F.col("_verse.number"), "parent": at + 1, "up": F.lit("sup"), "depth": F.col("depth") + 1, "enter": at + 2, "leave": at + 3})
    rest = node(text=F.concat(F.lit(" "), F.col("_verse.rest")), enter=at + 5, passes=F.array_append("passes", F.lit("verse numbers")))
    nodes = F.when(F.col("_verse").isNotNull(), F.array(mark, number, rest)).otherwise(F.array(node()))
    return df.select(*keys, F.explode(nodes).alias("_n")).select(*keys, "_n.*")  # keys stay columns of their own, so the rows stay where they are


def item_formats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Items carry the format of their list: what they say, else bullets or numbers by the list."""
    format = F.when(F.col("up") == "ul", F.lit("bullet")).when(F.col("up") == "ol", F.lit("decimal"))
    return Rewrite("lists", lambda: (F.col("tag") == "li") & format.isNotNull(), attrs={"data-list-format": lambda: F.coalesce(attr("data-list-format"), format)})(df, keys)


def _chosen(prefix: str, names: tuple[str, ...], data: str, default: str) -> Callable[[], Column]:
    """The classes with one of a family, after what the attribute says or else the class that is there."""
    value = F.coalesce(attr(data), *(F.when(has(f"{prefix}-{n}"), F.lit(n)) for n in names), F.lit(default))
    return lambda: F.array_append(without(f"^{prefix}-(?:{'|'.join(names)})$"), F.concat(F.lit(f"{prefix}-"), value))


def _value(prefix: str, names: tuple[str, ...], data: str, default: str) -> Callable[[], Column]:
    return lambda: F.coalesce(attr(data), *(F.when(has(f"{prefix}-{n}"), F.lit(n)) for n in names), F.lit(default))


def _any(prefix: str, names: tuple[str, ...], data: str) -> Callable[[], Column]:
    return lambda: attr(data).isNotNull() | like(f"^{prefix}-(?:{'|'.join(names)})$")


def passes() -> tuple[Pass, ...]:
    """The passes in their order."""
    name = lambda *c: lambda: F.array(*(x if isinstance(x, Column) else F.lit(x) for x in c))
    lines = lambda: whole(attr("data-space-lines"), *SPACE_LINES, SPACE_LINES[0])
    zone = lambda: F.coalesce(*(F.when(has(f"page-{z}"), F.lit(f"page-{z}")) for z in PLACE), F.lit("page-top"))
    offset = lambda: F.coalesce(F.get(F.filter("classes", lambda c: c.rlike(rf"^offset-[0-{OFFSETS}]$")), F.lit(0)), F.lit("offset-0"))
    kind = lambda: F.coalesce(*(F.when(has(k), F.lit(k)) for k in ("image-page", "empty-page")))
    common = rf"^(?:align-(?:{'|'.join(ALIGN)})|place-(?:{'|'.join(PLACE)})|break-before|break-after|{'|'.join(TRAITS)})$"
    table = rf"{common[:-1]}|^(?:user-table|source-block|size-(?:{'|'.join(SIZES)}))$"
    return (
        Rewrite("markers", lambda: has("chapter-marker"), gone=True),
        Rewrite("labels", lambda: has("page-label"), tag=lambda: F.lit("div"), classes=name("page-break"), keep=(), empty=True, attrs={"data-page": lambda: F.coalesce(attr("data-page"), F.when(attr("id").rlike("^page-"), F.regexp_replace(attr("id"), "^page-", "")), F.nullif(F.regexp_replace("inner", r"\D+", ""), F.lit("")))}),
        forced_breaks,
        Rewrite("breaks", lambda: (has("page-break") | has("pagebreak")) & (X.trimmed(F.coalesce("inner", F.lit(""))) != "") & (F.col("tag") != "br") & ~F.array_contains("passes", "labels"), classes=lambda: F.array_union(without("^(?:page-break|pagebreak)$"), F.array(F.lit("break-before"))), attrs={"data-page-break": None}),
        Rewrite("breaks", lambda: has("page-break") | has("pagebreak"), tag=lambda: F.when(F.col("parent").isNull(), F.lit("hr")).otherwise(F.col("tag")), classes=name("page-break"), keep=("data-page",), empty=True),
        blank_pages,
        Rewrite("pages", lambda: has("source-page"), classes=lambda: F.array_compact(F.array(F.lit("source-page"), zone(), offset(), kind())), attrs={"data-source-page": lambda: whole(attr("data-source-page"), 1, None, 1), "data-top": lambda: whole(attr("data-top"), *TOP, TOP[0])}),
        Rewrite("spaces", lambda: has("note-space"), classes=lambda: F.array(F.lit("note-space"), F.concat(F.lit("space-"), lines())), attrs={"data-space-lines": lines, "title": None}, empty=True),
        Rewrite("alignment", _any("align", ALIGN, "data-align"), classes=_chosen("align", ALIGN, "data-align", "left"), attrs={"data-align": _value("align", ALIGN, "data-align", "left")}),
        verse_numbers,
        empty_paragraphs,
        item_formats,
        Rewrite("placement", _any("place", PLACE, "data-place"), classes=_chosen("place", PLACE, "data-place", "top"), attrs={"data-place": _value("place", PLACE, "data-place", "top")}),
        Rewrite("size", _any("size", SIZES, "data-size"), classes=_chosen("size", SIZES, "data-size", "100"), attrs={"data-size": _value("size", SIZES, "data-size", "100")}),
        Rewrite("tabs", lambda: has("tab"), classes=name("tab"), empty=True),
        Rewrite("images", lambda: F.col("tag") == "img", classes=lambda: without("^(?:editable|selected|dragging)$"), attrs={"data-width": lambda: N.image_width(attr("data-width").try_cast("double")).cast("string"), **dict.fromkeys(TRANSIENT)}),
        Rewrite("tables", lambda: F.col("tag") == "table", classes=lambda: F.array_union(F.array(F.lit("body-table")), F.filter("classes", lambda c: c.rlike(table)))),
        Rewrite("cells", lambda: F.col("tag").isin("td", "th"), classes=lambda: F.filter("classes", lambda c: c.rlike(common))),
        typography,
    )


COLUMNS = ("enter", "leave", "depth", "parent", "up", "tag", "classes", "attrs", "text", "implied")


def traced(nodes: DataFrame, keys: tuple[str, ...], order: tuple[Pass, ...] | None = None) -> DataFrame:
    """nodes (as ``sources.html.nodes`` gives them, best with the text of elements of the classes TOLD, which is looked up else) after all passes, with ``passes``, those that changed a node, and ``gone_by``, the one that dropped it."""
    df = nodes if "inner" in nodes.columns else with_text(stored(nodes), keys)
    spread = {c: F.col(c) * ROOM for c in ("enter", "leave", "parent")}
    classes = F.array_distinct(F.filter(F.split(F.coalesce(attr("class"), F.lit("")), rf"[{X.WS}]+"), lambda c: c != ""))
    df = df.select(*keys, *(spread.get(c, F.col(c)).alias(c) for c in ("enter", "leave", "depth", "parent", "up", "tag")), classes.alias("classes"), F.map_filter("attrs", lambda k, _: k != "class").alias("attrs"), "text", "implied", "inner", F.array().cast("array<string>").alias("passes"), F.lit(None).cast("string").alias("gone_by"))
    df = df.repartition(*keys)
    for rewrite in passes() if order is None else order:
        df = rewrite(df, keys)
    return df.select(*keys, *COLUMNS, "passes", "gone_by")


def canonical(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, COLUMNS): what a body keeps, in its canonical form. Labels nest as before, with gaps.

    Null texts are empty, unknown classes and attributes stay but on tables and cells; a node without a class has an empty list. Empty tables give no rows. Repeated documents must have keys of their own.
    """
    return traced(nodes, keys).where("gone_by is null").drop("passes", "gone_by")


def reread(body: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A canonical body as nodes for ``traced``: classes as an attribute again; of elements of the classes TOLD the first text inside, which is enough to see whether there is one."""
    back = W.partitionBy(*keys).orderBy(F.desc("enter")).rowsBetween(W.unboundedPreceding, -1)
    text = F.last(F.when((F.col("tag") == "#text") & _substance(), F.struct("enter", "text")), True).over(back)
    df = body.withColumn("_text", text)
    inner = F.when(F.arrays_overlap("classes", F.array(*map(F.lit, TOLD))) & (F.col("_text.enter") < F.col("leave")), F.col("_text.text"))
    attrs = F.when(F.size("classes") > 0, F.map_concat("attrs", F.create_map(F.lit("class"), F.array_join("classes", " ")))).otherwise(F.col("attrs"))
    return df.select(*keys, "enter", "leave", "depth", "parent", "up", "tag", attrs.alias("attrs"), "text", "implied", inner.alias("inner"))


def unstable(body: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, enter, tag, passes, gone_by) of nodes that a second run would change or drop, or puts in. Of a canonical body there are none."""
    again = traced(reread(body, keys), keys)
    return again.where(F.col("gone_by").isNotNull() | (F.size("passes") > 0)).select(*keys, "enter", "tag", "passes", "gone_by")
