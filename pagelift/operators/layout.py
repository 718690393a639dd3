"""Positioned page text to lines, columns, spaces and blocks.

Every operator groups by page keys, so that a document's pages spread over tasks; the order within a page is always a column. Operators whose decision
depends on state that they build up are folds over a page's sorted array (bounded by a page); all others are windows and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

PAGE = ("doc_id", "page")


def text_items(items: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Items with text: x, y, width, height, char_width, text, n_chars (without white space around) and space_before (the source item before is blank and has a width)."""
    blank = X.trimmed(F.coalesce("str", F.lit(""))) == ""
    t, width = F.col("transform"), F.coalesce("width", F.lit(0.0))
    text = X.token_spacing(F.col("str"))
    height = N.or_default(F.col("height"), N.or_default(F.abs(F.get(t, F.lit(3))), N.or_default(F.abs(F.get(t, F.lit(0))), 10)))
    # all that needs one item alone comes before the window, so that what no one asks for is not moved
    out = items.select(
        *keys, "item_seq", "font_name", text.alias("text"), F.get(t, F.lit(4)).alias("x"), F.get(t, F.lit(5)).alias("y"), width.alias("width"), height.alias("height"), F.greatest(width / F.greatest(F.length(text), F.lit(1)), F.lit(2.0)).alias("char_width"),
        F.length(X.trimmed(F.coalesce(text, F.lit("")))).alias("n_chars"), (blank & (width > 0)).alias("spaces"), (~blank & (F.size(t) >= 6)).alias("said"),
    )
    before = F.coalesce(F.lag("spaces").over(W.partitionBy(*keys).orderBy("item_seq")), F.lit(False))
    return out.withColumn("space_before", before).where("said").drop("spaces", "said")


def cluster_lines(items: DataFrame, keys: tuple[str, ...] = PAGE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(keys, item_seq, line_no, line_y, item_no, carried): an item joins the open line if it is no further from the line's first item than 2.5, or 0.45 of the larger of the two
    heights. Items come in the order of ``ordered_items`` with a tolerance of 2; ``item_no`` counts those of a line by x."""
    its = F.transform("its", lambda i: F.struct(i["seq"].alias("item_seq"), i["across"].alias("x"), i["item"]["y"].cast("double").alias("y"), i["item"]["height"].cast("double").alias("height")))

    def step(acc: Column, it: Column) -> Column:
        joins = (acc["no"] >= 0) & (F.abs(acc["y"] - it["y"]) <= F.greatest(F.lit(2.5), F.greatest(it["height"], acc["top"]) * 0.45))
        no = F.when(joins, acc["no"]).otherwise(acc["no"] + 1)
        return F.struct(
            no.alias("no"), F.when(joins, acc["y"]).otherwise(it["y"]).alias("y"), F.when(joins, F.greatest(acc["top"], it["height"])).otherwise(it["height"]).alias("top"),
            F.concat(acc["out"], F.array(F.struct(it["item_seq"].alias("item_seq"), it["x"].alias("x"), no.alias("line_no"), F.when(joins, acc["y"]).otherwise(it["y"]).alias("line_y")))).alias("out"),
        )

    zero = F.struct(F.lit(-1).alias("no"), F.lit(0.0).alias("y"), F.lit(0.0).alias("top"), F.array().cast("array<struct<item_seq:bigint,x:double,line_no:int,line_y:double>>").alias("out"))
    pages = _in_order(items.select(*keys, "item_seq", *dict.fromkeys(("x", "y", "height", *carried))), 2.0, keys)
    both = F.zip_with(F.aggregate(its, zero, step, lambda a: a["out"]), "its", lambda o, i: F.struct(o.alias("o"), i["item"].alias("i")))
    placed = pages.select(*keys, F.explode(both).alias("b")).select(*keys, "b.o.item_seq", "b.o.line_no", "b.o.line_y", F.col("b.o.x").alias("_x"), *[f"b.i.{c}" for c in carried])
    along = W.partitionBy(*keys, "line_no").orderBy("_x", "item_seq")
    return placed.withColumn("item_no", (F.row_number().over(along) - 1).cast("int")).drop("_x")


def baselines(ys: Column) -> Column:
    """Of an array of y the baselines, first come: a y within 3 of one that is there adds none."""
    return F.aggregate(ys, F.array().cast("array<double>"), lambda acc, y: F.when(F.exists(acc, lambda v: F.abs(v - y) <= 3), acc).otherwise(F.concat(acc, F.array(y))))


def whitespace(lines: DataFrame, page_height: Column | float = 0.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, line_no, gap, space_lines) of the lines that a writing space follows."""
    return spaced(lines, page_height, keys).where("space_lines is not null").select(*keys, "line_no", "gap", "space_lines")


def spaced(lines: DataFrame, page_height: Column | float = 0.0, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """lines with gap (to the next one) and space_lines, null where no writing space follows."""
    height = page_height if isinstance(page_height, Column) else F.lit(float(page_height))
    order = W.partitionBy(*keys).orderBy("line_no")
    per_page = W.partitionBy(*keys)
    h = N.or_default(F.col("max_height"), N.or_default(F.col("line_height"), 10))
    df = lines.withColumn("gap", F.col("y") - F.lead("y").over(order)).withColumn("page_h", height)
    df = df.withColumn("mh", N.or_default(F.median(h).over(per_page), 10)).withColumn("wide", F.coalesce(F.col("gap") > F.col("mh") * 0.55, F.lit(False)))
    ordinary = F.col("gap") <= F.greatest(F.col("mh") * 2.6, F.col("page_h") * 0.045)
    df = df.withColumn("typical", N.or_default(F.median(F.when(F.col("wide") & ordinary, F.col("gap"))).over(per_page), N.or_default(F.median(F.when(F.col("wide"), F.col("gap"))).over(per_page), F.col("mh") * 1.5)))
    big = F.col("gap") >= F.greatest(F.col("typical") * 1.65, F.col("mh") * 2.75, F.col("page_h") * 0.045)
    surplus = F.col("gap") - F.col("typical")
    size = N.clamped(N.rounded(surplus / F.col("mh")), 2, 12).cast("int")
    follows = F.col("wide") & big & (surplus >= F.greatest(F.col("mh") * 1.05, F.col("page_h") * 0.018))
    return df.withColumn("space_lines", F.when(follows, size)).drop("page_h", "mh", "wide", "typical")


def column_centres(xs: DataFrame, tolerance: Column | float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, centre_no, centre): ascending x join a column while they are within the tolerance of its running mean."""
    tol = tolerance if isinstance(tolerance, Column) else F.lit(float(tolerance))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = (F.size(acc) > 0) & (F.abs(x - last["total"] / last["n"]) <= F.element_at(F.array(tol), 1))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((last["total"] + x).alias("total"), (last["n"] + 1).alias("n"))))
        return F.when(joins, grown).otherwise(F.concat(acc, F.array(F.struct(x.alias("total"), F.lit(1).alias("n")))))

    pages = xs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("x").cast("double"))).alias("xs"))
    found = F.transform(F.aggregate("xs", F.array().cast("array<struct<total:double,n:int>>"), step), lambda c: c["total"] / c["n"])
    return pages.select(*keys, F.posexplode(found).alias("centre_no", "centre"))


def assign_columns(cells: DataFrame, centres: DataFrame, tolerance: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, line_no, centre_no, text): each cell goes to the nearest centre of its page, the first of equals, if it is within 2.5 tolerances;
    cells of one place are joined by a space in order of x."""
    held = centres.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("centre_no", "centre"))).alias("centres"))
    near = F.aggregate(
        "centres", F.struct(F.lit(-1).alias("no"), F.lit(1e300).alias("d")),
        lambda a, c: F.when(F.abs(c["centre"] - F.col("x")) < a["d"], F.struct(c["centre_no"].alias("no"), F.abs(c["centre"] - F.col("x")).alias("d"))).otherwise(a),
    )
    placed = cells.join(held, list(keys)).withColumn("near", near).where(F.col("near.d") <= 2.5 * tolerance)
    ordered = F.array_sort(F.collect_list(F.struct("x", "text")))
    return placed.groupBy(*keys, "line_no", F.col("near.no").alias("centre_no")).agg(ordered.alias("o")).select(*keys, "line_no", "centre_no", F.array_join(F.transform("o", lambda o: o["text"]), " ").alias("text"))


def line_columns(cells: DataFrame, keys: tuple[str, ...] = (*PAGE, "line_no")) -> DataFrame:
    """(keys, column_no, x, end, text): cells of a line merge until a gap over 4 character widths, or 20."""
    order = W.partitionBy(*keys).orderBy("x", "cell_no")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("x") - reach > F.greatest(F.col("char_width") * 4, F.lit(20.0)), F.lit(False)), 1).otherwise(0)
    numbered = cells.withColumn("fresh", fresh).withColumn("column_no", F.sum("fresh").over(order).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("x", "cell_no", "text")))
    return numbered.groupBy(*keys, "column_no").agg(F.min("x").alias("x"), F.max("end").alias("end"), F.array_join(F.transform(ordered, lambda o: o["text"]), " ").alias("text"))


def tabular_lines(cells: DataFrame, keys: tuple[str, ...] = (*PAGE, "line_no")) -> DataFrame:
    """(keys, tabular): at least three cells with two gaps over 3.5 character widths, or 18."""
    order = W.partitionBy(*keys).orderBy("x", "cell_no")
    wide = F.col("x") - F.lag("end").over(order) > F.greatest(F.col("char_width") * 3.5, F.lit(18.0))
    marked = cells.withColumn("wide", F.coalesce(wide, F.lit(False)))
    return marked.groupBy(*keys).agg(((F.count("*") >= 3) & (F.count_if("wide") >= 2)).alias("tabular"))


def stable_columns(rows: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, line_no) of runs of at least three lines of two columns, no further apart than 2.4 line heights (or 24), whose second columns
    all start within 3 character widths (or 20) of their median."""
    order = W.partitionBy(*keys).orderBy("line_no")
    gap = F.lag("y").over(order) - F.col("y")
    broken = ~F.coalesce(F.col("two") & F.lag("two").over(order) & (gap <= F.greatest(F.col("line_height") * 2.4, F.lit(24.0))), F.lit(False))
    runs = rows.withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(order)).where("two")
    run = W.partitionBy(*keys, "run")
    off = F.abs(F.col("second_x") - F.median("second_x").over(run)) <= F.greatest(F.median("char_width").over(run) * 3, F.lit(20.0))
    runs = runs.withColumn("near", off).withColumn("n", F.count("*").over(run)).withColumn("all_near", F.min("near").over(run))
    return runs.where("n >= 3 and all_near").select(*keys, "line_no")


def reading_columns(items: DataFrame, page_width: float, page_height: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, split, score) of pages that are read in two columns.

    Starts chain while they are no more than 8 apart; between chains lie the candidate splits. A split needs a wide gap in the page's middle, seven
    baselines on either side that span enough of the page in balance, and little text of the left that crosses it.
    """
    order = W.partitionBy(*keys).orderBy("x", "item_seq")
    chained = items.withColumn("fresh", F.when(F.coalesce(F.col("x") - F.lag("x").over(order) > 8, F.lit(False)), 1).otherwise(0)).withColumn("chain", F.sum("fresh").over(order))
    chains = chained.groupBy(*keys, "chain").agg(F.median("x").alias("centre"))
    along = W.partitionBy(*keys).orderBy("centre")
    pairs = chains.withColumn("high", F.lead("centre").over(along)).withColumn("no", F.row_number().over(along)).where(F.col("high") - F.col("centre") >= max(0.055 * page_width, 28.0))
    pairs = pairs.select(*keys, "no", F.col("centre").alias("low"), "high", ((F.col("centre") + F.col("high")) / 2).alias("split")).where(F.col("split").between(0.18 * page_width, 0.72 * page_width))
    weight = F.col("n_chars") if "n_chars" in items.columns else F.length(X.trimmed(F.coalesce("text", F.lit(""))))
    counted = items.select(*keys, "item_seq", "x", "y", "width", weight.alias("weight")).where("weight > 0").withColumn("n_items", F.count("*").over(W.partitionBy(*keys))).where("n_items >= 14")
    both = counted.join(pairs, list(keys))
    left = F.col("x") < F.col("split")
    weight = F.col("weight")
    crosses = left & (F.col("x") + F.col("width") > F.col("high") - max(4.0, 0.008 * page_width))
    side = both.groupBy(*keys, "no", "low", "high", "split").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(side_of, F.struct("item_seq", F.col("y").cast("double").alias("y"))))), lambda i: i["y"]).alias(name) for name, side_of in (("left_y", left), ("right_y", ~left))],
        F.count_if(crosses).alias("crossing"), F.coalesce(F.sum(F.when(crosses, weight)), F.lit(0)).alias("crossing_text"), F.coalesce(F.sum(F.when(left, weight)), F.lit(0)).alias("left_text"),
    )
    for name in ("left", "right"):
        side = side.withColumn(f"{name}_y", baselines(F.col(f"{name}_y"))).withColumn(f"{name}_lines", F.size(f"{name}_y")).withColumn(f"{name}_span", F.array_max(f"{name}_y") - F.array_min(f"{name}_y"))
    few, span = F.least("left_lines", "right_lines"), F.least("left_span", "right_span") / page_height
    good = (few >= 7) & (span >= 0.38) & (few / F.greatest("left_lines", "right_lines") >= 0.22) & ~((F.col("crossing") >= 3) & (F.col("crossing_text") > 0.2 * F.col("left_text")))
    scored = side.where(good).withColumn("score", F.col("high") - F.col("low") + 4 * few + 40 * span)
    return scored.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("no")).alias("first"), "split")).alias("best")).select(*keys, "best.split", "best.score")


def page_extents(lines: DataFrame, page_height: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, left, right, bottom, top_ratio, remaining_ratio, start_zone, offset_level) of each page with lines."""
    top = N.clamped((page_height - F.max(F.col("y") + F.col("max_height"))) / page_height, 0.0, 0.8)
    rest = N.clamped(F.min("y") / page_height, 0.2, 0.92)
    out = lines.groupBy(*keys).agg(F.min("x_start").alias("left"), F.max("x_end").alias("right"), F.min("y").alias("bottom"), top.alias("top_ratio"), rest.alias("remaining_ratio"))
    return out.withColumn("start_zone", N.vertical_zone(F.col("top_ratio"))).withColumn("offset_level", N.offset_level(F.col("top_ratio")))


def block_position(lines: DataFrame, page_width: float, page_height: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, alignment, vertical_position) of each block from its lines' x_start, x_end and top."""
    centre = (F.col("x_start") + F.col("x_end")) / 2
    a = lines.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("x_start").alias("left"), F.max("x_end").alias("right"), (F.max(centre) - F.min(centre)).alias("centre_spread"),
        (F.max("x_start") - F.min("x_start")).alias("start_spread"), (F.max("x_end") - F.min("x_end")).alias("end_spread"), F.max("top").alias("top"),
    )
    return a.select(*keys, *_position(page_width, page_height, *(F.col(c) for c in ("n", "left", "right", "centre_spread", "start_spread", "end_spread", "top"))))


def array_position(lines: str, page_width: float, page_height: float) -> tuple[Column, Column]:
    """alignment and vertical_position as of ``block_position``, of an array of a block's lines."""
    start, end, top = (F.col(lines)[c] for c in ("x_start", "x_end", "top"))
    centre = F.transform(lines, lambda x: (x["x_start"] + x["x_end"]) / 2)
    spread = lambda a: F.array_max(a) - F.array_min(a)
    return _position(page_width, page_height, F.size(lines), F.array_min(start), F.array_max(end), spread(centre), spread(start), spread(end), F.array_max(top))


def _position(page_width: float, page_height: float, n: Column, first: Column, last: Column, centre_spread: Column, start_spread: Column, end_spread: Column, top: Column) -> tuple[Column, Column]:
    w = max(page_width, 1.0)
    left, right = F.greatest(F.lit(0.0), first / w), F.greatest(F.lit(0.0), (w - last) / w)
    occupied = N.clamped((last - first) / w, 0, 1)
    centred = (occupied < 0.86) & (F.abs(left - right) <= 0.075) & ((n == 1) | (centre_spread <= w * 0.045))
    many = n >= 2
    alignment = (
        F.when(centred, F.lit("center")).when(many & (end_spread <= w * 0.025) & (start_spread > w * 0.04), F.lit("right"))
        .when(many & (start_spread <= w * 0.025), F.lit("left")).when((left > 0.24) & (left - right >= 0.12), F.lit("right")).otherwise(F.lit("left"))
    )
    ratio = N.clamped((page_height - top) / max(page_height, 1.0), 0, 1)
    return alignment.alias("alignment"), N.vertical_zone(ratio).alias("vertical_position")


def grid_geometry(rules: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """(keys, horizontal, vertical, boxes, has_grid) from drawn rectangles: width, height, stroked (the next operator strokes)."""
    wide = (F.col("width") >= 24) & (F.col("height") <= F.greatest(F.lit(3.0), F.col("width") * 0.012))
    tall = (F.col("height") >= 24) & (F.col("width") <= F.greatest(F.lit(3.0), F.col("height") * 0.012))
    box = F.col("stroked") & (F.col("width") >= 12) & (F.col("height") >= 8)
    page = W.partitionBy(*keys)
    df = rules.withColumn("box", box)
    for side in ("width", "height"):
        df = df.withColumn(f"m_{side}", F.median(F.when(F.col("box"), F.col(side))).over(page))
    alike = F.lit(True)
    for side in ("width", "height"):
        alike = alike & (F.abs(F.col(side) - F.col(f"m_{side}")) <= F.greatest(F.lit(2.0), F.col(f"m_{side}") * 0.22))
    out = df.groupBy(*keys).agg(F.count_if(wide).alias("horizontal"), F.count_if(tall).alias("vertical"), F.count_if(F.col("box") & alike).alias("boxes"))
    return out.withColumn("has_grid", ((F.col("horizontal") >= 2) & (F.col("vertical") >= 2)) | (F.col("boxes") >= 4))


def dominant_family(runs: DataFrame, keys: tuple[str, ...] = (*PAGE, "line_no")) -> DataFrame:
    """(keys, family) with most characters on the line; of equals, the one that comes first."""
    per = runs.groupBy(*keys, "family").agg(F.sum(F.length("text")).alias("weight"), F.min("run_no").alias("first"))
    return per.groupBy(*keys).agg(F.max_by("family", F.struct("weight", (-F.col("first")).alias("early"))).alias("family"))


def paragraph_breaks(lines: DataFrame, advance: Column | float, page_width: Column | float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """lines with ``breaks`` (a paragraph begins here) and ``paragraph_no``, from text, y, x_start, x_end, line_height, char_width, family, size."""
    order = W.partitionBy(*keys).orderBy("line_no")
    advance = advance if isinstance(advance, Column) else F.lit(float(advance))
    width = page_width if isinstance(page_width, Column) else F.lit(float(page_width))

    def before(c: str) -> Column:
        return F.lag(c).over(order)

    text, last = X.trimmed(F.col("text")), X.trimmed(F.coalesce(before("text"), F.lit("")))
    gap = before("y") - F.col("y")
    fill = (before("x_end") - before("x_start")) / width
    ratio = F.col("size") / N.or_default(before("size"), 10)
    ended = last.rlike("[.!?][\"'”’)]?\\z")
    continues = text.rlike("^[a-z,;)]")
    opened = last.rlike("[,;:(-]\\z")
    shift = F.abs(F.col("x_start") - before("x_start")) / F.greatest(F.col("char_width"), F.lit(2.0))
    breaks = (
        F.when(before("y").isNull() | (gap > F.greatest(F.col("line_height") * 1.72, advance * 1.45)) | X.starts_structured(text) | (text == "") | (last == ""), F.lit(True))
        .when(continues | opened | (fill >= 0.74), F.lit(False)).when((F.col("family") != before("family")) & ~ratio.between(0.86, 1.16), F.lit(True))
        .when(ended & text.rlike("^[\"'“‘(]?[A-Z]") & ((fill < 0.68) | (shift >= 2.5)), F.lit(True)).otherwise(F.lit(False))
    )
    return lines.withColumn("breaks", breaks).withColumn("paragraph_no", F.sum(F.when(F.col("breaks"), 1).otherwise(0)).over(order).cast("int"))


def joined_hyphens(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, text): a line that ends in a letter and a hyphen takes the next, if that starts with a small letter, without the hyphen; a chain
    of such lines becomes one, at the place of its first."""
    order = W.partitionBy(*keys).orderBy("line_no")
    soft = F.coalesce(F.lag("text").over(order).rlike("[A-Za-z]-\\z") & F.col("text").rlike("^[a-z]"), F.lit(False))
    runs = lines.withColumn("soft", soft).withColumn("run", F.sum(F.when(F.col("soft"), 0).otherwise(1)).over(order))
    follows = F.coalesce(F.lead("soft").over(order), F.lit(False))
    runs = runs.withColumn("part", F.when(follows, F.regexp_replace("text", "-\\z", "")).otherwise(F.col("text")))
    out = runs.groupBy(*keys, "run").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("o"))
    return out.select(*keys, "line_no", F.array_join(F.transform("o", lambda x: x["part"]), "").alias("text"))


def page_images(ops: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The first operator of each painted image object that is at least 24 by 24 with 2,048 pixels."""
    kinds = ("paintImageXObject", "paintJpegXObject", "paintImageXObjectRepeat", "paintInlineImageXObject")
    first = F.row_number().over(W.partitionBy(*keys, "object_id").orderBy("op_seq")) == 1
    return ops.where(F.col("fn").isin(*kinds)).withColumn("is_first", first).where("is_first and width >= 24 and height >= 24 and width * height >= 2048").drop("is_first")


def ordered_items(items: DataFrame, tolerance: float, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """items with ``rank``: rows of items that are no further below a row's first item than the tolerance, from the top; a row goes by x."""
    pages = _in_order(items, tolerance, keys).select(*keys, F.posexplode("its").alias("place", "i"))
    return pages.select(*keys, "i.item.*", (F.col("place") + 1).alias("rank")).select(*items.columns, "rank")


def _in_order(items: DataFrame, tolerance: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, its): a page's items in the order of ``ordered_items``, as an array of row, across, seq and item."""
    rest = [c for c in items.columns if c not in keys]

    def step(acc: Column, down: Column) -> Column:
        joins = (acc["row"] >= 0) & (acc["y"] + down <= tolerance)
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(row.alias("row"), F.when(joins, acc["y"]).otherwise(-down).alias("y"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    down = F.array_sort(F.collect_list(F.struct((-F.col("y").cast("double")).alias("down"), F.col("x").cast("double").alias("across"), F.col("item_seq").cast("long").alias("seq"), F.struct(*rest).alias("item"))))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("rows"))
    pages = items.groupBy(*keys).agg(down.alias("its")).withColumn("rows", F.aggregate(F.transform("its", lambda i: i["down"]), zero, step, lambda a: a["rows"]))
    rowed = F.zip_with("its", "rows", lambda i, r: F.struct(r.alias("row"), i["across"].alias("across"), i["seq"].alias("seq"), i["item"].alias("item")))
    return pages.select(*keys, F.array_sort(rowed).alias("its"))
