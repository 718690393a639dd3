"""Markup as columns: style declarations to traits, classes, titles, fragments, presentation of images, canonical metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X


def declarations(style: Column) -> Column:
    """A style attribute as a map from lower-case property to value; a null style has none."""
    parts = F.filter(F.split(F.coalesce(style, F.lit("")), ";"), lambda d: F.contains(d, F.lit(":")))
    entries = F.transform(parts, lambda d: F.struct(F.lower(X.trimmed(F.substring_index(d, ":", 1))).alias("k"), X.trimmed(F.regexp_replace(d, "^[^:]*:", "")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def css_traits(style: Column) -> Column:
    """struct(bold, italic, underline, strike) of a style: true, false for a reset, null where nothing is said."""
    d = declarations(style)
    weight, slant = F.lower(F.try_element_at(d, F.lit("font-weight"))), F.lower(F.try_element_at(d, F.lit("font-style")))
    line = F.lower(F.coalesce(F.try_element_at(d, F.lit("text-decoration-line")), F.try_element_at(d, F.lit("text-decoration"))))
    number = weight.try_cast("int")
    bold = F.when(weight.isin("bold", "bolder") | (number >= 600), F.lit(True)).when(weight.isin("normal", "lighter") | (number <= 400), F.lit(False))
    italic = F.when(slant.rlike("^(italic|oblique)"), F.lit(True)).when(slant == "normal", F.lit(False))
    reset = line.rlike(r"\bnone\b")
    return F.struct(
        bold.alias("bold"), italic.alias("italic"), F.when(line.rlike(r"\bunderline\b"), F.lit(True)).when(reset, F.lit(False)).alias("underline"),
        F.when(line.rlike(r"\bline-through\b"), F.lit(True)).when(reset, F.lit(False)).alias("strike"),
    )


TAG_TRAITS = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "s": "strike", "del": "strike"}


def inherited_traits(nodes: DataFrame, keys: tuple[str, ...] = ("doc_id",), traits: tuple[str, ...] = ("bold", "italic", "underline", "strike")) -> DataFrame:
    """(keys, node_id, traits): of each trait the value of the nearest of a node and its ancestors that says something, false where none does.

    ``nodes``: node_id, path (ancestors' ids from the root, the node's own last), and the traits. A node meets its ancestors by equality of ids.
    """
    up = nodes.select(*keys, "node_id", F.posexplode(F.reverse("path")).alias("distance", "at"))
    said = up.join(nodes.select(*keys, F.col("node_id").alias("at"), *traits), [*keys, "at"])
    return said.groupBy(*keys, "node_id").agg(*[F.coalesce(F.min_by(t, F.when(F.col(t).isNotNull(), F.col("distance"))), F.lit(False)).alias(t) for t in traits])


def defines_typography(traits: Column) -> Column:
    return F.coalesce(traits["bold"], traits["italic"], traits["underline"], traits["strike"]).isNotNull()


def allowed_classes(classes: Column, pattern: str) -> Column:
    return F.filter(classes, lambda c: c.rlike(pattern))


def class_value(classes: Column, prefix: str, fallback: str) -> Column:
    """What follows the prefix in the first class that has it."""
    return F.coalesce(F.get(F.transform(F.filter(classes, lambda c: F.startswith(c, F.lit(prefix))), lambda c: F.substring(c, len(prefix) + 1, 1 << 20)), F.lit(0)), F.lit(fallback))


def titled(html: Column, title: Column) -> Column:
    """A chapter's fragment with its title as a heading, unless it starts with one, or with an element around one; breaks and blank pages before do not count."""
    body = X.trimmed(F.coalesce(html, F.lit("")))
    start = F.regexp_replace(body, r"(?is)^(?:\s*(?:<!--.*?-->|<(hr|div)\b[^>]*class=\"[^\"]*(?:page-break|blank-page)[^\"]*\"[^>]*>(?:\s*</div>)?))+\s*", "")
    kept = body.rlike(r"(?i)^<h[12][\s>]") | start.rlike(r"(?is)^<h[12][\s>]") | start.rlike(r"(?is)^<(?!h[1-6])[a-z][a-z0-9]*[^>]*>\s*<h[12][\s>]")
    return F.when(kept, body).otherwise(F.concat(F.lit("<h1>"), X.escape_xml(title), F.lit("</h1>"), body))


def prepared(html: Column) -> Column:
    """A body for a package: preformatted text as paragraphs with breaks, tables without styles, no empty paragraphs, no images without a source."""
    c = F.regexp_replace(html, r"(?i)<pre\b[^>]*>", "<p>")
    c = F.regexp_replace(c, r"(?i)</pre\s*>", "</p>")
    c = F.regexp_replace(c, r"(?i)(<(?:table|tr|td|th|tbody|thead)\b[^>]*?)\s+style\s*=\s*(?:\"[^\"]*\"|'[^']*')", "$1")
    c = F.regexp_replace(c, r"(?i)<img\b(?![^>]*\ssrc\s*=\s*[\"']?[^\"'\s>])[^>]*>", "")
    c = F.regexp_replace(c, rf"(?i)<p\b[^>]*>(?:[{X.WS}]|&nbsp;)*</p\s*>", "")
    return F.regexp_replace(c, "\n", "<br/>")


def without_marker(runs: Column, marker: Column) -> Column:
    """Texts of runs without a list marker at their start, which may lie over several; white space around it goes too."""
    whole = F.array_join(runs, "")
    pattern = F.concat(F.lit(rf"^[{X.WS}]*\Q"), marker, F.lit(rf"\E[{X.WS}]*"))
    gone = F.length(whole) - F.length(F.regexp_replace(whole, pattern, F.lit("")))
    before = lambda i: F.aggregate(F.slice(runs, F.lit(1), i), F.lit(0), lambda a, t: a + F.length(t))
    return F.transform(runs, lambda t, i: F.substring(t, F.least(F.length(t), F.greatest(F.lit(0), gone - before(i))) + 1, F.lit(1 << 30)))


def joined_lines(lines: Column) -> Column:
    """Lines of a paragraph joined by one space."""
    return X.compact(F.array_join(lines, " "))


def joined_runs(runs: Column) -> Column:
    """Runs of a line, with a space where a field ends in a colon or semicolon and a word or an hour follows."""
    def step(acc: Column, r: Column) -> Column:
        field = X.right_trimmed(acc).rlike(r"[:;]\z") & X.trimmed(r).rlike(r"^(?:[A-Z][a-z]|\d{1,2}(?i:am|pm)\b)") & ~acc.rlike(r"\s\z") & ~r.rlike(r"^\s")
        return F.concat(acc, F.when(field, F.lit(" ")).otherwise(F.lit("")), r)

    return X.token_spacing(F.aggregate(runs, F.lit(""), step))


def line_breaks(html: Column) -> Column:
    return (F.regexp_count(html, F.lit(r"(?i)<br\b")) + F.regexp_count(html, F.lit("\n"))).cast("long")


#: An image's place by its layout; widths are percentages.
LAYOUTS = ("block", "inline-left", "inline-right")


def image_presentation(layout: Column, width: Column, in_text: Column) -> Column:
    """struct(layout, width, on): a stored layout if it is one, else by whether text surrounds the image; a block's width is its figure's."""
    kind = F.when(layout.isin(*LAYOUTS), layout).when(in_text, F.lit("inline-left")).otherwise(F.lit("block"))
    return F.struct(kind.alias("layout"), N.image_width(width).alias("width"), F.when(kind == "block", F.lit("figure")).otherwise(F.lit("image")).alias("on"))


def data_url(media_type: Column, content: Column) -> Column:
    """An image's bytes as a source; null for what is no image."""
    return F.when(media_type.startswith("image/"), F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.base64(content)))


#: Rows of the dimension of devices.
MOST_DEVICES = 1_000


def image_variants(uses: DataFrame, devices: DataFrame) -> DataFrame:
    """uses (image_id, width, height, media_type) for each device (device, orientation, width_px, height_px, colour), each image converted once: size inside the
    screen, tone and format. ``devices`` is a table of a few rows, checked to be so."""
    held = devices.limit(MOST_DEVICES + 1).collect()
    if len(held) > MOST_DEVICES:
        raise ValueError(f"devices is a dimension of at most {MOST_DEVICES} rows")
    images = uses.groupBy("image_id").agg(*[F.min(c).alias(c) for c in ("width", "height", "media_type")])
    names = ("device", "orientation", "width_px", "height_px", "colour")
    each = F.array(*[F.struct(*[F.lit(d[n]).alias(n) for n in names]) for d in held]) if held else F.array().cast("array<struct<device:string,orientation:string,width_px:int,height_px:int,colour:boolean>>")
    both = images.withColumn("d", F.explode(each)).select(*images.columns, "d.*")  # a row for each image and device is the result asked for
    size = N.fitted(F.col("width"), F.col("height"), F.col("width_px"), F.col("height_px"))
    jpeg = F.col("colour") & (F.col("media_type") == "image/jpeg")
    return both.select("image_id", "device", "orientation", size["width"].alias("out_width"), size["height"].alias("out_height"), F.when(F.col("colour"), F.lit("colour")).otherwise(F.lit("dither")).alias("tone"), F.when(jpeg, F.lit("image/jpeg")).otherwise(F.lit("image/png")).alias("out_type"))


def page_metadata(zone: Column, offset: Column, top: Column, source_page: Column) -> Column:
    """struct of a page's layout within its bounds."""
    return F.struct(
        F.when(zone.isin("top", "middle", "bottom"), zone).otherwise(F.lit("top")).alias("zone"), F.least(F.lit(8), F.greatest(F.lit(0), F.coalesce(offset.cast("int"), F.lit(0)))).alias("offset"),
        N.clamped(F.coalesce(top.cast("double"), F.lit(0.0)), 0.0, 0.8).alias("top"), F.when(source_page > 0, source_page).alias("source_page"),
    )


def page_metadata_changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


def numbered_changes(changes: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """changes with ``change_id`` in order within a document."""
    return changes.withColumn("change_id", F.concat(F.lit("change-"), F.row_number().over(W.partitionBy(*keys).orderBy(order)).cast("string")))


def raster_scale(scale: Column) -> Column:
    return N.clamped(scale, 1.0, 2.5)
