"""Numbers as Column expressions: layout arithmetic, sanitizing, traits, sizes. Halves round up, as in ECMAScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamped(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.least(high, F.greatest(low, c))


def or_default(c: Column, default: Column | float) -> Column:
    """c, but the default where c is null, NaN or 0."""
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(F.nullif(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), default)


# fixed values: (ratio below which, percent); the last holds for all above
SIZE_CLASSES = ((0.78, 75), (0.92, 88), (1.09, 100), (1.21, 112), (1.39, 125), (1.64, 150), (None, 175))


def size_class(size: Column, base: Column) -> Column:
    ratio = F.greatest(F.lit(0.1), size / F.greatest(base, F.lit(1.0)))
    out = None
    for below, percent in SIZE_CLASSES[:-1]:
        out = (F if out is None else out).when(ratio < below, F.lit(percent))
    return out.otherwise(F.lit(SIZE_CLASSES[-1][1]))


def vertical_zone(top_ratio: Column) -> Column:
    return F.when(top_ratio < 0.28, F.lit("top")).when(top_ratio < 0.64, F.lit("middle")).otherwise(F.lit("bottom"))


def offset_level(top_ratio: Column) -> Column:
    return clamped(rounded(top_ratio * 16), 0, 8).cast("int")


def indent_level(x: Column, left: Column, char_width: Column) -> Column:
    chars = F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)) - F.coalesce(left, F.lit(0.0))) / F.greatest(or_default(char_width, 4), F.lit(2.0))
    return F.when(chars >= 8, F.lit(2)).when(chars >= 3.5, F.lit(1)).otherwise(F.lit(0))


def line_indent(x: Column, least_x: Column, space: Column) -> Column:
    """struct(spaces, level, pad) of a line's start."""
    spaces = F.greatest(F.lit(0), rounded((x - least_x) / F.greatest(space, F.lit(4.0)))).cast("int")
    level = F.when(spaces >= 9, F.lit(3)).when(spaces >= 5, F.lit(2)).when(spaces >= 2, F.lit(1)).otherwise(F.lit(0))
    return F.struct(spaces.alias("spaces"), level.alias("level"), F.repeat(F.lit(" "), F.least(spaces, F.lit(12))).alias("pad"))


def slider(value: Column, low: float, high: float, step: float, fallback: float) -> Column:
    """A stored setting as a step within its bounds; what is no finite number gives the fallback. An empty text counts as 0."""
    text = F.trim(value.cast("string"))
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    inside = clamped(number, low, high)
    snapped = F.lit(low) + rounded((inside - low) / step) * step
    return F.when(finite, clamped(F.round(snapped, 6), low, high)).otherwise(F.lit(float(fallback)))


def page_count(width: Column, page_width: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((width - 0.5) / page_width)).cast("long")


def contrast_channel(value: Column, contrast: Column | float) -> Column:
    contrast = contrast if isinstance(contrast, Column) else F.lit(float(contrast))
    return clamped((value - 128) * contrast + 128, 0, 255)


def gray_level(luminance: Column) -> Column:
    """The nearest of 16 levels."""
    return (rounded(luminance / 17) * 17).cast("int")


def image_width(value: Column) -> Column:
    """Percent in steps of 5 between 25 and 100; 100 where there is none."""
    v = F.when(value > 0, value).otherwise(F.lit(100.0))
    return clamped(rounded(v / 5) * 5, 25, 100).cast("int")


def image_width_for_page(width: Column, height: Column, fit_percent: Column, images: Column, block: Column, target_width: Column, target_height: Column) -> Column:
    """The percentage of the page's width at which so many images share the height that is left."""
    w, h = F.greatest(F.lit(1.0), or_default(width, 1)), F.greatest(F.lit(1.0), or_default(height, 1))
    count = F.greatest(F.lit(1.0), rounded(or_default(images, 1)).cast("double"))
    room = clamped(or_default(fit_percent, 72) / 100, 0.2, 0.92)
    each = F.greatest(F.lit(0.18), (room - (count - 1) * 0.035) / count)
    natural = target_height * each * (w / h) / F.greatest(F.lit(1.0), target_width) * 100
    return clamped(F.floor(natural / 5) * 5, 25, F.when(block, F.lit(100.0)).otherwise(F.lit(60.0))).cast("int")


def fitted(width: Column, height: Column, most_width: Column, most_height: Column) -> Column:
    """struct(width, height): inside the given, never larger than it was, a pixel at least."""
    scale = F.least(F.lit(1.0), most_width / width, most_height / height)
    return F.struct(F.greatest(F.lit(1), rounded(width * scale)).cast("int").alias("width"), F.greatest(F.lit(1), rounded(height * scale)).cast("int").alias("height"))


def file_size(n: Column) -> Column:
    """Bytes, KB or MB, with one decimal below ten units."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))

    def unit(size: int, name: str) -> Column:
        v = n / size
        one = F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10)
        return F.concat(F.when(v < 10, one).otherwise(F.floor(v + 0.5).cast("string")), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, "KB")).otherwise(unit(1 << 20, "MB"))


# -- traits with three values: null says nothing ---------------------------------------------------------------------------------------


def on_off(present: Column, value: Column) -> Column:
    """Null where absent; false for the words that switch off; else true."""
    return F.when(present, ~F.coalesce(F.lower(F.trim(value)).isin("0", "false", "off", "no", "none"), F.lit(False)))


def overlay(base: Column, over: Column) -> Column:
    return F.coalesce(over, base)


def toggle(default: Column, levels: Column, direct: Column) -> Column:
    """Direct formatting wins; a true default stays; else the levels that are true cancel in pairs."""
    odd = F.aggregate(levels, F.lit(False), lambda a, x: a != F.coalesce(x, F.lit(False)))
    return F.coalesce(direct, F.coalesce(default, F.lit(False)) | odd)


def override(default: Column, table: Column, paragraph: Column, character: Column, direct: Column) -> Column:
    """The last level that says something wins."""
    return F.coalesce(direct, character, paragraph, table, default, F.lit(False))


def look_flag(attribute: Column, mask: Column, bit: int) -> Column:
    """A table-look flag: its own attribute first, else a bit of the hexadecimal mask."""
    return F.coalesce(attribute, F.conv(mask, 16, 10).cast("long").bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def list_info(num_id: Column, level: Column) -> Column:
    """struct(num_id, level): level within 0 and 8; null without a list."""
    number = F.coalesce(level.try_cast("int"), F.lit(0))
    return F.when(num_id.isNotNull() & ~num_id.isin("", "0"), F.struct(num_id.alias("num_id"), F.least(F.lit(8), F.greatest(F.lit(0), number)).alias("level")))
