"""Tables from positioned lines: pruned cells, header evidence, regions of a page that are tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate
from statistics import median

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .grouped import met


def built(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, row_no, column_no, text) of tables from cells (row, column, text): columns and rows without text go; a table of fewer than two of either is none.
    Missing cells are empty."""
    text = X.trimmed(F.coalesce("text", F.lit("")))
    filled = cells.withColumn("text", text).where("text <> ''")
    columns, rows = filled.select(*keys, "column").distinct(), filled.select(*keys, "row").distinct()
    guard = filled.groupBy(*keys).agg(F.count_distinct("column").alias("n_columns"), F.count_distinct("row").alias("n_rows")).where("n_columns >= 2 and n_rows >= 2").select(*keys)
    columns = columns.withColumn("column_no", F.row_number().over(W.partitionBy(*keys).orderBy("column")) - 1)
    rows = rows.withColumn("row_no", F.row_number().over(W.partitionBy(*keys).orderBy("row")) - 1)
    grid = rows.join(columns, list(keys)).join(guard, list(keys), "left_semi")  # the cells of one table
    one = filled.groupBy(*keys, "row", "column").agg(F.min("text").alias("text"))
    return grid.join(one, [*keys, "row", "column"], "left").select(*keys, "row_no", "column_no", F.coalesce("text", F.lit("")).alias("text"))


def header_evidence(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, header): whether lines (line_no, bold, char_width) of cells (column_no, x, text) look like a table under a bold header of two to six columns."""
    table = W.partitionBy(*keys)
    line = W.partitionBy(*keys, "line_no")
    column = W.partitionBy(*keys, "column_no")
    df = cells.withColumn("n", F.count("*").over(line)).withColumn("first", F.col("line_no") == F.min("line_no").over(table))
    df = df.withColumn("tolerance", F.greatest(F.median(F.coalesce("char_width", F.lit(4.0))).over(table) * 3, F.lit(16.0)))
    df = df.withColumn("off", F.abs(F.col("x") - F.median("x").over(column)) > F.col("tolerance"))
    text = X.trimmed(F.coalesce("text", F.lit("")))
    poor = (text == "") | (F.length(text) > 48) | text.rlike(r"^\(?\d{1,3}[).:]?(?![\w])") | text.rlike(r"[.!?]\z")
    a = df.groupBy(*keys).agg(
        F.count_distinct("line_no").alias("lines"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_if(F.col("first") & (poor | ~F.col("bold"))).alias("poor"), F.count_if("off").alias("off"),
        F.count_distinct(F.when(~F.col("first") & ~F.col("bold"), F.col("line_no"))).alias("plain"),
    )
    good = (F.col("lines") >= 3) & (F.col("low") == F.col("high")) & F.col("low").between(2, 6) & (F.col("poor") == 0) & (F.col("off") == 0) & (F.col("plain") >= F.ceil((F.col("lines") - 1) * 0.6))
    return a.select(*keys, good.alias("header"))


def regions(lines: DataFrame, pages: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, line_no, table_no, row_no, cells, header): the lines of a page that are rows of a table; all others are prose and get no row.

    ``lines``: line_no, y, line_height, bold, char_width, cells (array of x, end, text, in order of x). ``pages``: has_grid. Lines that are tabular, or in a stable run of
    two columns, no further apart than 2.4 line heights, are a region. If it is no table its first line is prose and the search goes on with the next.
    """
    schema = "line_no int, table_no int, row_no int, cells array<string>, header boolean"
    wanted = lines.select(*keys, F.col("line_no").cast("int").alias("line_no"), "y", "line_height", "bold", "char_width", "cells")
    return met(wanted, pages.select(*keys, "has_grid"), keys, lambda ls, ps: _page(ls, bool(ps and ps[0]["has_grid"])), schema)


def _columns(line: dict) -> list[dict]:
    out: list[dict] = []
    for c in line["cells"] or []:
        if out and c["x"] - out[-1]["end"] <= max(line["char_width"] * 4, 20):
            out[-1] = {"x": out[-1]["x"], "end": max(out[-1]["end"], c["end"]), "text": f"{out[-1]['text']} {c['text']}"}
        else:
            out.append(dict(c))
    return out


def _tabular(line: dict) -> bool:
    cells = line["cells"] or []
    wide = sum(b["x"] - a["end"] > max(line["char_width"] * 3.5, 18) for a, b in zip(cells, cells[1:]))
    return len(cells) >= 3 and wide >= 2


def _close(a: dict, b: dict) -> bool:
    return a["y"] - b["y"] <= a["line_height"] * 2.4


def _aligned(starts: list[float], lines: list[dict]) -> bool:
    middle, tolerance = median(starts), max(median(x["char_width"] or 4 for x in lines) * 3, 20)
    return all(abs(s - middle) <= tolerance for s in starts)


def _stable(lines: list[dict], columns: list[list[dict]]) -> set[int]:
    out: set[int] = set()
    run: list[int] = []
    two = [len(c) == 2 and not re.fullmatch(r"\(?\d{1,3}[.)]?|[•●▪◦‣∙·]", c[0]["text"].strip()) for c in columns]
    for i in range(len(lines) + 1):
        joins = i < len(lines) and two[i] and (not run or lines[run[-1]]["y"] - lines[i]["y"] <= max(lines[i]["line_height"] * 2.4, 24))
        if not joins and run:
            if len(run) >= 3 and _aligned([columns[k][1]["x"] for k in run], [lines[k] for k in run]):
                out.update(run)
            run = []
        if i < len(lines) and two[i]:
            run.append(i)
    return out


def _header(lines: list[dict], columns: list[list[dict]]) -> bool:
    n = len(columns[0])
    if len(lines) < 3 or not lines[0]["bold"] or not 2 <= n <= 6 or any(len(c) != n for c in columns):
        return False
    heads = [c["text"].strip() for c in columns[0]]
    if any(not h or len(h) > 48 or re.match(r"\(?\d{1,3}[).:]?(?!\w)", h) or re.search(r"[.!?]\s*\Z", h) for h in heads):
        return False
    if sum(not x["bold"] for x in lines[1:]) < math.ceil((len(lines) - 1) * 0.6):
        return False
    tolerance = max(median(x["char_width"] or 4 for x in lines) * 3, 16)
    return all(abs(c[k]["x"] - median(d[k]["x"] for d in columns)) <= tolerance for k in range(n) for c in columns)


def _pruned(rows: list[list[str]]) -> list[list[str]] | None:
    width = max(map(len, rows))
    padded = [[(c or "").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    used = [k for k in range(width) if any(r[k] for r in padded)]
    slim = [r for r in ([row[k] for k in used] for row in padded) if any(r)]
    return slim if len(used) >= 2 and len(slim) >= 2 else None


def _rows(lines: list[dict], columns: list[list[dict]], grid: bool) -> tuple[list[list[str]], bool] | None:
    header = _header(lines, columns)
    if not grid and not header:
        return None
    if len(lines) >= 3 and all(len(c) == 2 for c in columns) and _aligned([c[1]["x"] for c in columns], lines):
        rows = [[c["text"] for c in own] for own in columns]
        if _pruned(rows):
            return rows, header
    n_tabular = sum(map(_tabular, lines))
    if n_tabular < max(2, math.ceil(len(lines) * 0.5)):
        return None
    width = 4.0
    for x in lines:
        width = (width + (x["char_width"] or 4)) / 2
    tolerance = max(width * 1.8, 8)
    centres: list[list[float]] = []
    for x in sorted(c["x"] for line in lines for c in line["cells"]):
        if centres and abs(x - sum(centres[-1]) / len(centres[-1])) <= tolerance:
            centres[-1].append(x)
        else:
            centres.append([x])
    middles = [sum(c) / len(c) for c in centres]
    if len(middles) < 2:
        return None
    rows = []
    for line in lines:
        row = [""] * len(middles)
        for c in line["cells"]:
            k = min(range(len(middles)), key=lambda i: abs(middles[i] - c["x"]))
            if abs(middles[k] - c["x"]) <= 2.5 * tolerance:
                row[k] = f"{row[k]} {c['text']}".strip()
        rows.append(row)
    return (rows, header) if _pruned(rows) else None


def _page(lines: list[dict], grid: bool) -> Iterator[tuple]:
    columns = [_columns(x) for x in lines]
    stable = _stable(lines, columns)
    flags = [_tabular(x) or i in stable for i, x in enumerate(lines)]
    i = table_no = 0
    while i < len(lines):
        j = i
        while j < len(lines) and flags[j] and (j == i or _close(lines[j - 1], lines[j])):
            j += 1
        found = _rows(lines[i:j], columns[i:j], grid) if j - i >= 2 else None
        if found is None:
            i += 1
            continue
        rows, header = found
        for k, row in enumerate(rows):
            yield lines[i + k]["line_no"], table_no, k, row, header and k == 0
        table_no += 1
        i = j


def runs_of_line(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, run_no, text, signature, gap_level): parts of a line (x, width, text, char_width, height, y, signature, space_before) with the spaces between them.

    A gap over 0.55 of the running mean width, a blank item or a raised verse number makes 1 to 12 spaces; from five on, the next run bears a gap level instead.
    Parts of one signature and level are one run.
    """
    lines = parts.groupBy(*keys).agg(gathered_parts().alias("its"))
    return lines.select(*keys, F.posexplode(runs_of_parts(F.col("its"))).alias("run_no", "r")).select(*keys, "run_no", "r.*")


def runs_of_parts(its: Column) -> Column:
    """The runs (text, signature, gap_level) of an array of a line's parts, by the rule of ``runs_of_line``."""
    def step(acc: Column, p: Column) -> Column:
        gap = p["x"] - acc["end"]
        units = F.greatest(F.lit(1), F.least(F.lit(12), F.floor(gap / acc["space"] + 0.5).cast("int")))
        verse = acc["text"].rlike(r"^\s*\d{1,3}\s*\z") & p["text"].rlike("^\\s*[A-Za-z“\"'‘]") & (acc["height"] <= p["height"] * 0.82) & (acc["y"] - p["y"] >= p["height"] * 0.2)
        apart = acc["end"].isNotNull() & ((gap > acc["space"] * 0.55) | p["space_before"] | verse)
        level = F.when(~F.coalesce(apart, F.lit(False)), 0).when(units >= 9, 3).when(units >= 7, 2).when(units >= 5, 1).otherwise(0)
        said = F.when(F.coalesce(apart, F.lit(False)) & (level == 0), F.concat(F.repeat(F.lit(" "), units), p["text"])).otherwise(p["text"])
        last = F.try_element_at(acc["out"], F.lit(-1))
        same = F.coalesce((last["signature"] == p["signature"]) & (last["gap_level"] == level), F.lit(False))
        grown = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.struct(F.concat(last["text"], said).alias("text"), last["signature"].alias("signature"), last["gap_level"].alias("gap_level"))))
        out = F.when(same, grown).otherwise(F.concat(acc["out"], F.array(F.struct(said.alias("text"), p["signature"].alias("signature"), level.alias("gap_level")))))
        return F.struct((p["x"] + p["width"]).alias("end"), ((acc["space"] + p["char_width"]) / 2).alias("space"), p["text"].alias("text"), p["height"].alias("height"), p["y"].alias("y"), out.alias("out"))

    none = F.lit(None).cast("double")
    first = F.get(its, F.lit(0))["char_width"]
    zero = F.struct(none.alias("end"), F.coalesce(first, F.lit(4.0)).alias("space"), F.lit("").alias("text"), none.alias("height"), none.alias("y"), F.array().cast("array<struct<text:string,signature:string,gap_level:int>>").alias("out"))
    return F.aggregate(its, zero, step, lambda a: a["out"])


def gathered_parts() -> Column:
    """The parts of a group's line as an array in order, for ``runs_of_parts``."""
    numbers = [F.col(c).cast("double").alias(c) for c in ("x", "width", "char_width", "height", "y")]
    return F.array_sort(F.collect_list(F.struct(numbers[0], "part_no", *numbers[1:], "text", "signature", F.coalesce("space_before", F.lit(False)).alias("space_before"))))


def rows_of(lines: Column, has_grid: Column) -> Column:
    """For each of an array of a region's lines (as in ``regions``, in order) a struct of row_no, cells and header, null where it is prose, and ``tables``, how many have begun: ``regions`` without moving the lines."""
    kind = "array<struct<row_no:int,cells:array<string>,header:boolean,tables:int>>"

    def placed(pages: pa.Array, grids: pa.Array) -> pa.Array:
        out = []
        for ls, grid in zip(pages.to_pylist(), grids.to_pylist(), strict=True):
            at = {no: (k, row, header) for no, _, k, row, header in _page(ls, bool(grid))}
            begun = accumulate(at.get(x["line_no"], (None,))[0] == 0 for x in ls)
            out.append([dict(zip(("row_no", "cells", "header"), at.get(x["line_no"], (None,) * 3), strict=True), tables=int(n)) for x, n in zip(ls, begun, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("row_no", pa.int32()), ("cells", pa.list_(pa.string())), ("header", pa.bool_()), ("tables", pa.int32())])))

    return F.arrow_udf(placed, kind)(lines, has_grid)
