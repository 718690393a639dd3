"""Pictures fitted to a device: alpha laid on paper, area resampling, and a store of the variants that were made.

A smaller picture's pixel is the mean of what it covers. In one direction that is a sparse matrix of overlaps, so that a picture is resampled by two products, rows and columns apart, for all pictures of one shape in a batch at once.
Overlaps are counted in whole units (a pixel in is as many units as there are pixels out, and the other way round), so sums are exact and the one division comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from ..session import reachable

#: Gray of paper, on which what is transparent is laid.
PAPER = 255.0
CHANNELS = {1: "gray", 2: "gray and alpha", 3: "colour", 4: "colour and alpha"}


def overlaps(size: int, fitted: int) -> np.ndarray:
    """fitted by size: how much of each pixel in lies under each pixel out, in units of 1 / fitted of a pixel in."""
    begin, end = np.arange(size) * fitted, (np.arange(size) + 1) * fitted
    low, high = np.arange(fitted)[:, None] * size, (np.arange(fitted)[:, None] + 1) * size
    return np.maximum(0, np.minimum(high, end) - np.maximum(low, begin)).astype(np.float64)


def on_paper(pictures: np.ndarray, paper: float = PAPER) -> tuple[np.ndarray, int]:
    """Pictures (n, height, width, channels) without alpha, and how many times too large their values are: whole numbers stay whole. Values are from 0 to 255, alpha too."""
    if pictures.shape[-1] not in (2, 4):
        return pictures, 1
    alpha = pictures[..., -1:]
    return pictures[..., :-1] * alpha + paper * (255 - alpha), 255


def shrunk(pictures: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    """Pictures (n, height, width, channels), ``times`` too large, at another size; each value rounded to the nearest whole one, a half up."""
    n, h, w, c = pictures.shape
    by_row = np.einsum("yh,nhwc->nywc", overlaps(h, height), pictures, optimize=True)
    total = np.einsum("xw,nywc->nyxc", overlaps(w, width), by_row, optimize=True)
    return np.floor(total / (h * w * times) + 0.5)


def resampled(pictures: DataFrame, keys: tuple[str, ...], most_width: str = "most_width", most_height: str = "most_height", paper: float = PAPER) -> DataFrame:
    """(keys, width, height, channels, pixels) of pictures (width, height, channels, pixels: numbers from 0 to 255 row by row, a pixel's channels together) inside boxes, never larger than they were.

    Alpha, the last of two or four channels, is laid on paper and goes. Null pixels, and pixels that do not fill width and height, give null. Repeated rows are made each for itself; a batch holds some pictures at a time; an empty table gives no rows; other columns are not carried.
    """
    size = N.fitted(F.col("width").cast("double"), F.col("height").cast("double"), F.col(most_width).cast("double"), F.col(most_height).cast("double"))
    rows = pictures.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), *(F.col(c).cast("int").alias(c) for c in ("width", "height", "channels")), F.col("pixels").cast("array<double>").alias("pixels"), size["width"].alias("to_width"), size["height"].alias("to_height"))
    schema = T.StructType([pictures.schema[k] for k in keys] + T.StructType.fromDDL("width int, height int, channels int, pixels array<int>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes = list(zip(*(b.column(c).to_pylist() for c in ("width", "height", "channels", "to_width", "to_height")), strict=True))
            raw, out = b.column("pixels").to_pylist(), [None] * b.num_rows
            alike: dict[tuple, list[int]] = {}
            for i, (w, h, c, *_) in enumerate(shapes):
                if raw[i] is not None and None not in shapes[i] and c in CHANNELS and len(raw[i]) == w * h * c and None not in raw[i]:
                    alike.setdefault(shapes[i], []).append(i)
            for (w, h, c, to_w, to_h), places in alike.items():
                flat, times = on_paper(np.array([raw[i] for i in places]).reshape(-1, h, w, c), paper)
                made = shrunk(flat, to_w, to_h, times)
                for i, picture in zip(places, made, strict=True):
                    out[i] = picture
            data = [None if p is None else p.astype(np.int32).ravel() for p in out]
            sizes = [(None,) * 3 if p is None else (p.shape[1], p.shape[0], p.shape[2]) for p in out]
            columns = [pa.array([s[j] for s in sizes], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*(b.column(f"k{i}") for i in range(len(keys))), *columns, pa.array(data, pa.list_(pa.int32()))], names=schema.names)

    reachable(pictures.sparkSession)
    return rows.mapInArrow(run, schema)


IDENTITY = ("digest", "device", "orientation")


def stored_variants(needed: DataFrame, store: str, make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """The variants that ``needed`` asks for, from a store of Parquet files, and how many had to be made.

    ``needed`` has IDENTITY (the content's digest, device, orientation) and what ``make`` needs, whose rows have IDENTITY and the variant. What the store lacks is made, each once however often it is asked for, and added by one job whose files appear when it is done: a job that fails leaves nothing. Nulls in
    IDENTITY are never stored. An empty request makes nothing; its store may not exist yet.
    """
    spark = needed.sparkSession
    wanted = needed.where(" and ".join(f"{c} is not null" for c in IDENTITY)).dropDuplicates(list(IDENTITY))
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def kept() -> DataFrame:
        return spark.read.option("recursiveFileLookup", "true").parquet(store)

    lacking = wanted.join(kept().select(*IDENTITY), list(IDENTITY), "left_anti") if held else wanted
    part = f"{store}/{uuid4().hex}"
    make(lacking).write.parquet(part)
    made = spark.read.parquet(part).count()
    return needed.select(*IDENTITY).join(kept(), list(IDENTITY)), made
