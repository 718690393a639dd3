"""Embedded images: data URLs, signatures, de-duplication, tones."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import reachable

# fixed values: media types and the extensions of their files, the first for new files
EXTENSIONS = {"image/png": ("png",), "image/jpeg": ("jpg", "jpeg"), "image/gif": ("gif",), "image/webp": ("webp",), "image/svg+xml": ("svg",)}
#: Largest embedded source in bytes, and the same as base64.
MOST_BYTES = 12 * 1024 * 1024
MOST_CHARS = int(MOST_BYTES * 1.37)
PROBLEMS = ("malformed", "not an image", "unsupported type", "invalid data", "empty", "signature mismatch")
_SVG = "{http://www.w3.org/2000/svg}svg"


def extension(media_type: Column) -> Column:
    out = None
    for kind, (first, *_) in EXTENSIONS.items():
        out = (F if out is None else out).when(media_type == kind, F.lit(first))
    return out


def is_svg(content: bytes | None) -> bool:
    """Whether the bytes are XML whose root is an svg element of its namespace."""
    try:
        return ElementTree.fromstring((content or b"").decode("utf-8-sig")).tag == _SVG
    except (ElementTree.ParseError, UnicodeDecodeError, ValueError):
        return False


def _starts(content: Column, *signatures: str) -> Column:
    out = F.lit(False)
    for s in signatures:
        out = out | F.startswith(content, F.unhex(F.lit(s)))
    return out


def signature_matches(media_type: Column, content: Column) -> Column:
    """Whether raster bytes begin as their type says; null for SVG, whose check needs a parser."""
    riff = _starts(content, "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    return (
        F.when(media_type == "image/png", _starts(content, "89504E470D0A1A0A")).when(media_type == "image/jpeg", _starts(content, "FFD8FF"))
        .when(media_type == "image/gif", _starts(content, "474946383761", "474946383961")).when(media_type == "image/webp", riff)
    )


def decoded(images: DataFrame, source: str = "src", check_svg: bool = True) -> DataFrame:
    """images with media_type, content and problem (null, or the first of PROBLEMS that holds) of a ``data:`` source.

    Rows whose source is null are malformed. Only SVG content goes through Python.
    """
    src = F.coalesce(F.col(source), F.lit(""))
    whole = r"(?is)^data:([^,]*),(.*)\z"
    head, payload = F.regexp_extract(src, whole, 1), F.regexp_extract(src, whole, 2)
    parts = F.transform(F.split(head, ";"), lambda p: F.trim(p))
    media = F.lower(F.get(parts, F.lit(0)))
    base64 = F.exists(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p) == "base64")
    percent = F.encode(F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B"))), "UTF-8")
    content = F.when(base64, F.try_to_binary(payload, F.lit("base64"))).otherwise(percent)
    df = images.withColumn("media_type", F.when(src.rlike(whole), media)).withColumn("content", F.when(F.col("media_type").isin(*EXTENSIONS), content))
    problem = (
        F.when(F.col("media_type").isNull(), F.lit(PROBLEMS[0])).when(~F.startswith("media_type", F.lit("image/")), F.lit(PROBLEMS[1])).when(~F.col("media_type").isin(*EXTENSIONS), F.lit(PROBLEMS[2]))
        .when(F.col("content").isNull(), F.lit(PROBLEMS[3])).when(F.octet_length("content") == 0, F.lit(PROBLEMS[4])).when(~F.coalesce(signature_matches(F.col("media_type"), F.col("content")), F.lit(True)), F.lit(PROBLEMS[5]))
    )
    df = df.withColumn("problem", problem)
    if not check_svg:
        return df
    reachable(images.sparkSession)
    svg = F.pandas_udf(lambda s: s.map(is_svg), "boolean")
    needs = (F.col("media_type") == "image/svg+xml") & F.col("problem").isNull()
    return df.withColumn("problem", F.when(needs & ~svg(F.when(needs, F.col("content"))), F.lit(PROBLEMS[5])).otherwise(F.col("problem")))


def packaged(images: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """images (img_no, src, media_type) with asset_no and file_name: equal data sources of a document are one asset, numbered by first occurrence;
    remote sources have none."""
    embedded = images.where(F.lower("src").startswith("data:")).withColumn("digest", F.sha2("src", 256))
    first = embedded.groupBy(*keys, "digest").agg(F.min("img_no").alias("first_no"), F.min_by("media_type", "img_no").alias("kind"))
    first = first.withColumn("asset_no", F.row_number().over(W.partitionBy(*keys).orderBy("first_no")))
    first = first.select(*keys, "digest", "asset_no", F.concat(F.lit("image-"), F.col("asset_no"), F.lit("."), extension(F.col("kind"))).alias("file_name"))
    return images.withColumn("digest", F.when(F.lower("src").startswith("data:"), F.sha2("src", 256))).join(first, [*keys, "digest"], "left").drop("digest")


def diffused(gray: np.ndarray, threshold: float = 128.0) -> np.ndarray:
    """Black and white by error diffusion: 7, 3, 5 and 1 sixteenths to the right, below left, below, below right; single precision."""
    work = np.pad(gray.astype(np.float32), ((0, 1), (1, 1)))
    out = np.zeros(gray.shape, np.uint8)
    rows, columns = gray.shape
    for y in range(rows):
        line, below = work[y], work[y + 1]
        for x in range(1, columns + 1):
            new = np.float32(255.0) if line[x] >= threshold else np.float32(0.0)
            error = line[x] - new
            out[y, x - 1] = new
            line[x + 1] += error * np.float32(7 / 16)
            below[x - 1] += error * np.float32(3 / 16)
            below[x] += error * np.float32(5 / 16)
            below[x + 1] += error * np.float32(1 / 16)
    return out


def dithered(images: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, pixels) from gray ``pixels`` (array of numbers, 0 to 255) of ``width``; one image in memory at a time."""
    fields = [images.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", pixels array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if p is None else diffused(np.array(p, np.float32).reshape(-1, w)).ravel().tolist() for p, w in zip(b.column("pixels").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, pa.list_(pa.int32()))], names=[*keys, "pixels"])

    reachable(images.sparkSession)
    return images.select(*keys, "pixels", "width").mapInArrow(run, schema)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def pixels(content: bytes, width: int, height: int) -> np.ndarray | None:
    """RGBA of raw pixels, told apart by their length: RGBA, RGB, 8-bit gray, or 1-bit gray with padded rows; else null."""
    raw, n = np.frombuffer(content, np.uint8), width * height
    if len(raw) >= 4 * n:
        return raw[: 4 * n].reshape(height, width, 4)
    if len(raw) >= 3 * n:
        colour = raw[: 3 * n].reshape(height, width, 3)
    elif len(raw) >= n:
        colour = np.repeat(raw[:n].reshape(height, width, 1), 3, 2)
    elif len(raw) >= (stride := -(-width // 8)) * height:
        bits = np.unpackbits(raw[: stride * height].reshape(height, stride), axis=1)[:, :width]
        colour = np.repeat((bits * 255)[:, :, None], 3, 2)
    else:
        return None
    return np.concatenate([colour, np.full((height, width, 1), 255, np.uint8)], 2)
