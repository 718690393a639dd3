"""Registered queries over pictures: embeddings as small images, fitted to boxes and kept for devices."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import rasters
from ..session import checkpoints
from .catalog import QUERIES, query, table


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a picture of eight by eight gray pixels with alpha in every second row, for a box by its number."""
    level = lambda x, i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 64) + 128)).cast("double")
    with_alpha = F.flatten(F.transform("embedding", lambda x, i: F.array(level(x, i), F.when(i % 2 == 0, F.lit(255.0)).otherwise(F.lit(51.0)))))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) = 64")
    box = lambda name, *sizes: F.element_at(F.array(*map(F.lit, sizes)), (F.col("vec_id") % 4 + 1).cast("int")).alias(name)
    gray = F.transform("embedding", level)
    return rows.select("vec_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1).alias("channels"), F.when(F.col("vec_id") % 3 == 0, with_alpha).otherwise(gray).alias("pixels"), box("most_width", 5, 3, 8, 20), box("most_height", 5, 8, 2, 7))


@query("""
WITH e AS (SELECT vec_id, embedding, CASE vec_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 8 ELSE 20 END AS bw, CASE vec_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 2 ELSE 7 END AS bh FROM embeddings WHERE len(embedding) = 64),
s AS (SELECT *, CAST(greatest(1, floor(8 * least(1, bw / 8.0, bh / 8.0) + 0.5)) AS INTEGER) AS n FROM e),
p AS (SELECT vec_id, n, i // 8 AS y, i % 8 AS x, least(255, greatest(0, floor(CAST(embedding[i + 1] AS DOUBLE) * 64) + 128)) AS g, CASE WHEN vec_id % 3 = 0 AND i % 2 = 1 THEN 51 ELSE 255 END AS a FROM s, range(64) AS r(i)),
q AS (SELECT *, g * a + 255 * (255 - a) AS v FROM p),
o AS (SELECT vec_id, q.n, oy.i AS oy, ox.i AS ox, sum(v * greatest(0, least((oy.i + 1) * 8, (y + 1) * q.n) - greatest(oy.i * 8, y * q.n)) * greatest(0, least((ox.i + 1) * 8, (x + 1) * q.n) - greatest(ox.i * 8, x * q.n))) / (64 * 255.0::DOUBLE) AS v FROM q JOIN range(8) AS oy(i) ON oy.i < q.n JOIN range(8) AS ox(i) ON ox.i < q.n GROUP BY ALL)
SELECT vec_id, n AS width, n AS height, string_agg(CAST(CAST(floor(v + 0.5) AS INTEGER) AS VARCHAR), ',' ORDER BY oy, ox) AS pixels FROM o GROUP BY 1, 2, 3""")
def resampled_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-4: pictures with and without alpha inside four boxes, every pixel."""
    made = rasters.resampled(_boxes(spark, sf_dir), ("vec_id",))
    return made.select("vec_id", "width", "height", F.array_join("pixels", ",").alias("pixels"))


@query("""
WITH n AS (SELECT label, count(*) AS asked, count(DISTINCT embedding) AS pictures FROM embeddings WHERE len(embedding) = 64 AND label IS NOT NULL GROUP BY 1)
SELECT label, asked * 3 AS asked, pictures AS first_made, 0::BIGINT AS again_made, pictures * 2 AS more_made FROM n""")
def kept_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMG-6: a store of variants: the first request makes each picture once, the same request nothing, one for two more devices only theirs; all that is asked for comes back."""
    checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/variants-{uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null and size(embedding) = 64 and label is not null")
    pictures = rows.select("label", F.sha2(F.concat_ws(",", F.col("embedding").cast("array<string>")), 256).alias("digest"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("channels"), F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), x.cast("double") * 64 + 128))).alias("pixels"))

    def asked(*devices: str) -> DataFrame:
        boxes = F.explode(F.array(*(F.struct(F.lit(d).alias("device"), F.lit("portrait").alias("orientation"), F.lit(4 + i).alias("most_width"), F.lit(6).alias("most_height")) for i, d in enumerate(devices)))).alias("d")
        return pictures.select("*", boxes).select("*", "d.*").drop("d")

    def make(lacking: DataFrame) -> DataFrame:
        return rasters.resampled(lacking.select(*rasters.IDENTITY, "label", "width", "height", "channels", "pixels", "most_width", "most_height"), (*rasters.IDENTITY, "label"))

    runs = []
    for devices in (("clara",), ("clara",), ("clara", "libra", "sage")):
        before = {r.label: r["count"] for r in spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy("label").count().collect()} if runs else {}
        found, _ = rasters.stored_variants(asked(*devices), folder, make)
        after = spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy("label").count().collect()  # a row for each label
        runs.append({r.label: r["count"] - before.get(r.label, 0) for r in after})
    counts = spark.createDataFrame([(k, runs[0][k], runs[1][k], runs[2][k]) for k in runs[0]], "label int, first_made long, again_made long, more_made long")
    return found.groupBy("label").agg(F.count("*").alias("asked")).join(counts, "label").select("label", "asked", "first_made", "again_made", "more_made")


@query("""
WITH d(device, sw, sh, ppi, bw, bh, lf) AS (VALUES ('clara-bw', 1072, 1448, 300, 112.0::DOUBLE, 160.0::DOUBLE, NULL::DOUBLE), ('clara-colour', 1072, 1448, 300, 112.0, 160.0, NULL), ('libra-colour', 1264, 1680, 300, 144.6, 161.0, 8.5), ('sage', 1440, 1920, 300, 160.5, 181.4, 8.5), ('elipsa-2e', 1404, 1872, 227, 193.0, 227.0, 8.5)),
m AS (SELECT *, CAST(sw AS DOUBLE) / ppi * 25.4 AS wm, CAST(sh AS DOUBLE) / ppi * 25.4 AS hm FROM d), g AS (SELECT *, coalesce(lf, (bw - wm) / 2) AS lm, (bh - hm) / 2 AS tm FROM m),
a AS (SELECT device, 'portrait' AS orientation, round(lm, 6) AS screen_left, round(tm, 6) AS screen_top, sw, sh FROM g UNION ALL SELECT device, 'landscape', round(bh - tm - hm, 6), round(lm, 6), sh, sw FROM g),
p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'clara-bw' WHEN 1 THEN 'clara-colour' WHEN 2 THEN 'libra-colour' WHEN 3 THEN 'sage' ELSE 'elipsa-2e' END AS device, CASE WHEN p_partkey % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS orientation, p_size * 60.0 AS w, p_retailprice * 2 AS h FROM part)
SELECT p_partkey, device, orientation, screen_left, screen_top, CAST(greatest(1, floor(w * least(1, sw / w, sh / h) + 0.5)) AS INTEGER) AS width, CAST(greatest(1, floor(h * least(1, sw / w, sh / h) + 0.5)) AS INTEGER) AS height FROM p JOIN a USING (device, orientation)""")
def pictures_on_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH-5, MTH-7: every part's picture on a device: where its screen lies in the body, either way up, and the size that fits it. Devices are a dimension of ten rows."""
    size, way = F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, F.lit("portrait")).otherwise(F.lit("landscape"))
    device = F.element_at(F.array(*(F.lit(d) for d in ("clara-bw", "clara-colour", "libra-colour", "sage", "elipsa-2e"))), (size % 5 + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select("p_partkey", device.alias("device"), way.alias("orientation"), (size * 60.0).alias("w"), (F.col("p_retailprice") * 2).cast("double").alias("h"))
    both = parts.join(F.broadcast(QUERIES["device_geometry"](spark, sf_dir)), ["device", "orientation"])
    fits = N.fitted(F.col("w"), F.col("h"), F.col("width_px").cast("double"), F.col("height_px").cast("double"))
    return both.select("p_partkey", "device", "orientation", "screen_left", "screen_top", fits["width"].alias("width"), fits["height"].alias("height"))
