"""Resampling against sums over covered areas, and the store of variants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelift.operators import rasters

KIND = "id string, width int, height int, channels int, pixels array<double>, most_width int, most_height int"


def covered(size, fitted, i, j):
    """How much of pixel j in lies under pixel i out, in pixels in."""
    return max(0.0, min((i + 1) * size / fitted, j + 1) - max(i * size / fitted, j))


def test_resampled_is_the_mean_of_what_is_covered(spark):
    rng = random.Random(9)
    rows = []
    for n in range(40):
        w, h, c = rng.randrange(1, 9), rng.randrange(1, 9), rng.choice([1, 2, 3, 4])
        rows.append((f"p{n}", w, h, c, [float(rng.randrange(256)) for _ in range(w * h * c)], rng.randrange(1, 12), rng.randrange(1, 12)))
    bad = [("null", 2, 2, 1, None, 1, 1), ("short", 2, 2, 1, [1.0], 1, 1), ("hole", 1, 2, 1, [1.0, None], 1, 1), ("five", 1, 1, 5, [1.0] * 5, 1, 1), (None, 1, 1, 1, [7.0], 3, 3), ("p0", *rows[0][1:])]
    got = rasters.resampled(spark.createDataFrame(rows + bad, KIND).withColumn("k0", F.lit(1)).repartition(3), ("id",)).collect()
    assert len(got) == len(rows) + len(bad) and all(r.pixels is None and r.width is None for r in got if r.id in ("null", "short", "hole", "five"))
    assert [r.pixels for r in got if r.id is None] == [[7]] and len({tuple(r.pixels) for r in got if r.id == "p0"}) == 1
    by_id = {r.id: r for r in got}
    for key, w, h, c, pixels, most_w, most_h in rows:
        scale = min(1, most_w / w, most_h / h)
        out_w, out_h = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
        p = np.array(pixels).reshape(h, w, c)
        if c in (2, 4):
            p = p[..., :-1] * (p[..., -1:] / 255) + 255 * (1 - p[..., -1:] / 255)
        r = by_id[key]
        assert (r.width, r.height, r.channels) == (out_w, out_h, p.shape[2])
        for y in range(out_h):
            for x in range(out_w):
                for k in range(p.shape[2]):
                    mean = sum(p[v, u, k] * covered(h, out_h, y, v) * covered(w, out_w, x, u) for v in range(h) for u in range(w)) / (h / out_h * w / out_w)
                    assert abs(r.pixels[(y * out_w + x) * p.shape[2] + k] - mean) <= 0.5 + 1e-6
    assert rasters.resampled(spark.createDataFrame([], KIND), ("id",)).collect() == []


def test_store_of_variants(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    kind = "digest string, device string, orientation string, n int"
    first = spark.createDataFrame([("a", "d", "up", 1), ("a", "d", "up", 1), ("b", "d", "up", 2), (None, "d", "up", 3)], kind)
    make = lambda df: df.withColumn("made", F.col("n") * 10)
    found, made = rasters.stored_variants(first, store, make)
    assert made == 2 and sorted((r.digest, r.made) for r in found.collect()) == [("a", 10), ("a", 10), ("b", 20)]
    assert rasters.stored_variants(first, store, make)[1] == 0 and rasters.stored_variants(first.where("false"), store, make)[1] == 0
    more = first.unionByName(spark.createDataFrame([("a", "e", "up", 5), ("c", "d", "down", 6)], kind))
    with pytest.raises(Exception, match="broken"):
        rasters.stored_variants(more, store, lambda df: df.withColumn("made", F.raise_error(F.lit("broken")).cast("int")))
    found, made = rasters.stored_variants(more, store, make)
    assert made == 2 and found.count() == 5 and {r.made for r in found.where("digest = 'a' and device = 'd'").collect()} == {10}
