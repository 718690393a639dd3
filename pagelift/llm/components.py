"""Connected components of an edge table, by minimum labels and pointer jumps; nothing but a row count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label) for each vertex of an edge: label is the least vertex that it reaches.

    Each round takes the least label of the neighbours, then the label's own label, so that a chain of n vertices needs in the
    order of log n rounds. A vertex with very many edges is one key of plain joins, which Spark splits where they are skewed, and
    of aggregates that are combined before the shuffle. Rounds are written to the shared checkpoint folder. Null ends and
    loops are passed over; without edges there are no rows.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = saved(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["v"] == near["a"]).select("v", "label", F.least("label", "near").alias("lower"))
        own = labels.select(F.col("v").alias("w"), F.col("label").alias("jump"))
        new = saved(lower.join(own, lower["lower"] == own["w"]).select("v", F.col("label").alias("was"), F.least("lower", "jump").alias("label")))
        if not new.where("label < was").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")
