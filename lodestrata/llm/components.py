"""Connected components of an edge table, by labels that spread and pointers that jump; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of longs: each vertex v with the least vertex of its component as label.

    Each round a vertex takes the least label among its neighbours and then that label's own label, so that the distance to
    the least vertex halves at least; rounds end when no label changes. Every round is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("label")))
    while True:
        spread = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        near = labels.join(spread, "v").select("v", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("v").alias("near"), F.col("label").alias("far"))
        after = stored(near.join(jump, "near").select("v", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("changed")))
        if after.filter("changed").isEmpty():
            return labels
        labels = after.drop("changed")
