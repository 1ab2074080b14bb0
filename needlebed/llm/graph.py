"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from needlebed.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Loops, repeated edges and edges both ways do no harm; edges with a null end are left out; no edges, no rows. Each
    step is one shuffle of narrow rows, the number of steps is logarithmic, and each step is cut to the shared folder,
    the edges too, so that what makes them runs once.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    by_u = Window.partitionBy("u")
    before = None
    while True:
        # Large star: the larger neighbours of u go to the smallest of u and its neighbours.
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of these.
        least = large.withColumn("m", F.min("v").over(by_u))
        e = least.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).unionAll(
            least.where(F.col("v") != F.col("m")).select("u", F.col("m").alias("v"))
        )
        e = cut(e.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
