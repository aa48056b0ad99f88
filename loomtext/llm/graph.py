"""Connected components of a table of edges, by large-star and small-star steps.

Every step is a shuffle of the edges and shortens all paths, so the number of rounds grows with
the logarithm of the longest path. Each round is written to the shared folder and read again:
its lineage ends there, and nothing is lost with an executor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.tables import discard, materialized


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("w")), F.struct(F.col("m").alias("u"), F.col("v").alias("w")))).alias("e")).select("e.u", "e.w")


def components(edges: DataFrame) -> DataFrame:
    """(v, m): each node that has an edge and is not the least of its component, with the least one.
    `edges` has two columns of node ids; their order, repetitions and loops do not matter."""
    a, b = edges.columns
    by_u = Window.partitionBy("u")
    now = materialized(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct(), "edges")
    before = None
    while True:
        near = _both(now).withColumn("m", F.least("u", F.min("w").over(by_u)))
        large = near.filter("w > u").select(F.col("w").alias("v"), "m").distinct()
        down = large.select(F.col("v").alias("u"), F.col("m").alias("w")).withColumn("m", F.min("w").over(by_u))
        small = down.filter("w > m").select(F.col("w").alias("v"), "m").union(down.select(F.col("u").alias("v"), "m")).distinct()
        last, now = now, materialized(small, "edges")
        discard(last)
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if stats == before:
            return now
        before = stats
