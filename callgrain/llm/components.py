"""Connected components of links that stay distributed.

Alternates large-star and small-star steps.  Every step is a minimum per node (combined
before its shuffle) and a join back to the links, so a node with very many links is
never gathered in one task; each step's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import mark, staged, sweep


def _state(edges: DataFrame):
    """Equal for equal sets of links."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``a, b`` long links."""
    spark = links.sparkSession
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = _state(edges)  # links that are stars already need one step
    while True:
        # large star: what lies above a node is tied to the least of its neighbourhood
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: what lies below a node is tied to the least of it
        large = large.filter("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = low.join(least, low["a"] == least["n"]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        at = mark() - 1  # the step before this one is not read again
        edges = staged(small.filter("a <> b").distinct(), "links")
        sweep(spark, at, edges)
        state = _state(edges)
        if state == seen:
            break
        seen = state
    # every link is now (node, smallest node of its component)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
