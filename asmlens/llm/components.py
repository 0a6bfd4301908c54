"""Connected components of an edge table, by alternating star contractions.

Each round is joins and minimum aggregates; no group is ever collected. Hubs
are safe: minima combine before the shuffle, and the joins leave both sides to
Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asmlens.llm._spark import dropped, written


def _contract(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; in and out: rows (a, b), a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.withColumnRenamed("m", "b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long, either order) to rows (node, component): the least node of its component, for every node with an edge.

    Loops and repeated edges do no harm, null ends are left out, and no edges
    give no rows. The number of rounds follows the logarithm of a component's size.
    """
    start = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars = written(start, "edges")
    for _ in range(most_rounds):
        ends = stars.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(stars.select(F.col("b").alias("n"), F.lit(0).alias("child"), F.lit(1).alias("root")))
        open_ = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root")).where("child > 1 or (child > 0 and root > 0)")
        if open_.isEmpty():
            break
        old, stars = stars, written(_contract(stars), "stars")
        dropped(old)
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    members = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
