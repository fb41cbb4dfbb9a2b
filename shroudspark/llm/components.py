"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroudspark.llm._common import drop_table, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = F.least(F.col("a"), F.min("b").over(Window.partitionBy("a")))
    return both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = F.min("b").over(Window.partitionBy("a"))
    starred = edges.withColumn("m", least)
    return starred.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(starred.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's least.

    Large-star and small-star steps alternate until nothing changes; every round is
    written to the shared folder, and the rounds grow with the logarithm of the
    longest path.  Loops and repeated edges are allowed; no edges give no rows.
    """
    now = materialise(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars"
    )
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        after = materialise(_small_star(_large_star(now).distinct()).distinct(), "stars")
        drop_table(now)
        now = after
