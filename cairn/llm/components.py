"""Connected components of an edge table: alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import Scratch


def components(scratch: Scratch, edges: DataFrame, label: str) -> DataFrame:
    """node, component (the smallest node reachable): a row for every node that has an edge.

    Each round replaces edges by fewer that point to smaller nodes; a hub only ever meets a minimum, which is combined
    before the shuffle, and a join that can be split. Rounds end when every node points to at most one, and none to a node
    that points on. Nulls are no nodes.
    """
    down = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def done(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("x"), F.lit(1).alias("o")).unionByName(df.select(F.col("b").alias("x"), F.lit(0).alias("o")))
        counts = ends.groupBy("x").agg(F.sum("o").alias("out"), F.count("*").alias("all"))
        return counts.filter("out > 1 OR (out > 0 AND all > out)").agg(F.count("*")).first()[0] == 0

    now, k = scratch.save(down(edges.filter("a IS NOT NULL AND b IS NOT NULL")), f"{label}0"), 0
    while not done(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = down(both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        k += 1
        now = scratch.save(down(small), f"{label}{k}")
        scratch.drop(f"{label}{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
