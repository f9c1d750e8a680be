"""Connected components of an edge table by alternating large-star and small-star rounds (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import shared_folder, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    pairs = down.join(least, "u")
    return pairs.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    ).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    All rows take part in every round; rounds end when the edge table no longer changes (a logarithmic number). Every
    round is written to the shared folder, so a lost executor repeats at most one round. Hub nodes are spread by the
    skew join of adaptive execution; the minimum per node is combined before its shuffle. Self-loops and nulls go.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark)
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/0")
    mark, turn = None, 0
    while True:
        turn += 1
        now = stored(_small_star(_large_star(now)), f"{folder}/{turn}")
        new = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
