"""Skew-safe building blocks.

Every group-wise operator of the package goes through these helpers, so a key that holds a third of all rows
never lands whole in one task:

* ``first_per_key`` / ``top_per_key`` reduce inside each input partition before the shuffle;
* ``hot_keys`` finds the few keys above a share of all rows (its size is bounded by ``1 / share``);
* ``salted_join`` spreads exactly those keys over several tasks and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

#: Spark turns ``row_number() <= n`` into a per-partition limit before the shuffle up to this n.
GROUP_LIMIT = 1000
SALTS = 32


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key; at most one row per key and input partition is shuffled."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int, rank: str = "rank_in_key"
) -> DataFrame:
    """The first ``n`` rows of every key with their rank, exact for any ``n``.

    Below ``GROUP_LIMIT`` Spark limits each partition before the shuffle by itself. Above it the same is done by
    hand: top n of every (key, salt) first, then top n of the survivors.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS))
        partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(partial))
            .filter(F.col("_rn") <= n)
            .drop("_rn", "_salt")
        )
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


#: Rows of a key from which it is ranked by several tasks.
RANKED_BY_ONE = 1_000_000


def rank_in_key(df: DataFrame, keys: Sequence[str], order: str, rank: str, total: str, by_one: int = RANKED_BY_ONE) -> DataFrame:
    """``df`` with the dense rank of each row in its key, from 0, and the number of ranks of the key.

    One window ranks the keys of up to ``by_one`` rows. Larger ones are range-partitioned by key and order, ranked inside
    their ranges, and moved up by the ranks in the ranges before; rows of equal order lie in one range. Same result.
    """
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > by_one).select(*keys)
    large = cut_lineage(large)
    of_key = Window.partitionBy(*keys)
    ranked = df.withColumn(rank, F.dense_rank().over(of_key.orderBy(order)) - 1)
    if large.isEmpty():
        return ranked.withColumn(total, F.max(rank).over(of_key) + 1)
    small = ranked.join(large, list(keys), "left_anti").withColumn(total, F.max(rank).over(of_key) + 1)
    ranged = df.join(large, list(keys), "left_semi").repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    of_part = Window.partitionBy(*keys, "_part")
    inside = ranged.withColumn("_inside", F.dense_rank().over(of_part.orderBy(order)) - 1)
    parts = ranged.groupBy(*keys, "_part").agg(F.countDistinct(order).alias("_ranks"))
    before = F.sum("_ranks").over(of_key.orderBy("_part")) - F.col("_ranks")
    parts = parts.select(*keys, "_part", before.alias("_before"), F.sum("_ranks").over(of_key).alias(total))
    rows = inside.join(parts, [*keys, "_part"]).withColumn(rank, F.col("_before") + F.col("_inside"))
    return small.select(*df.columns, F.col(rank).cast("long"), F.col(total).cast("long")).unionByName(rows.select(*df.columns, rank, total))


def hot_keys(counts: DataFrame, n: str, max_keys: int = 256) -> DataFrame:
    """Keys of a (key…, count) frame that hold more than ``1 / max_keys`` of the total: fewer than ``max_keys`` rows."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * max_keys > total).drop(n)


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot: DataFrame, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Equi-join whose ``hot`` keys (see ``hot_keys``) are spread over ``salts`` tasks.

    Left rows of a hot key get a random-free salt from their content; the right rows of that key are repeated
    once per salt. ``hot`` has a proven bound, so it is broadcast. All other keys keep salt 0 and one copy.
    Valid for inner and left joins; ``on`` compares null-safely on neither side. Without a hot key it is the plain join, which
    takes over a partitioning by ``on`` that its sides have.
    """
    if hot.isEmpty():
        return left.join(right, list(on), how)
    marked = F.broadcast(hot.select(*on).withColumn("_hot", F.lit(True)))
    others = [F.col(f"`{c}`") for c in left.columns if c not in on] or [F.lit(0)]
    left_salted = left.join(marked, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    )
    spread = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(
        F.array(F.lit(0).cast("bigint"))
    )
    right_salted = right.join(marked, list(on), "left").withColumn("_salt", F.explode(spread)).drop("_hot")
    return left_salted.drop("_hot").join(right_salted, [*on, "_salt"], how).drop("_salt")
