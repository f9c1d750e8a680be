"""Mixing sources to target weights by weighted fair queueing over shuffled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import free, words

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the shuffle key that cut a source into ranges: 4,096 of them, so a hot source is spread as well.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling in closed form.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all sizes; a target stops
    at ``epochs`` times its source's size and the excess goes to the others by weight. One row per source: the windows
    run over the source table alone; no sources, no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weigh = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % n + 1)
    weighed = sizes.withColumn("weight", weigh.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    filled = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(by_fill), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0))).alias("open_weight"),
    ).withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("full")) / F.col("open_weight"))
    capped = F.col("level") * F.col("weight") > F.col("cap")
    level = F.max(F.when(~capped, F.col("level"))).over(everything)
    return filled.withColumn("top", level).select(
        "source", "source_size", F.when(capped | F.col("top").isNull(), F.col("cap").cast("double")).otherwise(F.col("top") * F.col("weight")).alias("target")
    )


def fair_queue(docs: DataFrame, size: Column, weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "mix-1") -> DataFrame:
    """All columns of ``docs`` with size, source_size, target, taken, queue_start and queue_key, which replace columns of these names.

    Inside a source the documents stand in the order of a seeded hash of their id and text; a copy's virtual finish time is the
    source's tokens up to and including it over the source's target. The mix takes what finishes by time 1, that is at the
    total budget; the one copy that crosses it is cut there, so every source meets its target to the token. ``epochs``
    copies of a document stand behind each other. Prefix sums go range by range of the hash, so no task holds a source.
    Null sources are one source; null ids and texts hash as empty ones, and many rows of one id, or of none, are spread by
    their texts, so ties are equal rows and reruns agree; repeated rows are taken like others. An empty table gives none.
    """
    out = ["size", "source_size", "target", "taken", "queue_start", "queue_key"]
    docs = docs.drop(*out)
    part, source, place, ahead, within = free(docs, "_range", "_source", "_place", "_ahead", "_within")
    text = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256)
    rows = docs.select("*", F.coalesce(size.cast("long"), F.lit(0)).alias("size"), key.alias("queue_key")).withColumn(part, F.substring("queue_key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("source", part).agg(F.sum("size").alias(within))
    before = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(ranges.groupBy("source").agg(F.sum(within).alias("source_size")), weights, share, epochs)
    ranges = ranges.select(F.col("source").alias(source), F.col(part).alias(place), F.coalesce(F.sum(within).over(before), F.lit(0)).alias(ahead))
    ranges = ranges.join(targets, F.col(source).eqNullSafe(F.col("source"))).drop("source")
    joined = rows.join(ranges, F.col("source").eqNullSafe(F.col(source)) & (F.col(part) == F.col(place)))
    inside = Window.partitionBy("source", part).orderBy("queue_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col(ahead) + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("source_size") * e - F.col("queue_start"))) for e in range(epochs))
    return joined.withColumn("queue_start", start).withColumn("taken", taken.cast("long")).select(*[f"`{c}`" for c in docs.columns], *out)


def training_order(queue: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself: one row per copy taken, ``epoch``, ``copy_taken`` and virtual ``finish``, range-sorted by finish.

    These three replace columns of their names; an empty queue gives an empty mix.
    """
    copies = queue.drop("epoch", "copy_taken", "finish").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    start = F.col("source_size") * F.col("epoch") + F.col("queue_start")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start)).cast("long")
    finish = F.least(F.lit(1.0), (start + F.col("size")) / F.col("target"))
    return copies.withColumn("copy_taken", taken).filter("copy_taken > 0").withColumn("finish", finish).orderBy("finish", "queue_key", "epoch")


def mix_words(docs: DataFrame) -> DataFrame:
    """``fair_queue`` with the number of words as size (null text: 0)."""
    return fair_queue(docs, F.size(words(F.col("text"))))


#: DuckDB SQL for the digest of ``mix_words`` over ``documents``.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  sha256('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha256(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight FROM w),
l AS (SELECT *, (CAST(total AS DOUBLE) * 1.5::DOUBLE - CAST(filled AS DOUBLE)) / CAST(open_weight AS DOUBLE) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN level * weight > cap OR top IS NULL THEN CAST(cap AS DOUBLE) ELSE top * weight END AS target
      FROM (SELECT *, max(CASE WHEN NOT level * weight > cap THEN level END) OVER () AS top FROM l)),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, budget - start)) + greatest(0, least(size, budget - source_size - start)) AS BIGINT) AS taken
FROM q
"""
