"""Bounded labelled samples and a small logistic model, shared by the text classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_ids(labels: DataFrame, label: str, learn: Column, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(_id, _y) of at most ``per_class`` labelled ids of each class, by a hash of the id, and rows per sampled row.

    Chosen on the labels alone. An id labelled both ways counts as 1. The frame has at most ``2 * per_class`` rows.
    """
    spark = labels.sparkSession
    known = labels.filter(learn & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_y"))
    totals = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    # a top-k per class keeps at most ``per_class`` rows of every input partition
    picks = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(per_class) for y in totals]
    rows = [r for pick in picks for r in pick.collect()]
    taken = {y: sum(r["_y"] == y for r in rows) for y in totals}
    frame = spark.createDataFrame([(r["_id"], r["_y"]) for r in rows], "_id long, _y int")
    return frame, {y: totals[y] / taken[y] for y in totals}


def with_labels(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(_id, _y, text): the sampled documents; ``ids`` has a proven bound, so it is broadcast. One row per id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(ids), "_id")
    return rows.groupBy("_id", "_y").agg(F.min("text").alias("text"))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on the weighted logistic loss; the last coefficient is the intercept. One class alone: its base rate."""
    full = np.column_stack([x, np.ones(len(x))])
    coef = np.zeros(full.shape[1])
    penalty = np.diag([*[ridge] * x.shape[1], 1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(full @ coef, -30, 30)))
        grad = full.T @ (weight * (p - y)) + penalty @ coef
        step = np.linalg.solve((full.T * (weight * p * (1 - p) + 1e-9)) @ full + penalty, grad)
        coef -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return coef


def probability(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ coef[:-1] + coef[-1], -30, 30)))
