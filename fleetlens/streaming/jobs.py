"""Job state in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which states are in progress, and the texts an expired job carries.
IN_PROGRESS = {
    "analyses": ["PENDING", "RUNNING"],
    "validations": ["PENDING", "RUNNING"],
    "remediations": ["PENDING"],
    "findings": ["RUNNING"],
    "repositories": ["PENDING"],
}
LAST_SIGNAL = {
    "analyses": ["heartbeat_at", "started_at", "created_at"],
    "validations": ["heartbeat_at", "created_at"],
    "remediations": ["heartbeat_at", "created_at"],
    "findings": ["ai_updated_at", "detected_at"],
    "repositories": ["updated_at", "created_at"],
}
STALE = "Background job stopped reporting progress for {age}s (backend crash or restart); start it again"
RESTART = "Interrupted by a backend restart; start it again"


def heartbeat_timeout(configured: Column, container_limit: Column, model_limit: Column, retries: Column) -> Column:
    """Never below the longest single step."""
    return F.greatest(configured, container_limit + 120, model_limit * (retries + 1) + 60)


def in_progress_jobs(tables: dict[str, DataFrame], ids: dict[str, str]) -> DataFrame:
    """(kind, job_id, status, last_signal) of every in-progress row of the five job tables."""
    rows = None
    for kind, frame in tables.items():
        signals = [F.col(c).cast("timestamp") for c in LAST_SIGNAL[kind] if c in frame.columns]
        status = "ai_status" if kind == "findings" else "status"
        part = frame.filter(F.col(status).isin(*IN_PROGRESS[kind])).select(
            F.lit(kind).alias("kind"), F.col(ids[kind]).cast("bigint").alias("job_id"), F.col(status).alias("status"), F.coalesce(*signals).alias("last_signal")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def stale_jobs(jobs: DataFrame, now: str, timeout_s: int, everything: bool = False) -> DataFrame:
    """In-progress jobs whose last signal is older than the timeout; one that never signalled is stale.

    ``now`` is a literal, so a run can be repeated. ``everything`` is the restart mode: all of them are dead.
    """
    moment = F.lit(now).cast("timestamp")
    age = F.when(F.col("last_signal").isNotNull(), F.unix_timestamp(moment) - F.unix_timestamp("last_signal")).otherwise(F.lit(-1))
    rows = jobs.withColumn("age_s", age.cast("bigint"))
    if everything:
        return rows
    return rows.filter(F.col("last_signal").isNull() | (F.col("age_s") > timeout_s))


def expire_message(age: Column, everything: bool = False) -> Column:
    if everything:
        return F.lit(RESTART)
    head, tail = STALE.split("{age}")
    return F.concat(F.lit(head), age.cast("string"), F.lit(tail))


def expire_stages(stages: Column) -> Column:
    """Stage map of a dead job: what ran has failed, what waited is skipped."""
    return F.transform_values(stages, lambda _, v: F.when(v == "RUNNING", "FAILED").when(v == "PENDING", "SKIPPED").otherwise(v))


def expire_jobs(table: DataFrame, stale: DataFrame, key: str, everything: bool = False) -> DataFrame:
    """The job table with its stale rows failed: status, error text with the age, and the stage map rewritten."""
    dead = stale.select(F.col("job_id").alias(key), "age_s", F.lit(True).alias("_dead"))
    rows = table.join(dead, key, "left")
    hit = F.coalesce("_dead", F.lit(False))
    changes = {
        "status": F.when(hit, "FAILED").otherwise(F.col("status")),
        "error_message": F.when(hit, expire_message(F.col("age_s"), everything)).otherwise(
            F.col("error_message") if "error_message" in table.columns else F.lit(None).cast("string")
        ),
    }
    if "stages" in table.columns:
        changes["stages"] = F.when(hit, expire_stages(F.col("stages"))).otherwise(F.col("stages"))
    return rows.withColumns(changes).drop("_dead", "age_s")


def expire_parents(remediations: DataFrame, failed_validations: DataFrame) -> DataFrame:
    """Remediations still VALIDATING whose validation died become VALIDATION_FAILED."""
    dead = failed_validations.select("remediation_id").distinct().withColumn("_dead", F.lit(True))
    rows = remediations.join(dead, "remediation_id", "left")
    hit = F.coalesce("_dead", F.lit(False)) & (F.col("status") == "VALIDATING")
    return rows.withColumn("status", F.when(hit, "VALIDATION_FAILED").otherwise(F.col("status"))).drop("_dead")


def sweep_counts(stale: DataFrame) -> DataFrame:
    """Expired jobs per kind."""
    return stale.groupBy("kind").agg(F.count("*").alias("expired"))


def stage_state(events: DataFrame) -> DataFrame:
    """Stage map of each job, the latest status of a stage wins; reduced map-side per (job, stage) first."""
    latest = events.groupBy("job_id", "stage").agg(F.max_by("status", F.struct("seen_at", "event_id")).alias("status"))
    return latest.groupBy("job_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "status")))).alias("stages")
    )


def merge_summary(stored: Column, extra: Column) -> Column:
    """Summary maps united, later keys win."""
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(extra, k)), extra)


def duration_windows(analyses: DataFrame, window: str = "1 day") -> DataFrame:
    """Durations (started_at, duration_s) per tumbling window of the start."""
    start = F.col("started_at").cast("timestamp")
    return (
        analyses.filter("duration_s IS NOT NULL")
        .groupBy(F.window(start, window).alias("w"))
        .agg(
            F.count("*").alias("analyses"),
            F.avg("duration_s").alias("mean_s"),
            F.max("duration_s").alias("longest_s"),
            F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_s)").cast(analyses.schema["duration_s"].dataType).alias("median_s"),
        )
        .select(F.col("w.start").alias("window_start"), "analyses", "mean_s", "longest_s", "median_s")
    )
