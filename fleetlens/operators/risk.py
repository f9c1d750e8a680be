"""Risk levels, priorities and judgements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scores as S
from fleetlens.functions.versions import bind
from fleetlens.skew import top_per_key


def level_of_rank(rank: Column) -> Column:
    """Inverse of the aggregate order, null for null."""
    return S.lookup({n: level for level, n in S.RISK_RANK.items()}, rank)


def floor_risk_level(judged: Column, provisional: Column) -> Column:
    """A judgement raises the severity level or leaves it; UNKNOWN keeps it."""
    levels = F.struct(S.normalise_risk_level(judged).alias("j"), S.normalise_risk_level(provisional).alias("p"))
    return bind(levels, lambda x: _floor(x["j"], x["p"]))


def _floor(j: Column, p: Column) -> Column:
    """The floor of two levels that are already normalised."""
    lower = S.lookup(S.RISK_RANK, j) < S.lookup(S.RISK_RANK, p)
    return F.when((j == "UNKNOWN") | lower, p).otherwise(j)


def effective_risk_level(stored: Column, severity: Column) -> Column:
    """The stored level, floored by the severity on read."""
    levels = F.struct(S.normalise_risk_level(stored).alias("j"), S.normalise_severity(severity).alias("p"))
    # a missing stored level normalises to UNKNOWN, which keeps the severity level
    return bind(levels, lambda x: _floor(x["j"], x["p"]))


def aggregate_overall_risk(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Highest effective risk per analysis; without findings NONE, or UNKNOWN when the check was incomplete.

    ``analyses`` carries ``check_complete``; ``findings`` carries risk_level and severity.
    """
    rank = S.lookup(S.RISK_RANK, effective_risk_level(F.col("risk_level"), F.col("severity")))
    worst = findings.groupBy("analysis_id").agg(F.max(rank).alias("_worst"))
    fallback = F.when(F.col("check_complete"), "NONE").otherwise("UNKNOWN")
    return (
        analyses.join(worst, "analysis_id", "left")
        .withColumn("overall_risk", F.coalesce(level_of_rank(F.col("_worst")), fallback))
        .drop("_worst")
    )


def priority_order(tie: str = "finding_id") -> list[Column]:
    """I4: severity, then score (missing last), then identifier and id."""
    return [
        S.severity_rank(F.col("severity")).desc(),
        F.col("cvss_score").desc_nulls_last(),
        F.coalesce("identifier", F.lit("")).asc(),
        F.col(tie).asc(),
    ]


def sort_by_priority(findings: DataFrame, tie: str = "finding_id", within: Sequence[str] = ()) -> DataFrame:
    """I4: findings in priority order, all of them or those of each key of ``within``.

    The reference sorts the findings of one analysis. With keys there is one shuffle and one sort, which a window over the same
    keys and order takes over; a whole order asks for its bounds first, so the findings are computed twice.
    """
    if not within:
        return findings.orderBy(*priority_order(tie))
    return findings.repartition(*within).sortWithinPartitions(*within, *priority_order(tie))


def top_findings_per_analysis(findings: DataFrame, n: int, tie: str = "finding_id") -> DataFrame:
    """Every finding with ``selected``; the first n of an analysis are selected, the rest carry the reason.

    Only n keys per input partition are ranked and shuffled; the mark is joined back by the finding's key.
    """
    slim = findings.select("analysis_id", tie, "severity", "cvss_score", "identifier")
    chosen = top_per_key(slim, ["analysis_id"], priority_order(tie), n, "position").select(
        "analysis_id", tie, "identifier", "position"
    )
    reason = F.lit(f"Skipped: analysis limit ({n}) reached — run on demand")
    rows = findings.join(chosen, ["analysis_id", tie, "identifier"], "left")
    return rows.withColumns(
        {"selected": F.col("position").isNotNull(), "skip_reason": F.when(F.col("position").isNull(), reason)}
    )


def apply_judgements(findings: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Stored levels after a judgement: impact NONE becomes UNKNOWN, risk never drops below the severity.

    ``verdicts`` carries judged_impact and judged_risk. A finding without a verdict is unchanged.
    """
    rows = findings.join(verdicts, keys, "left")
    levels = bind(
        F.struct(S.normalise_risk_level(F.col("judged_risk")).alias("j"), S.normalise_severity(F.col("severity")).alias("p")),
        lambda x: F.struct(x["j"].alias("judged"), _floor(x["j"], x["p"]).alias("stored")),
    )
    rows = rows.withColumn("_levels", levels)
    judged, stored = F.col("_levels.judged"), F.col("_levels.stored")
    real = F.col("judged_risk").isNotNull() & (judged != "UNKNOWN")
    impact_guard = F.when(
        F.col("judged_impact") == "NONE", F.lit("Impact guard: judged NONE, stored as UNKNOWN")
    )
    risk_guard = F.when(
        real & (stored != judged),
        F.concat(F.lit("Risk floor: judged "), judged, F.lit(", stored as "), stored),
    )
    return rows.withColumns(
        {
            "impact_level": F.when(F.col("judged_impact") == "NONE", "UNKNOWN").otherwise(F.col("judged_impact")),
            "risk_level": F.when(real | (F.col("judged_risk").isNotNull() & F.col("risk_level").isNull()), stored).otherwise(
                F.col("risk_level")
            ),
            "guard_notes": F.concat_ws("; ", impact_guard, risk_guard),
        }
    ).drop("_levels")


def risk_origin(judged: Column, stored: Column) -> Column:
    """Where the shown level comes from."""
    known = judged.isNotNull() & (judged != "UNKNOWN")
    return (
        F.when(known & (stored == judged), "AI")
        .when(known & stored.isNotNull() & (S.risk_rank(judged) < S.risk_rank(stored)), "provisional floor (AI judged lower)")
        .otherwise("provisional (severity-based)")
    )


def risk_view_order(tie: str = "finding_id") -> list[Column]:
    """I8: display order: risk, then severity, then newest; UNKNOWN after NONE."""
    return [S.risk_view_rank(F.col("risk_level")).asc(), S.risk_view_rank(F.col("severity")).asc(), F.col(tie).desc()]


def sort_by_risk_view(findings: DataFrame, tie: str = "finding_id") -> DataFrame:
    return findings.orderBy(*risk_view_order(tie))


def run_counters(findings: DataFrame) -> DataFrame:
    """Judgement counters per analysis and the stage status they give.

    ``ai_status`` is COMPLETED, FAILED, UNAVAILABLE or SKIPPED; only completed and failed ones were attempted.
    """
    status = F.col("ai_status")
    rows = findings.groupBy("analysis_id").agg(
        F.count_if(status.isin("COMPLETED", "FAILED")).alias("attempted"),
        F.count_if(status == "COMPLETED").alias("completed"),
        F.count_if(status == "FAILED").alias("failed"),
        F.count_if(status == "UNAVAILABLE").alias("unavailable"),
        F.count_if(status == "SKIPPED").alias("skipped_by_limit"),
    )
    return rows.withColumn(
        "stage_status",
        F.when((F.col("completed") == 0) & (F.col("unavailable") > 0), "UNAVAILABLE")
        .when((F.col("failed") > 0) | (F.col("unavailable") > 0), "PARTIAL")
        .otherwise("OK"),
    )
