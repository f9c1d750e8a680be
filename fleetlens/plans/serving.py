"""Read-side queries (M1-M16): what the dashboard, lists and detail views show, for all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_analysis(analyses: DataFrame, completed_only: bool = False) -> DataFrame:
    """M1: the newest analysis of each repository."""
    rows = analyses.filter("status = 'COMPLETED'") if completed_only else analyses
    return rows.groupBy("repository_id").agg(
        F.max("analysis_id").alias("analysis_id"), F.max_by("status", "analysis_id").alias("status")
    )


def snapshot_analysis(analyses: DataFrame) -> DataFrame:
    """M2: the newest completed analysis, the newest one where none is completed."""
    order = F.struct((F.col("status") == "COMPLETED").alias("done"), F.col("analysis_id"))
    return analyses.groupBy("repository_id").agg(
        F.max_by("analysis_id", order).alias("analysis_id"), F.max_by("status", order).alias("status")
    )


def dependency_counts(snapshots: DataFrame, deps: DataFrame) -> DataFrame:
    """M3: total and vulnerable dependencies of each snapshot, aggregated before the join."""
    per = deps.groupBy("analysis_id").agg(
        F.count("*").alias("dependencies_count"),
        F.count_if(F.col("vulnerability_status") == "VULNERABLE").alias("vulnerable_count"),
    )
    return snapshots.join(per, "analysis_id", "left").fillna(0, ["dependencies_count", "vulnerable_count"])


def analysis_summary(analyses: DataFrame, findings: DataFrame, deps: DataFrame) -> DataFrame:
    """M4: analyses with their finding and dependency counts."""
    f = findings.groupBy("analysis_id").agg(F.count("*").alias("findings_count"))
    d = deps.groupBy("analysis_id").agg(F.count("*").alias("dependencies_count"))
    rows = analyses.join(f, "analysis_id", "left").join(d, "analysis_id", "left")
    return rows.fillna(0, ["findings_count", "dependencies_count"])


def repository_summary(repositories: DataFrame, analyses: DataFrame, deps: DataFrame) -> DataFrame:
    """M5: repositories with their newest analysis and the counts of their snapshot."""
    newest = latest_analysis(analyses).withColumnsRenamed({"analysis_id": "latest_analysis_id", "status": "latest_status"})
    counts = dependency_counts(snapshot_analysis(analyses), deps).select("repository_id", "dependencies_count", "vulnerable_count")
    rows = repositories.join(newest, "repository_id", "left").join(counts, "repository_id", "left")
    return rows.fillna(0, ["dependencies_count", "vulnerable_count"])


def findings_by_risk(findings: DataFrame) -> DataFrame:
    """M6: findings per level, no level counts as UNKNOWN."""
    return findings.groupBy(F.coalesce("risk_level", F.lit("UNKNOWN")).alias("risk_level")).agg(F.count("*").alias("n"))


def dashboard_totals(counts: dict[str, DataFrame], snapshots: DataFrame, deps: DataFrame) -> DataFrame:
    """M7: one row of totals; each table is counted on its own and the one-row counts are pivoted together."""
    parts = [df.groupBy().agg(F.lit(name).alias("metric"), F.count("*").alias("n")) for name, df in counts.items()]
    snap = dependency_counts(snapshots, deps).agg(
        F.coalesce(F.sum("dependencies_count"), F.lit(0)).alias("d"), F.coalesce(F.sum("vulnerable_count"), F.lit(0)).alias("v")
    )
    parts.append(snap.select(F.lit("dependencies").alias("metric"), F.col("d").alias("n")))
    parts.append(snap.select(F.lit("vulnerable_dependencies").alias("metric"), F.col("v").alias("n")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = [*counts, "dependencies", "vulnerable_dependencies"]
    return rows.agg(*[F.max(F.when(F.col("metric") == n, F.col("n"))).alias(n) for n in names])


def recent_analyses(analyses: DataFrame, n: int = 10) -> DataFrame:
    """M8: the newest analyses (a bounded top-k, no full sort)."""
    return analyses.orderBy(F.desc("analysis_id")).limit(n)


def high_risk_findings(findings: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """M9: the newest findings with CRITICAL or HIGH risk."""
    return findings.filter(F.col("risk_level").isin("CRITICAL", "HIGH")).orderBy(*order).limit(n)


def list_findings(
    findings: DataFrame, order: list[Column], analysis_id=None, risk_level: str | None = None, limit: int = 100
) -> DataFrame:
    """Filtered findings, newest first; the filters reach the scan, the limit is a top-k."""
    rows = findings
    if analysis_id is not None:
        rows = rows.filter(F.col("analysis_id") == analysis_id)
    if risk_level:
        rows = rows.filter(F.col("risk_level") == risk_level.upper())
    return rows.orderBy(*order).limit(limit)


def repository_dependencies(analyses: DataFrame, deps: DataFrame, status: str | None = None) -> DataFrame:
    """Dependencies of every repository's snapshot; order by repository_id and ``ecosystem, name, version``."""
    rows = deps if status is None else deps.filter(F.col("vulnerability_status") == status.upper())
    return rows.join(snapshot_analysis(analyses).select("repository_id", "analysis_id"), "analysis_id")


def repository_findings(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of every repository's snapshot."""
    return findings.join(snapshot_analysis(analyses).select("repository_id", "analysis_id"), "analysis_id")


def dependency_detail(deps: DataFrame, findings: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Each dependency with its finding count, distinct advisories and neighbours as ``name@version`` labels.

    ``edges`` is (parent_id, child_id) over ``dependency_id``; counts are aggregated before any join.
    """
    label = F.concat("package_name", F.lit("@"), F.coalesce("version", F.lit("?")))
    labels = deps.select("dependency_id", label.alias("label"))
    out = edges.join(labels.withColumnsRenamed({"dependency_id": "child_id", "label": "l"}), "child_id")
    out = out.groupBy(F.col("parent_id").alias("dependency_id")).agg(F.array_sort(F.collect_set("l")).alias("depends_on"))
    back = edges.join(labels.withColumnsRenamed({"dependency_id": "parent_id", "label": "l"}), "parent_id")
    back = back.groupBy(F.col("child_id").alias("dependency_id")).agg(F.array_sort(F.collect_set("l")).alias("depended_on_by"))
    found = findings.groupBy(*key).agg(F.count("*").alias("findings"), F.array_sort(F.collect_set("identifier")).alias("vulnerabilities"))
    rows = deps.join(found, key, "left").join(out, "dependency_id", "left").join(back, "dependency_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "findings": F.coalesce("findings", F.lit(0)),
            **{c: F.coalesce(c, none) for c in ("vulnerabilities", "depends_on", "depended_on_by")},
        }
    )


def vulnerability_lookup(advisories: DataFrame, identifier: str | None = None, row_id: int | None = None, key: str = "vulnerability_id") -> DataFrame:
    """One advisory by its identifier or by the id of its row; the equality is pushed into the scan."""
    if (identifier is None) == (row_id is None):
        raise ValueError("an advisory is asked by its identifier or by its id")
    return advisories.filter(F.col(key) == row_id if identifier is None else F.col("identifier") == identifier)


def duplicate_repositories(repositories: DataFrame) -> DataFrame:
    """(repository_id, duplicate_of): an earlier registration of the same source.

    Sources are compared case-insensitively. Local ones ignore the branch; of the others a row conflicts with an
    earlier row of the same branch or without a branch, and one without a branch conflicts with any earlier row.
    """
    location = F.lower("source_url")
    rows = repositories.select("repository_id", "source_type", location.alias("location"), "branch")
    by_place = rows.groupBy("source_type", "location").agg(
        F.min("repository_id").alias("first_any"),
        F.min(F.when(F.col("branch").isNull(), F.col("repository_id"))).alias("first_bare"),
    )
    by_branch = rows.filter("branch IS NOT NULL").groupBy("source_type", "location", "branch").agg(
        F.min("repository_id").alias("first_branch")
    )
    joined = rows.join(by_place, ["source_type", "location"]).join(by_branch, ["source_type", "location", "branch"], "left")
    loose = (F.col("source_type") == "local") | F.col("branch").isNull()
    first = F.when(loose, F.col("first_any")).otherwise(
        F.coalesce(F.when(F.col("first_bare") < F.col("repository_id"), F.col("first_bare")), F.col("first_branch"))
    )
    return joined.select("repository_id", first.alias("duplicate_of")).filter("duplicate_of < repository_id")


def cascade_delete(tables: dict[str, tuple[DataFrame, str, str | None]], removed: DataFrame) -> dict[str, DataFrame]:
    """The tables without the removed repositories and every dependent row.

    ``tables`` maps a name to (frame, key that points at its parent, parent name or None for the root key);
    parents come first. The keys of dropped rows flow down as anti-joins.
    """
    kept: dict[str, DataFrame] = {}
    for name, (frame, key, parent) in tables.items():
        if parent is None:
            kept[name] = frame.join(removed.select(key).distinct(), key, "left_anti")
        else:
            kept[name] = frame.join(kept[parent].select(key).distinct(), key, "left_semi")
    return kept
