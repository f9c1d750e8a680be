"""Reports: what they join is stored first, and contexts are the same for repeated and missing repositories."""

from __future__ import annotations

from pyspark.sql import Row
from test_run_tables import snapshot  # noqa: F401

from fleetlens.catalog import all_queries
from fleetlens.operators import reports as L


def test_reports_join_three_stored_tables_only(spark, snapshot):  # noqa: F811
    rows = all_queries()["evidence_report"](spark, snapshot)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
    assert "lineitem" not in " ".join(rows.inputFiles()) and "Aggregate" not in plan
    assert sorted({r.title.split(" / ")[0].removeprefix("Evidence report: ") for r in rows.collect()}) == ["lib-core-1 1.2.3", "lib-core-1 2.2.3", "lib-core-3 1.2.3"]


def test_context_of_a_finding_without_package_or_of_a_repeated_repository(spark):
    columns = "finding_id string, analysis_id long, repository_id long, ecosystem string, norm_name string, package_name string, version string, scope string, source_file string, identifier string"
    rows = [("a", 1, 1, "npm", "p", "p", "1", "direct", "f", "X"), ("b", 1, 1, "npm", None, None, "1", "direct", "f", "X"), ("c", 2, None, "npm", "p", "p", "1", "direct", "f", "X"), ("d", 3, 2, "npm", "p", "p", "1", "direct", "f", "X")]
    findings = spark.createDataFrame(rows, columns)
    repositories = spark.createDataFrame([(1, "one", "u", "local"), (2, "two", "u", "local"), (2, "zwei", "u", "local")], "repository_id long, name string, source_url string, source_type string")
    advisories = spark.createDataFrame([("X", "HIGH", 7.5, "about p")], "identifier string, severity string, cvss_score double, description string")
    evidence = spark.createDataFrame(
        [(1, "npm", "p", ["p"], ["src/a.ts"], ["src"], 1, 0, False, 0, True)],
        "repository_id long, ecosystem string, norm_name string, import_names array<string>, files array<string>, components array<string>, total_files int, n_config int, truncated boolean, skipped_files_total int, analysed boolean",
    )
    found = L.finding_context(findings, repositories, advisories, evidence)
    assert not [c for c in found.columns if c.startswith("_")]
    got = sorted((r.finding_id, r.repository and r.repository.name, r.usage and r.usage.total_files) for r in found.collect())
    assert got == [("a", "one", 1), ("b", "one", None), ("c", None, None), ("d", "two", None), ("d", "zwei", None)]
    assert isinstance(found.first().dependency, Row)
