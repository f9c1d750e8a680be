"""Queries that use one result twice store it, instead of working it out twice."""

from __future__ import annotations

from test_run_tables import snapshot  # noqa: F401

from fleetlens.catalog import all_queries


def test_details_read_stored_dependencies_and_edges(spark, snapshot):  # noqa: F811
    rows = all_queries()["dependency_detail"](spark, snapshot)
    assert not [f for f in rows.inputFiles() if "/lineitem" in f]
    got = {(r.analysis_id, r.dependency_id): r.findings for r in rows.collect()}
    assert len(got) == 4 and sum(got.values()) > 0


def test_ranked_findings_are_made_once(spark, snapshot):  # noqa: F811
    rows = all_queries()["top_findings_per_analysis"](spark, snapshot)
    assert not [f for f in rows.inputFiles() if "/hits/" in f]
    got = [(r.analysis_id, r.identifier, r.finding_id, r.selected) for r in rows.collect()]
    assert got and len(set(got)) == len(got) and all(r[3] for r in got)
