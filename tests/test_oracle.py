"""Registered queries next to their SQL check at the smallest scale.

``FLEETLENS_ALL=1`` runs every query (about a quarter of an hour); the default is a cross-section of all groups.
"""

import os

import pytest
from oracle_check import compare, connect

from fleetlens.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
CROSS_SECTION = [
    "fleet_risk", "normalize_package_name", "pep440_key", "sort_versions", "redact_secrets", "cvss_v3_base_score", "extract_requirements", "extract_manifest_direct",
    "resolve_lock_key", "dependency_identity_dedupe", "merge_group", "drop_unsafe_fixes", "classify_dependencies", "match_python_imports", "match_toml_manifest",
    "map_components", "components", "aggregate_overall_risk", "top_findings_per_analysis", "sync_graph", "choose_version", "rewrite_requirement_pins",
    "extract_npm", "usage_verdict", "final_recommendation", "repository_summary", "duplicate_repositories", "expire_jobs", "stream_heartbeat_watchdog", "register_functions",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(all_queries()) if os.environ.get("FLEETLENS_ALL") else CROSS_SECTION)
def test_query(spark, con, name):
    rows, problem = compare(spark, con, SF, name)
    assert problem is None and rows > 0


def test_every_query_is_checked_by_sql_but_two():
    assert sorted(set(all_queries()) - set(all_oracles())) == ["scan_files", "verify_candidates"]
