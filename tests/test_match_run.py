"""The stored matching run: built once per snapshot, read by every query of it."""

import os
import shutil

import pytest

from fleetlens.catalog import all_queries
from fleetlens.plans import fleet

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def test_queries_read_the_stored_run(spark):
    """No query of findings plans the matching again: what it scans are the run's tables, each at most twice."""
    own = fleet.run(spark, SF)
    for name in ("create_findings", "classify_dependencies", "check_summary", "provisional_risk"):
        plan = all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "lineitem" not in plan and "RepartitionByExpression" not in plan
        inputs = all_queries()[name](spark, SF).inputFiles()
        assert inputs and all(own.folder.removeprefix("file:") in f for f in inputs)
    assert fleet.run(spark, SF) is own and {"index", "hits", "spans"} <= set(os.listdir(own.folder.removeprefix("file:")))


def test_another_snapshot_is_another_run(spark, tmp_path):
    for table in ("lineitem", "part"):
        shutil.copy(f"{SF}/{table}.parquet", tmp_path / f"{table}.parquet")
    first = fleet.run(spark, str(tmp_path))
    assert fleet.run(spark, str(tmp_path)) is first
    os.utime(tmp_path / "part.parquet", (1, 1))
    assert fleet.run(spark, str(tmp_path)) is not first
