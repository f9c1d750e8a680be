"""Joins are planned from measured sizes, not from those of files."""

from __future__ import annotations

import pytest

from fleetlens.catalog.base import Group
from fleetlens.session import cut_lineage, join_by_measured_size

LIMITS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


@pytest.fixture
def limits(spark):
    """A session with Spark's own limits, put back afterwards."""
    before = [spark.conf.get(k, None) for k in LIMITS]
    spark.conf.set(LIMITS[0], "10485760b")
    spark.conf.unset(LIMITS[1])
    yield LIMITS
    for key, value in zip(LIMITS, before):
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _joined(spark):
    # 400,000 equal long texts are a file of a few kB
    wide = cut_lineage(spark.range(400_000, numPartitions=2).selectExpr("id % 4 AS k", "repeat('x', 200) AS text"))
    return spark.range(20_000_000).withColumnRenamed("id", "k").join(wide, "k")


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_small_file_of_many_rows_is_not_broadcast(spark, limits):
    group = Group()

    @group.query("joined")
    def joined(session, d):
        return _joined(session)

    assert "BroadcastHashJoin" in _plan(_joined(spark))  # what the size of the file would do
    rows = group.queries["joined"](spark, "")
    assert "BroadcastHashJoin" not in _plan(rows)
    assert rows.count() == 400_000


def test_limits_of_the_session_stay(spark, limits):
    join_by_measured_size(spark)
    assert [spark.conf.get(k) for k in limits] == ["-1", "10485760b"]
    join_by_measured_size(spark)
    assert [spark.conf.get(k) for k in limits] == ["-1", "10485760b"]
    spark.conf.set(limits[0], "1024")
    spark.conf.set(limits[1], "2048")
    join_by_measured_size(spark)
    assert [spark.conf.get(k) for k in limits] == ["-1", "2048"]
    spark.conf.set(limits[0], "1024")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    join_by_measured_size(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.conf.get(limits[0]) == "1024"
