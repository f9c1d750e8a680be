"""Steps that queries of one snapshot share: stored once, and without shuffles that carry what they need not."""

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import all_queries
from fleetlens.operators import ranks as R
from fleetlens.plans import fleet
from fleetlens.skew import salted_join


@pytest.fixture
def snapshot(spark, tmp_path):
    """Two analyses of one repository; the newer one has two packages, the first of them in two versions."""
    d = str(tmp_path)
    spark.range(1).selectExpr("7L AS c_custkey", "'r7' AS c_name", "0 AS c_nationkey").write.parquet(f"{d}/customer.parquet")
    orders = spark.createDataFrame([(1, 7), (2, 7)], "o_orderkey long, o_custkey long")
    orders.selectExpr("*", "DATE'2024-01-01' AS o_orderdate", "'F' AS o_orderstatus").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(8, 1), (16, 1), (24, 1)], "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    lines = [(1, 24, 1), (2, 8, 1), (2, 8, 2), (2, 16, 3)]
    lines = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int")
    rest = "1L AS l_suppkey, 2D AS l_quantity, 0.03D AS l_discount, 0.01D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus"
    lines.selectExpr("*", *rest.split(", ")).write.parquet(f"{d}/lineitem.parquet")
    return d


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_graph_starts_from_stored_rows_of_the_newest_analyses(spark, snapshot):
    edges = all_queries()["build_edges"](spark, snapshot)
    own = fleet.run(spark, snapshot)
    read = [f.split(f"{own.folder.removeprefix('file:')}/")[-1].split("/")[0] for f in edges.inputFiles() if own.folder.removeprefix("file:") in f]
    assert {"graph_deps", "graph_relations"} <= set(read)
    assert not any("lineitem" in f for f in edges.inputFiles())
    assert {r[0] for r in own.table("graph_lines").select("l_orderkey").collect()} == {2}
    got = sorted((r.src, r.dst) for r in edges.filter("type IN ('USES', 'DEPENDS_ON') AND src NOT LIKE 'Component%'").collect())
    first, second = "Dependency:7:PyPI:lib-core-1@1.2.3", "Dependency:7:PyPI:lib-core-2@3.2.3"
    other = "Dependency:7:PyPI:lib-core-1@2.2.3"
    assert got == sorted([("Repository:7", first), ("Repository:7", other), ("Repository:7", second), (first, second), (other, second)])


def test_changed_analyses_are_another_run(spark, snapshot):
    before = fleet.run(spark, snapshot)
    assert fleet.run(spark, snapshot) is before
    orders = spark.createDataFrame([(3, 7)], "o_orderkey long, o_custkey long")
    orders.selectExpr("*", "DATE'2024-01-02' AS o_orderdate", "'F' AS o_orderstatus").write.mode("append").parquet(f"{snapshot}/orders.parquet")
    assert fleet.run(spark, snapshot) is not before


def test_floors_and_candidates_are_stored_once(spark, snapshot):
    own = fleet.run(spark, snapshot)
    for name in ("minimum_fixed_version", "snap_to_release", "next_fixed_version", "deterministic_recommendation"):
        plan = all_queries()[name](spark, snapshot)
        assert not any(f"{own.folder.removeprefix('file:')}/hits/" in f for f in plan.inputFiles()), name
    assert {"floors", "candidates", "candidate_hits"} <= set(own.tables)


def test_spans_of_an_issue_meet_a_version_once(spark):
    spans = [("npm", "p", "A", 0, 5, 9), ("npm", "p", "A", 3, 7, 9), ("npm", "p", "A", 8, 9, 9), ("npm", "p", "B", 4, 6, 9)]
    spans = spark.createDataFrame(spans, "ecosystem string, norm_name string, identifier string, lo long, hi long, n_ranks long")
    rows = spark.range(9).selectExpr("'npm' AS ecosystem", "'p' AS norm_name", "id AS rank", "9L AS n_ranks")
    got = R.covering(rows, R.union_spans(spans, ("identifier",)), ["identifier"]).collect()
    assert sorted((r.identifier, r["rank"]) for r in got) == [("A", k) for k in (0, 1, 2, 3, 4, 5, 6, 8)] + [("B", 4), ("B", 5)]


def test_join_without_hot_keys_is_plain(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10)], "k string, w int")
    got = salted_join(left, right, ["k"], right.select("k").filter(F.lit(False)), "left")
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [("a", 1, 10), ("b", 2, None), (None, 3, None)]
    assert "_salt" not in _plan(got) and got.columns == ["k", "v", "w"]
