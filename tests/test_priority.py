"""The order of findings within their analyses."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import risk as R


def test_order_within_analyses_takes_one_shuffle_and_one_sort(spark):
    rows = [
        (1, "LOW", 9.0, "A", "x"), (1, "CRITICAL", None, "B", "x"), (1, "CRITICAL", 9.1, "D", "x"), (1, "CRITICAL", 9.1, "C", "z"), (1, "CRITICAL", 9.1, "C", "y"),
        (2, "HIGH", 1.0, None, "x"), (2, None, 2.0, "A", "x"), (2, "HIGH", 1.0, "A", "x"), (None, "LOW", 1.0, "A", "x"), (None, "HIGH", 1.0, "A", "x"),
    ]
    schema = "analysis_id int, severity string, cvss_score double, identifier string, finding_id string"
    place = Window.partitionBy("analysis_id").orderBy(*R.priority_order())
    got = R.sort_by_priority(spark.createDataFrame(rows, schema), within=["analysis_id"]).withColumn("position", F.row_number().over(place))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "rangepartitioning" not in plan
    found = {(r.analysis_id, r.position): (r.identifier, r.finding_id) for r in got.collect()}
    assert found == {
        (1, 1): ("C", "y"), (1, 2): ("C", "z"), (1, 3): ("D", "x"), (1, 4): ("B", "x"), (1, 5): ("A", "x"),
        (2, 1): (None, "x"), (2, 2): ("A", "x"), (2, 3): ("A", "x"), (None, 1): ("A", "x"), (None, 2): ("A", "x"),
    }


def test_query_orders_each_analysis_by_itself(spark):
    from fleetlens.catalog import all_queries

    plan = all_queries()["sort_by_priority"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
