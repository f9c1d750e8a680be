"""Plug-ins that fail at run time: their rows stay whole, their failing files are named."""

from pyspark.sql import functions as F

from fleetlens.operators.extract_python import DEPENDENCY_COLUMNS
from fleetlens.sources import plugins


def test_a_plugin_that_fails_on_one_file_ends_no_job(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([(k, f"d{k}/requirements.txt", "poison" if k == 7 else "flask==1.0") for k in range(12)], "repository_id int, path string, content string")

    def lines(rows):
        """One dependency per file; a poisoned one ends the task."""
        name = F.when(F.col("content") == "poison", F.raise_error(F.lit("cannot read"))).otherwise(F.col("content"))
        known = {"repository_id": F.col("repository_id"), "package_name": name, "source_file": F.col("path"), "line_no": F.lit(0), "dev": F.lit(False)}
        return rows.select(*[known.get(c, F.lit("x")).alias(c) for c in DEPENDENCY_COLUMNS])

    monkeypatch.setitem(plugins.EXTRACTORS, "lines", lines)
    monkeypatch.setitem(plugins.EXTRACTORS, "unplanned", lambda rows: rows.select("no_such_column"))
    rows, rejected = plugins.run_isolated(files, str(tmp_path / "out"), ["lines", "python", "unplanned"], parts=4)
    got = rows.groupBy("extractor").agg(F.countDistinct("repository_id").alias("n"), F.count("*").alias("rows")).collect()
    assert {r.extractor: (r.n, r.rows) for r in got if r.extractor == "lines"} == {"lines": (11, 11)}
    assert {r.extractor for r in got} == {"lines", "python"}
    named = {(r.extractor, r.repository_id) for r in rejected.collect()}
    assert ("lines", 7) in named and len([x for x in named if x[0] == "lines"]) == 1 and len([x for x in named if x[0] == "unplanned"]) == 12


def test_an_unread_requirements_file_is_a_warning(spark):
    from fleetlens.operators.extract_python import extract_python

    files = spark.createDataFrame([(1, "requirements.txt", None), (1, "dev/requirements.txt", "flask==1.0")], "repository_id int, path string, content string")
    deps, warnings = extract_python(files)
    assert deps.count() == 1
    assert [r.message for r in warnings.collect()] == ["requirements.txt: file was not read; what it declares is unknown"]
