"""Steps that are stored: read once from their source, and without shuffle files left behind."""

from __future__ import annotations

import time

from fleetlens.operators.extract_npm import extract_npm
from fleetlens.session import cut_lineage, shuffles_removed

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FILES = [
    (1, "package.json", '{"dependencies": {"a": "^1.0.0"}}'),
    (1, "package-lock.json", '{"packages": {"": {}, "node_modules/a": {"version": "1.2.0", "dependencies": {"b": "*"}}, "node_modules/b": {"version": "2.0.0"}}}'),
    (2, "yarn.lock", "# v1"),
]


def test_npm_files_are_read_from_their_source_once(spark, tmp_path):
    source = f"{tmp_path}/files"
    spark.createDataFrame(FILES, "repository_id long, path string, content string").write.parquet(source)
    deps, relations, warnings = extract_npm(spark.read.parquet(source))
    for frame in (deps, relations, warnings):
        assert not [f for f in frame.inputFiles() if source in f]
    assert sorted((r.package_name, r.version, r.scope) for r in deps.collect()) == [("a", "1.2.0", "direct"), ("b", "2.0.0", "transitive")]
    assert [(r.parent_name, r.child_name) for r in relations.collect()] == [("a", "b")]
    assert [r.repository_id for r in warnings.collect()] == [2]


def test_a_stored_step_leaves_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {b.name() for b in [blocks.getAllBlocks().apply(i) for i in range(blocks.getAllBlocks().size())] if b.name().startswith("shuffle_")}
    before = shuffles()
    stored = cut_lineage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert stored.count() == 7


def test_the_setting_is_as_it_was_behind_a_stored_step(spark):
    was = spark.conf.get(CLEANUP)
    with shuffles_removed(spark):
        assert spark.conf.get(CLEANUP) == "true"
    assert spark.conf.get(CLEANUP) == was
