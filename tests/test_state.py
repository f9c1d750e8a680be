"""Committed bucket tables, and the match that deltas keep up to date."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import matching as M
from fleetlens.operators.advisories import with_range_keys
from fleetlens.operators.state import RANGES, MatchState
from fleetlens.sources.tables import BucketTable

IDENTITY = ["analysis_id", *M.LOOKUP, "source_file"]
DEPS = "analysis_id long, ecosystem string, norm_name string, version string, source_file string, scope string"


def test_a_batch_without_its_commit_does_not_exist(spark, tmp_path, monkeypatch):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], 4)
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k long, v string")
    assert table.read() is None and table.read(schema=rows.schema).count() == 0
    assert table.append(rows, "a") and not table.append(rows, "a")
    monkeypatch.setattr(BucketTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.append(rows.withColumn("v", F.lit("half done")), "b")
    assert (tmp_path / "t/data/batch=b").exists() and table.read().count() == 20 and table.read().filter("v = 'half done'").isEmpty()
    monkeypatch.undo()
    assert table.append(rows.withColumn("v", F.lit("b")), "b") and table.read().count() == 40
    touched = table.touched(rows.filter("k = 3"))
    inside = table.bucket().isin(touched)
    assert table.replace(rows.filter(inside).withColumn("v", F.lit("c")), "c", touched)
    got = {(r.k, r.v) for r in table.read().collect()}
    hidden = {r.k for r in rows.filter(inside).collect()}
    assert got == {(k, v) for k in range(20) for v in (["c"] if k in hidden else [f"v{k}", "b"])}
    assert table.replace(rows.limit(0), "d", touched) and table.read(touched) is None
    before = sorted(map(tuple, table.read().collect()))
    assert table.compact("e", most=1) and sorted(map(tuple, table.read().collect())) == before and max(b for b, _ in table.live()) == "e"


def full(spark, deps, ranges):
    """Statuses of a whole recomputation."""
    lookups = M.distinct_lookups(deps)
    rows = M.classify_dependencies(deps, M.lookup_status(lookups, M.advisory_match(lookups, with_range_keys(ranges))))
    return sorted((tuple(r) for r in rows.select(*IDENTITY, "vulnerability_status", "status_reason").collect()), key=repr)


def stored(state):
    return sorted((tuple(r) for r in state.dependencies.read().select(*IDENTITY, "vulnerability_status", "status_reason").collect()), key=repr)


def test_deltas_give_what_a_full_run_gives(spark, tmp_path):
    def deps(analysis, versions):
        return spark.createDataFrame([(analysis, "npm", f"p{k}", v, "f", "dev") for k in range(12) for v in versions], DEPS)

    def entries(rows):
        return spark.createDataFrame([(i, "npm", p, *r) for i, p, *r in rows], RANGES)

    state = MatchState(spark, str(tmp_path / "s"), IDENTITY, buckets=8)
    first, second = deps(1, ["1.0.0", "2.0.0", None, "junk"]), deps(2, ["1.0.0", "3.0.0"])
    old = [(f"A{k}", f"p{k}", "SEMVER", "0", "1.5.0", None) for k in range(6)] + [("B", "p0", "SEMVER", "0", None, None)]
    state.advise(entries(old), "adv-0", F.lit("2024-01-01"))
    state.arrive(first, "dep-0", F.lit("2024-01-02"))
    assert stored(state) == full(spark, first, entries(old))
    # added, changed and retracted at once; p2 and its like are not named
    new = [("A0", "p0", "SEMVER", "0", "2.5.0", None), ("C", "p9", "SEMVER", "2.0.0", None, None), ("B", "p0", None, None, None, None), ("A1", "p1", None, None, None, None)]
    whole = [r for r in old if r[0] not in ("A0", "B", "A1")] + new[:2]
    untouched = set(range(8)) - set(state.ranges.touched(entries(new)))
    seen = []
    read = BucketTable.read

    def spy(self, buckets=None, schema=None):
        out = read(self, buckets, schema)
        seen.extend(out.inputFiles() if out is not None else [])
        return out

    BucketTable.read = spy
    try:
        state.advise(entries(new), "adv-1", F.lit("2024-02-01"))
    finally:
        BucketTable.read = read
    assert untouched and seen and not any(f"bucket={k}/" in f for f in seen for k in untouched)
    assert stored(state) == full(spark, first, entries(whole))
    times = {r.norm_name: str(r.checked_at)[:10] for r in state.dependencies.read().collect()}
    assert times["p0"] == times["p9"] == "2024-02-01" and times["p2"] == "2024-01-02"
    changes = sorted((r.norm_name, r.version, r.vulnerability_status, r.sign) for r in state.changes.read().filter("norm_name IN ('p9', 'p1') AND version IS NOT NULL").collect() if r.version != "junk")
    assert changes == sorted([("p1", "1.0.0", "VULNERABLE", 1), ("p1", "2.0.0", "SAFE", 1), ("p9", "1.0.0", "SAFE", 1), ("p9", "2.0.0", "SAFE", 1), ("p1", "1.0.0", "VULNERABLE", -1), ("p1", "1.0.0", "SAFE", 1), ("p9", "2.0.0", "SAFE", -1), ("p9", "2.0.0", "VULNERABLE", 1)])
    # a second analysis, the first one delivered again, and the delta delivered again
    state.arrive(second, "dep-1", F.lit("2024-02-02"))
    state.arrive(first, "dep-0", F.lit("2024-03-01"))
    state.advise(entries(new), "adv-1", F.lit("2024-03-01"))
    assert stored(state) == full(spark, first.unionByName(second), entries(whole))


def test_rows_without_values_arrive_again_under_other_intervals(spark, tmp_path):
    """Identities with nulls are one row each, and what changes is read off that row: no join by identity, no grouping of verdicts."""
    state = MatchState(spark, str(tmp_path / "s"), IDENTITY, buckets=4, canonical=spark.createDataFrame([("A", "A"), ("B", "A")], "identifier string, canonical string"))
    rows = [(1, "npm", "p", "1.0.0", None, None), (1, "npm", "p", "1.0.0", None, "dev"), (None, "npm", None, None, "f", "dev"), (2, "npm", "q", "5.0.0", "f", "dev"), (2, "npm", "q", "5.0.0", "f", "dev")]
    deps = spark.createDataFrame(rows, DEPS)
    state.arrive(deps, "dep-0", F.lit("2024-01-01"))
    assert state.dependencies.read().count() == 3 and state.changes.read().count() == 3
    state.ranges.append(spark.createDataFrame([(i, "npm", "p", "SEMVER", "0", "2.0.0", None) for i in "AB"], RANGES), "unseen")
    state.arrive(deps, "dep-1", F.lit("2024-01-02"))
    got = {r.norm_name: r for r in state.dependencies.read().collect()}
    assert len(got) == 3 and got["p"].status_reason == "1 known vulnerability (A)" and got["p"].scope is None and str(got[None].checked_at)[:10] == "2024-01-02"
    second = state.changes.read().groupBy("norm_name", "vulnerability_status").agg(F.sum("sign").alias("n")).filter("n <> 0")
    assert {(r.norm_name, r.vulnerability_status, r.n) for r in second.collect()} == {("p", "VULNERABLE", 1), ("q", "SAFE", 1), (None, "UNKNOWN", 1)}
    judged = spark.createDataFrame([], "ecosystem string, norm_name string, version string, analysis_id long, source_file string, vulnerability_status string, status_reason string, _was_vulnerability_status string, _was_status_reason string, _had boolean")
    assert "Exchange" not in state._changes(judged)._jdf.queryExecution().executedPlan().toString()


def test_a_delta_that_failed_half_way_is_finished_by_its_next_delivery(spark, tmp_path, monkeypatch):
    state = MatchState(spark, str(tmp_path / "s"), IDENTITY, buckets=4)
    deps = spark.createDataFrame([(1, "npm", "p", "1.0.0", "f", "dev")], DEPS)
    state.arrive(deps, "dep-0", F.lit("2024-01-01"))
    delta = spark.createDataFrame([("A", "npm", "p", "SEMVER", "0", "2.0.0", None)], RANGES)
    monkeypatch.setattr(state.dependencies, "replace", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        state.advise(delta, "adv-0", F.lit("2024-01-02"))
    assert stored(state)[0][-2] == "SAFE"
    monkeypatch.undo()
    state.advise(delta, "adv-0", F.lit("2024-01-03"))
    assert stored(state)[0][-2] == "VULNERABLE"
    assert [(r.vulnerability_status, r.sign) for r in state.changes.read().orderBy("sign", "vulnerability_status").collect()] == [("SAFE", -1), ("SAFE", 1), ("VULNERABLE", 1)]
    assert os.listdir(tmp_path / "s/dependencies/data") and state.dependencies.read().count() == 1
