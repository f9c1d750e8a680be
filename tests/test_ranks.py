"""Ranked versions and covered ranks against plain comparison."""

import random

import pytest

from fleetlens.operators import ranks as R
from fleetlens.operators.advisories import with_range_keys
from fleetlens.operators import matching as M
from fleetlens.skew import rank_in_key

RANGES = "ecosystem string, norm_name string, identifier string, range_type string, introduced string, fixed string, last_affected string"


def test_nodes_of_spans(spark):
    """Every span is its nodes: each rank inside meets exactly one of them, none outside does."""
    spans = [("npm", f"p{n}", lo, hi, n) for n in (1, 2, 15, 16, 17, 70, 300) for lo in range(0, n, max(1, n // 9)) for hi in range(lo + 1, n + 1, max(1, n // 9))]
    df = spark.createDataFrame(spans, "ecosystem string, norm_name string, lo long, hi long, n_ranks long")
    asked = [("npm", f"p{n}", r, n) for n in (1, 2, 15, 16, 17, 70, 300) for r in range(n)]
    rows = spark.createDataFrame(asked, "ecosystem string, norm_name string, rank long, n_ranks long")
    got = sorted((r.norm_name, r["rank"], r.lo, r.hi) for r in R.covering(rows, df, ["lo", "hi"]).collect())
    assert got == sorted((p, r, lo, hi) for _, p, r, _ in asked for _, q, lo, hi, _ in spans if p == q and lo <= r < hi)
    per_level = R.span_nodes(df).groupBy("norm_name", "lo", "hi", "level").count()
    assert per_level.agg({"count": "max"}).first()[0] <= 30


def test_union_of_spans(spark):
    r = random.Random(2)
    spans = [("npm", f"p{k % 5}", lo, lo + r.randint(1, 6), 60) for k in range(60) for lo in [r.randint(0, 50)]]
    df = spark.createDataFrame(spans, "ecosystem string, norm_name string, lo long, hi long, n_ranks long")
    got = [(x.norm_name, k) for x in R.union_spans(df).collect() for k in range(x.lo, x.hi)]
    assert len(got) == len(set(got)) and set(got) == {(p, k) for _, p, lo, hi, _ in spans for k in range(lo, hi)}
    ends = sorted((x.norm_name, x.lo, x.hi) for x in R.union_spans(df).collect())
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(ends, ends[1:]))


def test_index_ranks_each_package_apart(spark):
    rows = [("npm", "a", "1.0.0"), ("npm", "a", "1.0.0-rc.1"), ("npm", "a", "v2"), ("npm", "a", "bad"), ("npm", "a", None), ("PyPI", "a", "1.0"), ("PyPI", "a", "1.0.0"), ("PyPI", "a", "0.9")]
    df = spark.createDataFrame(rows, "ecosystem string, norm_name string, version string")
    got = {(x.ecosystem, x.version): (x["rank"], x.n_ranks, x.is_prerelease) for x in R.version_index(df, df).collect()}
    assert {k: v for k, v in got.items() if k[0] == "PyPI"} == {("PyPI", "0.9"): (0, 2, False), ("PyPI", "1.0"): (1, 2, False), ("PyPI", "1.0.0"): (1, 2, False)}
    assert got["npm", "1.0.0-rc.1"][0] == 0 and got["npm", "1.0.0-rc.1"][2] and got["npm", "1.0.0"][0] == 1 and ("npm", "bad") not in got


def test_ranks_of_large_keys_are_those_of_one_window(spark):
    rows = [("a" if k % 3 else "b", f"{(k * 7919) % 400:03d}", k) for k in range(1200)] + [("c", "x", 0)]
    df = spark.createDataFrame(rows, "k string, v string, n int").repartition(6)
    want = sorted(tuple(r) for r in rank_in_key(df, ["k"], "v", "rank", "total").collect())
    assert sorted(tuple(r) for r in rank_in_key(df, ["k"], "v", "rank", "total", by_one=50).collect()) == want
    order = {k: sorted({v for x, v, _ in rows if x == k}) for k in "abc"}
    assert want == sorted((k, v, n, order[k].index(v), len(order[k])) for k, v, n in rows)


@pytest.mark.parametrize("hot", [False, True])
def test_match_is_plain_comparison(spark, hot):
    """With ``hot`` one package has half of all versions and intervals; listed versions count by their spelling."""
    r = random.Random(7)
    names = [f"p{k}" for k in range(12)]

    def name():
        return "p0" if hot and r.random() < 0.5 else r.choice(names)

    def version():
        return f"{r.randint(0, 5)}.{r.randint(0, 40)}.{r.randint(0, 3)}"

    lookups = sorted({("npm", name(), version()) for _ in range(3000)})
    kinds = [("0", None, None), (None, version(), None), (None, None, version()), ("bad", None, None), ("1.0.0", "bad", None), ("1.0.0", None, "bad"), (None, None, None), ("3.0.0", "2.0.0", None)]
    ranges = [("npm", name(), f"A{k}", "GIT" if k % 50 == 7 else "SEMVER", *(r.choice(kinds) if k % 10 == 0 else (version(), version(), version() if k % 3 else None))) for k in range(300)]
    ranges += [("npm", "unknown", "B", "SEMVER", "0", None, None), ("npm", "p1", "A1", "SEMVER", "0", "1.0.0", None)]
    listed = [("npm", "p0", "L1", [lookups[0][2], "9.9.9"]), ("npm", lookups[-1][1], "A3", [lookups[-1][2], "v" + lookups[-1][2]])]

    def key(v):
        parts = (v or "").split(".")
        return tuple(map(int, parts)) if len(parts) == 3 else None

    def covers(v, row):
        _, _, _, kind, low, fixed, last = row
        if kind == "GIT" or (low not in (None, "0") and key(low) is None) or (fixed is not None and key(fixed) is None) or (fixed is None and last is not None and key(last) is None):
            return False
        return (low in (None, "0") or key(v) >= key(low)) and (key(v) < key(fixed) if fixed is not None else last is None or key(v) <= key(last))

    want = {(e, n, v, row[2]) for e, n, v in lookups for row in ranges if row[1] == n and covers(v, row)}
    want |= {(e, n, v, row[2]) for e, n, v in lookups for row in listed if row[1] == n and v in row[3]}
    df = spark.createDataFrame(lookups, "ecosystem string, norm_name string, version string")
    asked = M.distinct_lookups(df)
    got = M.advisory_match(asked, with_range_keys(spark.createDataFrame(ranges, RANGES)), spark.createDataFrame(listed, "ecosystem string, norm_name string, identifier string, versions array<string>"))
    rows = [tuple(x) for x in got.select("ecosystem", "norm_name", "version", "identifier").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
