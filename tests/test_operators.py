"""Operators against hand-made rows and brute force."""

import random

from pyspark.sql import functions as F

from fleetlens.operators import advisories as A
from fleetlens.operators import extract_npm as N
from fleetlens.operators import graph as G
from fleetlens.operators import matching as M
from fleetlens.operators import ranks as RK
from fleetlens.operators import remediate as K
from fleetlens.skew import first_per_key, hot_keys, salted_join, top_per_key


def groups_of(spark, records):
    df = spark.createDataFrame(records, "identifier string, aliases array<string>").repartition(3)
    found = {}
    for row in A.alias_groups(df).collect():
        found.setdefault(row.group_id, set()).add(row.identifier)
    return sorted(sorted(g) for g in found.values())


SIX = [
    ("PYSEC-1", ["CVE-1"]), ("GHSA-1", ["CVE-1", "CVE-2"]), ("OSV-1", ["CVE-2"]), ("GHSA-2", []), ("PYSEC-9", ["CVE-1", "GHSA-9"]), ("GHSA-9", ["CVE-1"]),
]


def test_alias_groups_never_blend_different_cve_sets(spark):
    expected = [["GHSA-1"], ["GHSA-2"], ["GHSA-9", "PYSEC-1", "PYSEC-9"], ["OSV-1"]]
    assert groups_of(spark, SIX) == expected
    shuffled = SIX[:]
    random.Random(3).shuffle(shuffled)
    assert groups_of(spark, shuffled) == expected


def test_alias_chain_without_cve_is_one_group(spark):
    chain = [(f"R-{i:03}", [f"R-{i + 1:03}"]) for i in range(60)]
    assert len(groups_of(spark, chain)) == 1


def test_merge_group_keeps_the_best_data(spark):
    rows = [
        ("PYSEC-1", ["CVE-1"], "HIGH", 8.8, "v1", None),
        ("CVE-1", [], "UNKNOWN", None, None, "cve summary"),
    ]
    df = spark.createDataFrame(rows, "identifier string, aliases array<string>, severity string, cvss_score double, cvss_vector string, summary string")
    df = df.withColumn("published_at", F.lit(None).cast("timestamp"))
    merged = A.merge_group(df, df.select("identifier", F.lit("g").alias("group_id"))).first()
    assert (merged.identifier, merged.aliases, merged.severity, merged.cvss_score, merged.summary) == ("CVE-1", ["PYSEC-1"], "HIGH", 8.8, "cve summary")


def test_fix_inside_another_range_is_dropped(spark):
    ranges = spark.createDataFrame([("g", "PyPI", "demo", "0", "1.1.0"), ("g", "PyPI", "demo", "0", "1.1.1")], "group_id string, ecosystem string, norm_name string, introduced string, fixed string")
    ranges = A.with_range_keys(ranges.withColumn("last_affected", F.lit(None).cast("string")))
    fixes = spark.createDataFrame([("g", "PyPI", "demo", "1.1.0"), ("g", "PyPI", "demo", "1.1.1")], "group_id string, ecosystem string, norm_name string, fixed string")
    left = A.drop_unsafe_fixes(fixes, ranges, ["group_id", "ecosystem", "norm_name"])
    assert [r.fixed for r in left.collect()] == ["1.1.1"]


def test_an_id_only_record_wipes_nothing(spark):
    schema = "identifier string, source string, aliases array<string>, severity string, summary string"
    old = spark.createDataFrame([("GHSA-1", "osv", ["CVE-1"], "HIGH", "known")], schema)
    new = spark.createDataFrame([("GHSA-1", "osv", None, "UNKNOWN", None), ("GHSA-2", "osv", None, "UNKNOWN", None)], schema)
    rows = {r.identifier: r for r in A.upsert_advisories(old, new).collect()}
    assert (rows["GHSA-1"].severity, rows["GHSA-1"].summary, rows["GHSA-1"].aliases) == ("HIGH", "known", ["CVE-1"])
    assert rows["GHSA-2"].severity == "UNKNOWN"


def make_ranges(spark, rows):
    """(identifier, introduced, fixed, last_affected, range_type) of one npm package."""
    df = spark.createDataFrame(rows, "identifier string, introduced string, fixed string, last_affected string, range_type string")
    return A.with_range_keys(df.withColumns({"ecosystem": F.lit("npm"), "norm_name": F.lit("p")}))


def test_matching_rules(spark):
    ranges = make_ranges(
        spark,
        [("A", "0", "1.0.0", None, "SEMVER"), ("B", "1.0.0", None, "1.5.0", "SEMVER"), ("C", "2.0.0", None, None, "SEMVER"), ("G", "0", None, None, "GIT"), ("X", "junk", None, None, "SEMVER"), ("Y", "0", "junk", None, "SEMVER")],
    )
    deps = spark.createDataFrame([("npm", "p", v) for v in ("0.1.0", "1.0.0", "1.5.0", "1.5.1", "3.0.0")], "ecosystem string, package_name string, version string")
    hits = M.advisory_match(M.distinct_lookups(M.with_lookup_key(deps)), ranges)
    assert sorted((r.version, r.identifier) for r in hits.collect()) == [("0.1.0", "A"), ("1.0.0", "B"), ("1.5.0", "B"), ("3.0.0", "C")]


def test_unanswered_and_unpinned_are_never_safe(spark):
    ranges = make_ranges(spark, [("A", "0", "1.0.0", None, "SEMVER")])
    deps = M.with_lookup_key(spark.createDataFrame([("npm", "p", v) for v in ("0.1.0", "2.0.0", "3.0.0", None, "junk")], "ecosystem string, package_name string, version string"))
    lookups = M.distinct_lookups(deps)
    missing = lookups.filter("version = '3.0.0'").select(*M.LOOKUP)
    rows = M.classify_dependencies(deps, M.lookup_status(lookups, M.advisory_match(lookups, ranges), missing))
    got = {r.version: r.vulnerability_status for r in rows.collect()}
    assert got == {"0.1.0": "VULNERABLE", "2.0.0": "SAFE", "3.0.0": "UNKNOWN", None: "UNKNOWN", "junk": "UNKNOWN"}


def brute_verify(start, ranges, releases, rounds=5):
    def key(v):
        return tuple(int(x) for x in v.split("."))

    def affected(v):
        return [r for r in ranges if key(v) >= key(r[1] if r[1] != "0" else "0.0.0") and (r[2] is None or key(v) < key(r[2]))]

    candidate = start
    for _ in range(rounds):
        hit = affected(candidate)
        if not hit:
            return candidate, True
        above = [r[2] for r in hit if r[2] and key(r[2]) > key(candidate)]
        if not above:
            return candidate, False
        floor = max(above, key=key)
        fits = sorted((r for r in releases if key(r) >= key(floor)), key=key)
        candidate = fits[0] if fits else floor
    return candidate, False


RELEASES = "ecosystem string, norm_name string, version string, installable boolean"


def verified(spark, ranges, releases, starts, unanswered=None):
    """``verify_candidates`` of start versions of one npm package, from plain rows."""
    rel = spark.createDataFrame([("npm", "p", r, True) for r in releases], RELEASES)
    df = spark.createDataFrame([("npm", "p", s) for s in starts], "ecosystem string, norm_name string, version string")
    index = RK.version_index(df, rel, RK.bound_versions(ranges))
    df = df.join(index.select(*M.LOOKUP, "rank"), M.LOOKUP).withColumnsRenamed({"version": "snapped", "rank": "snapped_rank"})
    upcoming = K.next_releases(K.installable_releases(rel, index), index)
    return K.verify_candidates(df, RK.rank_spans(ranges, index), K.safe_fixes(ranges, index), upcoming, unanswered)


def test_verify_loop_matches_brute_force(spark):
    rng = random.Random(11)
    for _ in range(3):
        rows = []
        for i in range(7):
            low = rng.randint(0, 9)
            fixed = f"{low + rng.randint(1, 3)}.{rng.randint(0, 3)}.0" if rng.random() < 0.85 else None
            rows.append((f"A{i}", f"{low}.0.0", fixed, None, "SEMVER"))
        releases = [f"{rng.randint(0, 14)}.{rng.randint(0, 3)}.0" for _ in range(9)]
        ranges = make_ranges(spark, rows)
        starts = ["1.0.0", "3.2.0", "6.0.0"]
        got = {r.start: (r.candidate, r.verified) for r in verified(spark, ranges, releases, starts).collect()}
        assert got == {s: brute_verify(s, rows, releases) for s in starts}


def test_paths_match_brute_force(spark):
    edges = [("Repository:1", d, "USES") for d in ("Dependency:a", "Dependency:b", "Dependency:c")]
    edges += [("Repository:1", "Component:src", "CONTAINS"), ("Component:src", "Dependency:a", "USES")]
    edges += [(f"Dependency:{x}", f"Dependency:{y}", "DEPENDS_ON") for x, y in ("ab", "bc", "ca", "ac", "cb")]
    df = spark.createDataFrame([(1, *e) for e in edges], "repository_id int, src string, dst string, type string")

    def walk(target, depth):
        found, frontier = [], [[target]]
        for _ in range(depth):
            frontier = [[s, *p] for p in frontier for s, d, _ in edges if d == p[0] and s not in p]
            found += sorted(p for p in frontier if p[0] == "Repository:1")
        return found

    targets = spark.createDataFrame([(1, f"Dependency:{x}") for x in "abc"], "repository_id int, node_id string")
    for limit in (25, 3):
        rows = G.dependency_paths(df, targets, 4, limit).collect()
        for x in "abc":
            got = sorted(((r.length, r.path) for r in rows if r.node_id == f"Dependency:{x}"))
            assert [p for _, p in got] == walk(f"Dependency:{x}", 4)[:limit]


def test_lock_lookup_climbs_to_the_nearest_ancestor(spark):
    keys = ["node_modules/b", "node_modules/a", "node_modules/a/node_modules/b", "packages/x/node_modules/c"]
    entries = spark.createDataFrame([(1, k) for k in keys], "repository_id int, lock_key string")
    edges = spark.createDataFrame(
        [(1, "node_modules/a", "b"), (1, "node_modules/a/node_modules/b", "a"), (1, "packages/x", "c"), (1, "packages/x", "b"), (1, "packages/y", "c"), (1, "", "b")],
        "repository_id int, base_key string, dependency string",
    )
    got = {(r.base_key, r.dependency): r.child_key for r in N.resolve_lock_key(edges, entries, ["repository_id"]).collect()}
    assert got == {
        ("node_modules/a", "b"): "node_modules/a/node_modules/b", ("node_modules/a/node_modules/b", "a"): "node_modules/a", ("packages/x", "c"): "packages/x/node_modules/c",
        ("packages/x", "b"): "node_modules/b", ("packages/y", "c"): None, ("", "b"): "node_modules/b",
    }


def test_skew_helpers_keep_every_row(spark):
    rows = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "n", 10)
    assert [r.k for r in hot.collect()] == [0]
    plain = rows.join(right, ["k"]).select("k", "v", "w")
    assert salted_join(rows, right, ["k"], hot).select("k", "v", "w").exceptAll(plain).isEmpty()
    assert salted_join(rows, right, ["k"], hot).count() == plain.count()
    top = top_per_key(rows, ["k"], [F.col("v").desc()], 1500)
    expected = rows.groupBy("k").agg(F.least(F.count("*"), F.lit(1500)).alias("n")).agg(F.sum("n")).first()[0]
    assert top.count() == expected
    assert first_per_key(rows, ["k"], [F.col("v")]).count() == counts.count()


def test_aliases_of_one_issue_are_one_hit(spark):
    from fleetlens.operators import advisories as A
    from fleetlens.operators import matching as M

    records = spark.createDataFrame([("GHSA-1", ["CVE-1"], "HIGH"), ("CVE-1", [], "LOW"), ("GHSA-2", ["CVE-2"], "LOW")], "identifier string, aliases array<string>, severity string")
    groups = A.alias_groups(records).join(records, "identifier").select("identifier", "group_id")
    names = groups.groupBy("group_id").agg(F.min("identifier").alias("canonical")).join(groups, "group_id").select("identifier", "canonical")
    hits = spark.createDataFrame([("npm", "p", "1.0.0", i) for i in ("GHSA-1", "CVE-1", "GHSA-2", "X-9")], "ecosystem string, norm_name string, version string, identifier string")
    assert sorted(r.identifier for r in M.canonical_hits(hits, names).collect()) == ["CVE-1", "GHSA-2", "X-9"]


def test_long_numbers_do_not_stop_a_job(spark):
    from fleetlens.functions import versions as V

    rows = [("npm", "9" * 45 + ".0.1"), ("npm", "1." + "7" * 400 + ".0"), ("PyPI", "8" * 45 + ".2"), ("npm", "2.0.0")]
    df = spark.createDataFrame(rows, "e string, v string")
    got = df.select("v", V.major_of(F.col("v"), F.col("e")).alias("m"), V.semver_parse(F.col("v")).alias("p"), V.version_key(F.col("v"), F.col("e")).alias("k")).collect()
    assert [None if r.m is None else int(r.m) for r in got] == [None, 1, None, 2]
    npm = [r.k for r in got if r.v[0] in "912"]
    assert npm[1] < npm[2] < npm[0]


def test_a_deep_v1_lock_and_long_names(spark):
    import json

    from fleetlens.operators import dependencies as D
    from fleetlens.operators import extract_npm as N

    tree = {"version": "1.0.0"}
    for k in range(70):
        tree = {"version": "1.0.0", "dependencies": {f"d{k}": tree}}
    lock = json.dumps({"dependencies": {"top": tree}})
    rows = N.flatten_lock_v1(spark.createDataFrame([(1, "package-lock.json", lock)], "repository_id int, path string, content string"))
    assert rows.count() == 71
    long = [(1, "PyPI", "n" * 300 + t, "1", "f") for t in "ab"]
    deps = spark.createDataFrame(long, "analysis_id int, ecosystem string, package_name string, version string, source_file string")
    assert D.dependency_identity_dedupe(deps, [F.col("package_name")]).count() == 2


def test_usage_of_both_ecosystems_and_what_absence_means(spark):
    from fleetlens.operators import usage as U

    wanted = spark.createDataFrame(
        [(1, "npm", "left"), (1, "npm", "right"), (1, "PyPI", "Web_Kit"), (2, "npm", "left"), (3, "PyPI", "gone")],
        "repository_id int, ecosystem string, package_name string",
    )
    rows = [
        (1, "web/a.ts", 1, "import x from 'left/sub'"), (1, "web/a.ts", 2, "import y from 'left-es'"), (1, "web/b.js", 1, "// require('right')"),
        (1, "package.json", 3, '  "right": "^1.0",'), (1, "requirements.txt", 1, "web-kit==1"), (1, "app/m.py", 1, "from web_kit.core import z"),
    ]
    lines = spark.createDataFrame(rows, "repository_id int, path string, line_no int, text string")
    listing = [(r, p, False) for r, p in {(r[0], r[1]) for r in rows}] + [(3, "big.py", True), (3, "node_modules/x.js", True)]
    files = spark.createDataFrame(listing, "repository_id int, path string, is_too_large boolean")
    refs = U.match_usage(lines, wanted)
    pairs = U.map_components(lines, spark.createDataFrame([], "repository_id int, path string"))
    found = U.usage_evidence(wanted, refs, pairs, U.scan_summary(files), max_references=1)
    verdict = U.usage_verdict(F.col("total_files"), F.col("truncated"), F.col("skipped_files_total"), F.lit("direct"), F.col("analysed"))
    got = {(r.repository_id, r.package_name): r for r in found.withColumn("kind", verdict["kind"]).collect()}
    assert {k: r.kind for k, r in got.items()} == {
        (1, "left"): "used", (1, "right"): "no-direct-import", (1, "Web_Kit"): "used", (2, "left"): "not-analysed", (3, "gone"): "scan-incomplete",
    }
    assert (got[1, "left"].files, got[1, "left"].components) == (["web/a.ts"], ["web"])
    assert (got[1, "right"].n_config, got[1, "right"].total_files, got[1, "right"].references[0].file) == (1, 0, "package.json")
    kit = got[1, "Web_Kit"]
    assert (kit.n_references, kit.n_config, kit.truncated, [r.kind for r in kit.references]) == (2, 1, True, ["import"])
    assert (got[3, "gone"].skipped_files, got[3, "gone"].scanned_files) == (["big.py"], 0)
    nothing = U.usage_evidence(wanted, refs.limit(0), pairs).select("analysed").distinct().collect()
    assert [r.analysed for r in nothing] == [False]


def test_npm_files_that_cannot_be_read_are_warnings(spark):
    from fleetlens.operators import extract_npm as N

    lock = '{"dependencies": {"a": {"version": "1.0.1", "requires": {"b": "1"}}, "b": {"version": "3.0.0"}}}'
    files = [
        (1, "package.json", '{"dependencies": {"a": "^1.0.0"}}'), (1, "package-lock.json", lock), (1, "x/package.json", "{broken"),
        (2, "package.json", None), (3, "package.json", "[1]"), (3, "pnpm-lock.yaml", "x: 1"), (3, "package-lock.json", "nope"),
    ]
    deps, relations, warnings = N.extract_npm(spark.createDataFrame(files, "repository_id int, path string, content string"))
    got = sorted((r.repository_id, r.package_name, r.version, r.scope) for r in deps.collect())
    assert got == [(1, "a", "1.0.1", "direct"), (1, "b", "3.0.0", "transitive")]
    assert [(r.parent_name, r.child_name) for r in relations.collect()] == [("a", "b")]
    assert sorted((r.repository_id, r.message.split(":")[0]) for r in warnings.collect()) == [
        (1, "x/package.json"), (2, "package.json"), (3, "package-lock.json"), (3, "package.json"), (3, "pnpm-lock.yaml"),
    ]


def test_an_unanswered_candidate_is_neither_safe_nor_affected(spark):
    ranges = make_ranges(spark, [("A", "1.0.0", "2.0.0", None, "SEMVER"), ("B", "2.0.0", "3.0.0", None, "SEMVER")])
    down = spark.createDataFrame([("npm", "p", "2.0.0"), ("npm", "p", "3.0.0")], "ecosystem string, norm_name string, version string")
    got = {r.start: (r.candidate, r.verified) for r in verified(spark, ranges, [], ["1.0.0", "5.0.0"], down).collect()}
    assert got == {"1.0.0": ("3.0.0", None), "5.0.0": ("5.0.0", True)}


def test_a_fix_inside_another_interval_of_its_issue_is_none(spark):
    """E7 in the search: 1.5.0 closes one interval of A, but lies in another; B's own interval does not matter to A."""
    rows = [("A", "1.0.0", "1.5.0", None, "SEMVER"), ("A", "1.2.0", "2.0.0", None, "SEMVER"), ("A", "4.0.0", None, None, "SEMVER"), ("B", "1.9.0", "3.0.0", None, "SEMVER"), ("B", None, "9.0.0", None, "GIT")]
    ranges = make_ranges(spark, rows)
    rel = spark.createDataFrame([("npm", "p", v, True) for v in ("2.5.0", "3.1.0")], RELEASES)
    index = RK.version_index(rel, RK.bound_versions(ranges))
    assert sorted((r.identifier, r.fixed) for r in K.safe_fixes(ranges, index).collect()) == [("A", "2.0.0"), ("B", "3.0.0")]
    rows = {r.start: r for r in verified(spark, ranges, ["2.5.0", "3.1.0"], ["1.0.0", "1.3.0", "4.1.0"]).collect()}
    assert {s: (r.candidate, r.verified, r.remaining) for s, r in rows.items()} == {
        "1.0.0": ("3.1.0", True, []), "1.3.0": ("3.1.0", True, []), "4.1.0": ("4.1.0", False, ["A"]),
    }


def test_a_long_way_of_fixes_is_followed_to_its_end(spark):
    """Forty issues, each opened where the last one is fixed: the search doubles its steps."""
    ranges = make_ranges(spark, [(f"A{k:02d}", f"{k}.0.0", f"{k + 1}.0.0", None, "SEMVER") for k in range(1, 41)])
    rows = {r.start: (r.candidate, r.verified) for r in verified(spark, ranges, [], ["1.0.0", "17.3.0", "41.0.0"]).collect()}
    assert rows == {"1.0.0": ("41.0.0", True), "17.3.0": ("41.0.0", True), "41.0.0": ("41.0.0", True)}


def test_gaps_between_vulnerable_ranges_are_safe(spark):
    ranges = make_ranges(spark, [("A", "1.0.0", "2.0.0", None, "SEMVER"), ("B", "1.5.0", None, "2.5.0", "SEMVER"), ("C", "4.0.0", None, None, "SEMVER")])
    options = ["2.0.0", "2.5.0", "3.0.0", "4.0.0", "5.0.0"]
    rel = spark.createDataFrame([("npm", "p", v, True) for v in options], RELEASES)
    index = RK.version_index(rel, RK.bound_versions(ranges))
    rows = [("npm", "p", "1.0.0", "1.9.0", -1, True, v, None) for v in options]
    schema = "ecosystem string, norm_name string, version string, candidate string, candidate_rank long, verified boolean, latest_same_major string, latest string"
    got = K.safe_versions(spark.createDataFrame(rows, schema), RK.rank_spans(ranges, index), index)
    assert sorted({r.option for r in got.collect()}) == ["1.9.0", "3.0.0"]
