"""Readers and writers on small trees."""

import json

from pyspark.sql import functions as F

from fleetlens.sources.advisories import scan_advisories, scan_registry, split_malformed
from fleetlens.sources.files import read_text_files, scan_files
from fleetlens.sources.tables import read_snapshot, write_snapshot


def test_scan_files(spark, tmp_path):
    tree = {"1/app/main.py": "import x", "1/node_modules/y/package.json": "{}", "2/requirements.txt": "flask\n", "2/a/b/c/d/deep.txt": "x", "2/big.bin": "z" * 50}
    for path, content in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    files = scan_files(spark, str(tmp_path), max_depth=3, max_bytes=20, repository_level=True)
    got = {(r.repository_id, r.path): r.is_too_large for r in files.collect()}
    assert got == {("1", "app/main.py"): False, ("2", "requirements.txt"): False, ("2", "big.bin"): True}
    text = {r.path: r.content for r in read_text_files(files).collect()}
    assert text == {"app/main.py": "import x", "requirements.txt": "flask\n", "big.bin": None}


def test_scan_advisories_isolates_bad_records(spark, tmp_path):
    good = {"id": "GHSA-1", "aliases": ["CVE-1"], "severity": [{"type": "CVSS_V3", "score": 7.5}], "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.2.0"}]}]}]}
    lines = [json.dumps(good), '{"id": "GHSA-2", "aliases": ', json.dumps({"summary": "no id"})]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    ok, bad = split_malformed(scan_advisories(spark, str(tmp_path)))
    row = ok.first()
    assert (row.identifier, row.cvss_score, row.severity, row.affected[0].fixed_versions) == ("GHSA-1", 7.5, "HIGH", ["1.2.0"])
    assert sorted(r.reason for r in bad.collect()) == ["malformed record", "record without an id"]


def test_scan_registry(spark, tmp_path):
    (tmp_path / "PyPI").mkdir()
    (tmp_path / "npm").mkdir()
    (tmp_path / "PyPI/demo.json").write_text(json.dumps({"releases": {"1.0": [{"yanked": False}], "1.1": [{"yanked": True}], "1.2": []}}))
    (tmp_path / "npm/@s%2Fp.json").write_text(json.dumps({"versions": {"1.0.0": {}, "2.0.0": {"deprecated": "bad"}}}))
    got = {(r.ecosystem, r.package_name, r.version): r.withdrawn_reason for r in scan_registry(spark, str(tmp_path)).collect()}
    assert got == {("PyPI", "demo", "1.0"): None, ("PyPI", "demo", "1.1"): "yanked", ("npm", "@s/p", "1.0.0"): None, ("npm", "@s/p", "2.0.0"): "bad"}


def test_snapshot_is_idempotent(spark, tmp_path):
    rows = [(1, "npm", "a", "1.0.0"), (1, "npm", "a", None), (1, "npm", "a", None), (2, "npm", "a", "1.0.0")]
    deps = spark.createDataFrame(rows, "analysis_id long, ecosystem string, norm_name string, version string")
    key = ["analysis_id", "ecosystem", "norm_name", "version"]
    for _ in range(2):
        write_snapshot(deps, str(tmp_path / "t"), key, 4)
    write_snapshot(deps.withColumn("version", F.lit("9.9.9")), str(tmp_path / "t"), key, 4)
    assert read_snapshot(spark, str(tmp_path / "t")).count() == 5


def test_large_files_are_read_unless_a_limit_is_given(spark, tmp_path):
    from fleetlens.operators.dependencies import unread_warnings
    from fleetlens.sources.files import read_text_files

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "package-lock.json").write_text("{}" + " " * 3_000_000)
    whole = read_text_files(scan_files(spark, str(tmp_path), repository_level=True))
    assert whole.filter("content IS NULL OR is_too_large").count() == 0 and unread_warnings(whole).count() == 0
    cut = read_text_files(scan_files(spark, str(tmp_path), repository_level=True, max_bytes=100))
    assert [r.message for r in unread_warnings(cut).collect()] == ["package-lock.json: file was not read; what it declares is unknown"]


def test_snapshot_keeps_the_smallest_of_equal_identities_once(spark, tmp_path):
    from fleetlens.sources.tables import read_snapshot, write_snapshot

    path = str(tmp_path / "snap")
    rows = spark.createDataFrame([(1, "a", None, "dev"), (1, "a", None, "main"), (2, "b", "1", "main")], "analysis_id int, name string, version string, scope string")
    for _ in range(2):
        write_snapshot(rows, path, ["analysis_id", "name", "version"])
    got = read_snapshot(spark, path).select("analysis_id", "name", "version", "scope").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", None, "dev"), (2, "b", "1", "main")]
