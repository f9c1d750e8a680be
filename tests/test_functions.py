"""Golden rows of the version, text and score expressions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scores as S
from fleetlens.functions import text as T
from fleetlens.functions import versions as V

packaging = pytest.importorskip("pip._vendor.packaging.version")


def column(spark, values, expression, kind="string"):
    """Results in input order; one row per value over several partitions."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").repartition(3)
    got = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(got, key=lambda r: r.i)]


PEP440 = [
    "1.0", "1.0.0", "1.0.dev1", "1.0a1", "1.0a1.dev2", "1.0b2", "1.0rc1", "1.0.post1", "1.0.post1.dev3", "1!0.1", "1.0+local.1",
    "1.0+local.b", "1.0+2", "v2.0", "2.0-1", "2.0.0.0.1", "20240101123456789012345", "1.0-RC.4", "0", "0.0.0",
]


def test_pep440_order_matches_the_public_rules(spark):
    keys = column(spark, PEP440, V.pep440_key)
    for (a, ka), (b, kb) in itertools.product(zip(PEP440, keys, strict=True), repeat=2):
        va, vb = packaging.Version(a), packaging.Version(b)
        assert ((ka > kb) - (ka < kb)) == ((va > vb) - (va < vb)), (a, b)


def test_pep440_order_of_generated_versions(spark):
    rng = random.Random(7)
    made = {
        f"{rng.randint(0, 12)}.{rng.randint(0, 110)}{rng.choice(['', '.0', '.0.0', '.3'])}"
        f"{rng.choice(['', 'a1', 'b10', 'rc2', '.post4'])}{rng.choice(['', '.dev5'])}"
        for _ in range(150)
    }
    made = sorted(made)
    keys = dict(zip(made, column(spark, made, V.pep440_key), strict=True))
    expected = sorted(made, key=packaging.Version)
    got = sorted(made, key=lambda v: (keys[v],))
    assert [packaging.Version(v) for v in got] == [packaging.Version(v) for v in expected]


def test_semver_order(spark):
    ordered = [
        "1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2",
        "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0", "99999999999999999999.0.0",
    ]
    keys = column(spark, ordered, V.semver_key)
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    same = column(spark, ["4", "4.0", "v4.0.0", "4.0.0+build"], V.semver_key)
    assert len(set(same)) == 1
    assert column(spark, ["latest", "1.2.3.4", "1.2.x", ""], V.semver_key) == [None] * 4


@pytest.mark.parametrize("spec,expected", [("1.2.3", "1.2.3"), ("=1.2.3", "1.2.3"), (" v1.2.3 ", "1.2.3"), ("^1.2.3", None), ("latest", None), ("1.2", None)])
def test_exact_version(spark, spec, expected):
    assert column(spark, [spec], V.exact_version) == [expected]


def test_unresolvable_kind(spark):
    specs = ["file:../x", "GIT+ssh://h/x", "github:a/b", "a/b#c", "^1.0.0", "workspace:*", "npm:x@1", "", None]
    assert column(spark, specs, V.unresolvable_kind) == ["file:", "git+", "github:", "github shorthand", None, "workspace:", "npm:", None, None]


def test_sort_and_floor(spark):
    df = spark.createDataFrame([(["2.0.0", "bad", "1.10.0", "1.9.0", "2.1.0-rc.1"],)], "v array<string>")
    row = df.select(
        V.sort_versions(F.col("v"), F.lit("npm")).alias("s"),
        V.min_version_at_least(F.col("v"), F.lit("1.9.1"), F.lit("npm")).alias("m"),
        V.max_version(F.col("v"), F.lit("npm")).alias("x"),
    ).first()
    assert row.s == ["1.9.0", "1.10.0", "2.0.0", "2.1.0-rc.1"] and row.m == "1.10.0" and row.x == "2.0.0"


CVSS = {
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H": 10.0,
    "CVSS:3.0/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1,
    "CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N": 1.8,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0,
    "cvss:3.1/av:n/ac:l/pr:n/ui:n/s:u/c:n/i:n/a:h/e:p": 7.5,
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H": None,
    "CVSS:3.1/AV:N/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
    "CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": None,
    "CVSS:2.0/AV:N": None,
    "": None,
}


def test_cvss(spark):
    assert column(spark, list(CVSS), S.cvss_v3_base_score) == list(CVSS.values())


def test_severity_bands(spark):
    scores = [None, float("nan"), -0.1, 0.0, 3.9, 4.0, 6.9, 7.0, 8.9, 9.0, 10.0, 10.1]
    names = ["UNKNOWN"] * 3 + ["LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", "UNKNOWN"]
    assert column(spark, scores, S.severity_from_score, "double") == names


REDACTION = {
    "--extra-index-url https://deploy:tok@pypi.example/simple": "--extra-index-url https://***@pypi.example/simple",
    "https://${TOKEN}@host/x": "https://${TOKEN}@host/x",
    "_authToken=abc123": "_authToken=***",
    "password: hunter2, next": "password: ***, next",
    "api_key=$KEY": "api_key=$KEY",
    "token==1.2.3": "token==1.2.3",
    "mytoken=abc": "mytoken=abc",
    "x ghp_" + "a" * 24 + " y": "x *** y",
    "requests>=2.0": "requests>=2.0",
}


def test_redaction(spark):
    assert column(spark, list(REDACTION), T.redact_secrets) == list(REDACTION.values())
    changed = [a != b for a, b in REDACTION.items()]
    assert column(spark, list(REDACTION), T.contains_secret) == changed


def test_logical_lines(spark):
    text = "# head\r\nflask==1.0 \\\n  --hash=sha256:ab  # c\n\n# no \\\nkept#frag\nlast \\"
    df = spark.createDataFrame([(1, text)], "repository_id int, content string")
    got = [(r.line_no, r.text) for r in T.logical_lines(df).orderBy("line_no").collect()]
    assert got == [(2, "flask==1.0   --hash=sha256:ab"), (6, "kept#frag"), (7, "last")]


def test_decode_text_replaces_bad_units(spark):
    from fleetlens.sources.files import read_text_files

    raw = [b"\xff\xfea\x00\x00\xd8", b"\xef\xbb\xbfok\xff", "é".encode(), b"\xff\xfe\x00\x00a\x00\x00\x00"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, content binary")
    got = [r.content for r in read_text_files(df).orderBy("i").collect()]
    assert got[0][0] == "a" and "�" in got[0] and got[1] == "ok�" and got[2] == "é" and got[3] == "a"
    assert spark.conf.get("spark.sql.legacy.codingErrorAction") == "false"


FLOOR = [
    ("LOW", "HIGH", "HIGH"), ("CRITICAL", "HIGH", "CRITICAL"), ("UNKNOWN", "MEDIUM", "MEDIUM"), ("NONE", "LOW", "LOW"),
    (None, "HIGH", "HIGH"), ("garbage", "LOW", "LOW"), ("high", "MEDIUM", "HIGH"), ("LOW", "UNKNOWN", "LOW"), ("NONE", "UNKNOWN", "UNKNOWN"),
]


def test_floor_risk(spark):
    from fleetlens.operators.risk import floor_risk_level

    df = spark.createDataFrame(FLOOR, "j string, p string, want string")
    assert df.filter(~floor_risk_level(F.col("j"), F.col("p")).eqNullSafe(F.col("want"))).collect() == []
