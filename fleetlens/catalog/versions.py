"""Queries of the version and package-name functions (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.sqlparts import major, norm, valid, vkey
from fleetlens.functions import versions as V
from fleetlens.plans.bindings import ctes, fixture

GROUP = Group()
query = GROUP.query

_STRICT = r"^v?(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
_LOOSE = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?$"
_PEP = V.PEP440
# the engine of the check only knows nine groups: the same grammar with only its last groups captured
_PEP_TAIL = (
    r"(?i)^v?(?:[0-9]+!)?[0-9]+(?:\.[0-9]+)*(?:[-_.]?(?:alpha|beta|preview|pre|rc|a|b|c)[-_.]?(?:[0-9]+)?)?"
    r"(?:-[0-9]+|[-_.]?(?:post|rev|r)[-_.]?(?:[0-9]+)?)?(?:[-_.]?(dev)[-_.]?([0-9]+)?)?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)
_SEM = f"""sem AS (SELECT version, regexp_matches(version, '{_STRICT}') AS strict_ok, regexp_matches(version, '{_LOOSE}') AS loose_ok,
 TRY_CAST(regexp_extract(version, '^v?(\\d+)', 1) AS BIGINT) AS a, coalesce(TRY_CAST(regexp_extract(version, '^v?\\d+\\.(\\d+)', 1) AS BIGINT), 0) AS b,
 coalesce(TRY_CAST(regexp_extract(version, '^v?\\d+\\.\\d+\\.(\\d+)', 1) AS BIGINT), 0) AS c, CASE WHEN regexp_matches(version, '{_STRICT}') THEN regexp_extract(version, '{_STRICT}', 4) ELSE '' END AS pre
 FROM fx_versions WHERE ecosystem = 'npm')"""
_PEP_GROUPS = ", ".join(
    f"lower(regexp_extract(version, '{_PEP if i < 9 else _PEP_TAIL}', {i if i < 9 else i - 8})) AS g{i}" for i in range(1, 12)
)
_PEPCTE = f"""pep AS (SELECT version, coalesce(TRY_CAST(g1 AS BIGINT), 0) AS epoch, list_transform(string_split(regexp_replace(g2, '(\\.0+)+$', ''), '.'), lambda x: CAST(x AS BIGINT)) AS rel,
 CASE WHEN g3 IN ('a','alpha') THEN 1 WHEN g3 IN ('b','beta') THEN 2 WHEN g3 <> '' THEN 3 WHEN g5 = '' AND g7 = '' AND g9 <> '' THEN 0 ELSE 4 END AS pre, coalesce(TRY_CAST(g4 AS BIGINT), 0) AS pre_n,
 CASE WHEN g5 <> '' OR g7 <> '' THEN coalesce(TRY_CAST(g6 || g8 AS BIGINT), 0) ELSE -1 END AS post, CASE WHEN g9 = '' THEN 1000000000 ELSE coalesce(TRY_CAST(g10 AS BIGINT), 0) END AS dev,
 CASE WHEN g11 = '' THEN [] ELSE list_transform(string_split(g11, '.'), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN '1' || lpad(x, 9, '0') ELSE '0' || x END) END AS loc,
 CAST(split_part(g2, '.', 1) AS BIGINT) AS major, g3 <> '' OR g9 <> '' AS is_pre
 FROM (SELECT version, {_PEP_GROUPS} FROM fx_versions WHERE ecosystem = 'PyPI' AND regexp_matches(version, '{_PEP}')) r)"""


@query(
    "normalize_package_name",
    ctes("fx_dependencies") + f" SELECT DISTINCT ecosystem, package_name, {norm()} AS normalised FROM fx_dependencies",
)
def _normalize(spark, d):
    deps = fixture(spark, d, "fx_dependencies")
    return (
        deps.select("ecosystem", "package_name")
        .distinct()
        .withColumn("normalised", V.normalize_package_name(F.col("package_name"), F.col("ecosystem")))
    )


@query(
    "semver_parse",
    ctes("fx_versions")
    + f", {_SEM} SELECT version, CASE WHEN strict_ok OR loose_ok THEN a END AS major, CASE WHEN strict_ok OR loose_ok THEN b END AS minor, CASE WHEN strict_ok OR loose_ok THEN c END AS patch, CASE WHEN strict_ok OR loose_ok THEN pre END AS pre FROM sem",
)
def _semver_parse(spark, d):
    df = fixture(spark, d, "fx_versions").filter("ecosystem = 'npm'")
    return df.select("version", V.semver_parse(F.col("version")).alias("p")).select(
        "version",
        F.col("p.major").cast("bigint").alias("major"),
        F.col("p.minor").cast("bigint").alias("minor"),
        F.col("p.patch").cast("bigint").alias("patch"),
        F.array_join("p.pre", ".").alias("pre"),
    )


def _ends(df, key):
    """Lowest and highest version per major number: shows the whole order."""
    return df.filter("k IS NOT NULL").groupBy("major").agg(
        F.min(F.struct("k", "version"))["version"].alias("lowest"),
        F.max(F.struct("k", "version"))["version"].alias("highest"),
        F.count("*").alias("versions"),
    )


_SEM_ORDER = "a, b, c, CASE WHEN pre = '' THEN 1 ELSE 0 END, list_transform(string_split(pre, '.'), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN '0' || lpad(x, 12, '0') ELSE '1' || x END)"
_PEP_ORDER = "epoch, rel, pre, pre_n, post, dev, loc"


def _ends_sql(source: str, order: str, major_expr: str, where: str) -> str:
    down = ", ".join(f"{o} DESC" for o in _split_top(order))
    return f""" SELECT major, max(CASE WHEN up = 1 THEN version END) AS lowest, max(CASE WHEN down = 1 THEN version END) AS highest, count(*) AS versions FROM (
 SELECT {major_expr} AS major, version, row_number() OVER (PARTITION BY {major_expr} ORDER BY {order}, version) AS up, row_number() OVER (PARTITION BY {major_expr} ORDER BY {down}, version DESC) AS down FROM {source} WHERE {where}) r GROUP BY major"""


def _split_top(text: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in text:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


@query("semver_key", ctes("fx_versions") + f", {_SEM}" + _ends_sql("sem", _SEM_ORDER, "a", "strict_ok OR loose_ok"))
def _semver_key(spark, d):
    df = fixture(spark, d, "fx_versions").filter("ecosystem = 'npm'")
    version = F.col("version")
    return _ends(
        df.select(
            "version",
            V.semver_key(version).alias("k"),
            V.major_of(version, F.lit("npm")).cast("bigint").alias("major"),
        ),
        "k",
    )


@query("pep440_key", ctes("fx_versions") + f", {_PEPCTE}" + _ends_sql("pep", _PEP_ORDER, "major", "true"))
def _pep440_key(spark, d):
    df = fixture(spark, d, "fx_versions").filter("ecosystem = 'PyPI'")
    version = F.col("version")
    return _ends(
        df.select(
            "version",
            V.pep440_key(version).alias("k"),
            V.major_of(version, F.lit("PyPI")).cast("bigint").alias("major"),
        ),
        "k",
    )


_ALL = ctes("fx_versions") + f", {_SEM}, {_PEPCTE}"


@query(
    "is_valid_version",
    _ALL
    + f" SELECT ecosystem, version, CASE WHEN ecosystem = 'PyPI' THEN regexp_matches(version, '{_PEP}') ELSE regexp_matches(version, '{_STRICT}') OR regexp_matches(version, '{_LOOSE}') END AS is_valid FROM fx_versions",
)
def _is_valid(spark, d):
    df = fixture(spark, d, "fx_versions")
    return df.select("ecosystem", "version", V.is_valid_version(F.col("version"), F.col("ecosystem")).alias("is_valid"))


@query(
    "compare_versions",
    ctes("fx_dependencies", "fx_advisories")
    + f""", pairs AS (SELECT DISTINCT d.ecosystem, d.version, a.introduced FROM (SELECT *, {norm()} AS n FROM fx_dependencies) d JOIN fx_advisories a ON d.ecosystem = a.ecosystem AND d.n = {norm('a.package_name', 'a.ecosystem')})
 SELECT ecosystem, version, introduced, CASE WHEN {vkey()} < {vkey('introduced')} THEN -1 WHEN {vkey()} > {vkey('introduced')} THEN 1 WHEN {vkey()} = {vkey('introduced')} THEN 0 END AS cmp FROM pairs""",
)
def _compare(spark, d):
    norm_name = V.normalize_package_name(F.col("package_name"), F.col("ecosystem"))
    deps = fixture(spark, d, "fx_dependencies").withColumn("n", norm_name)
    adv = fixture(spark, d, "fx_advisories").withColumn("n", norm_name).select("ecosystem", "n", "introduced")
    pairs = deps.join(adv, ["ecosystem", "n"]).select("ecosystem", "version", "introduced").distinct()
    return pairs.withColumn("cmp", V.compare_versions(F.col("version"), F.col("introduced"), F.col("ecosystem")))


@query(
    "is_prerelease",
    _ALL
    + " SELECT 'npm' AS ecosystem, version, pre <> '' AS is_prerelease FROM sem WHERE strict_ok OR loose_ok UNION ALL SELECT 'PyPI', version, is_pre FROM pep",
)
def _is_prerelease(spark, d):
    df = fixture(spark, d, "fx_versions")
    return df.select(
        "ecosystem", "version", V.is_prerelease(F.col("version"), F.col("ecosystem")).alias("is_prerelease")
    ).filter("is_prerelease IS NOT NULL")


@query(
    "major_of",
    _ALL
    + " SELECT 'npm' AS ecosystem, version, a AS major FROM sem WHERE strict_ok OR loose_ok UNION ALL SELECT 'PyPI', version, major FROM pep",
)
def _major_of(spark, d):
    df = fixture(spark, d, "fx_versions")
    return df.select(
        "ecosystem", "version", V.major_of(F.col("version"), F.col("ecosystem")).cast("bigint").alias("major")
    ).filter("major IS NOT NULL")


def _release_lists(spark, d):
    """Registry versions of each package as one array (a package has a bounded number of releases)."""
    return (
        fixture(spark, d, "fx_releases")
        .groupBy("ecosystem", "package_name")
        .agg(F.sort_array(F.collect_list("version")).alias("versions"))
    )


@query(
    "sort_versions",
    ctes("fx_releases")
    + f" SELECT ecosystem, package_name, string_agg(version, ',' ORDER BY {vkey()}, version) AS ordered FROM fx_releases WHERE {valid()} GROUP BY 1, 2",
)
def _sort_versions(spark, d):
    df = _release_lists(spark, d)
    ordered = V.sort_versions(F.col("versions"), F.col("ecosystem"))
    return df.select("ecosystem", "package_name", F.array_join(ordered, ",").alias("ordered"))


@query(
    "min_version_at_least",
    ctes("fx_releases")
    + f""" SELECT ecosystem, package_name, max(CASE WHEN rn = 1 THEN version END) AS chosen FROM (
 SELECT ecosystem, package_name, version, ok, CASE WHEN ok THEN row_number() OVER (PARTITION BY ecosystem, package_name, ok ORDER BY {vkey()}, version) END AS rn FROM (SELECT *, {vkey()} >= [4, 0, 0, 1, 0] AND version NOT LIKE '%-rc%' AS ok FROM fx_releases) a) b GROUP BY 1, 2""",
)
def _min_at_least(spark, d):
    df = _release_lists(spark, d)
    chosen = V.min_version_at_least(F.col("versions"), F.lit("4.0.0"), F.col("ecosystem"))
    return df.select("ecosystem", "package_name", chosen.alias("chosen"))


@query(
    "max_version",
    ctes("fx_releases")
    + f""" SELECT ecosystem, package_name, max(CASE WHEN rn = 1 THEN version END) AS latest FROM (
 SELECT ecosystem, package_name, version, CASE WHEN version NOT LIKE '%-rc%' THEN row_number() OVER (PARTITION BY ecosystem, package_name, version LIKE '%-rc%' ORDER BY {vkey()} DESC, version DESC) END AS rn FROM fx_releases) b GROUP BY 1, 2""",
)
def _max_version(spark, d):
    # grouped form: max_by over the key column, no arrays
    df = fixture(spark, d, "fx_releases")
    key = F.when(
        ~V.is_prerelease(F.col("version"), F.col("ecosystem")), V.version_key(F.col("version"), F.col("ecosystem"))
    )
    return (
        df.select("ecosystem", "package_name", "version", key.alias("k"))
        .groupBy("ecosystem", "package_name")
        .agg(F.max_by("version", F.when(F.col("k").isNotNull(), F.struct("k", "version"))).alias("latest"))
    )


_EXACT = r"^=?v?((?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)$"


@query("exact_version", ctes("fx_specs") + f" SELECT spec, nullif(regexp_extract(spec, '{_EXACT}', 1), '') AS exact FROM fx_specs")
def _exact(spark, d):
    return fixture(spark, d, "fx_specs").select("spec", V.exact_version(F.col("spec")).alias("exact"))


@query(
    "unresolvable_kind",
    ctes("fx_specs")
    + " SELECT spec, CASE WHEN lower(spec) LIKE 'file:%' THEN 'file:' WHEN lower(spec) LIKE 'npm:%' THEN 'npm:' WHEN lower(spec) LIKE 'git+%' THEN 'git+' WHEN lower(spec) LIKE 'github:%' THEN 'github:' WHEN regexp_matches(spec, '^[A-Za-z0-9][\\w.-]*/[\\w.-]+(#.*)?$') THEN 'github shorthand' END AS kind FROM fx_specs",
)
def _kind(spark, d):
    return fixture(spark, d, "fx_specs").select("spec", V.unresolvable_kind(F.col("spec")).alias("kind"))


@query(
    "range_base",
    ctes("fx_specs")
    + " SELECT spec, CASE WHEN b <> '' AND NOT regexp_matches(b, '[ ,|<>=&]') THEN b END AS base FROM (SELECT spec, regexp_replace(spec, '^[\\s=v^~<>!]*', '') AS b FROM fx_specs) s",
)
def _range_base(spark, d):
    return fixture(spark, d, "fx_specs").select("spec", V.range_base(F.col("spec")).alias("base"))


@query(
    "same_version",
    ctes("fx_dependencies", "fx_releases")
    + f""" SELECT d.ecosystem, d.version, r.version AS release_version, coalesce(d.version = r.version OR {vkey('d.version')} = {vkey('r.version')}, false) AS same
 FROM (SELECT DISTINCT ecosystem, {norm()} AS n, version FROM fx_dependencies) d JOIN fx_releases r ON d.ecosystem = r.ecosystem AND d.n = r.package_name AND {major('d.version')} = {major('r.version')}""",
)
def _same(spark, d):
    eco = F.col("ecosystem")
    deps = (
        fixture(spark, d, "fx_dependencies")
        .select("ecosystem", V.normalize_package_name(F.col("package_name"), eco).alias("n"), "version")
        .distinct()
        .withColumn("major", V.major_of(F.col("version"), eco))
    )
    rel = fixture(spark, d, "fx_releases").select(
        "ecosystem",
        F.col("package_name").alias("n"),
        F.col("version").alias("release_version"),
        V.major_of(F.col("version"), eco).alias("major"),
    )
    return deps.join(rel, ["ecosystem", "n", "major"]).select(
        "ecosystem",
        "version",
        "release_version",
        V.same_version(F.col("version"), F.col("release_version"), eco).alias("same"),
    )


@query(
    "match_allowed_version",
    ctes("fx_specs")
    + r" SELECT spec, CASE WHEN regexp_replace(spec, '^=?v?', '') IN ('1.2.3', '2.10.4', '7.7.7') THEN regexp_replace(spec, '^=?v?', '') WHEN regexp_replace(spec, '^=?v?', '') = '3.5.1' THEN 'v3.5.1' END AS matched FROM fx_specs",
)
def _match_allowed(spark, d):
    allowed = F.array(*[F.lit(v) for v in ("1.2.3", "2.10.4", "v3.5.1", "7.7.7")])
    return fixture(spark, d, "fx_specs").select("spec", V.match_allowed_version(F.col("spec"), allowed).alias("matched"))
