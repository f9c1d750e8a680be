"""Queries of the advisory feeds and stored advisories (A4-A9) and of their normalisation (E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.sqlparts import band, cvss, norm, vkey
from fleetlens.functions import versions as V
from fleetlens.operators import advisories as A
from fleetlens.plans import fleet
from fleetlens.plans.bindings import ctes, fixture
from fleetlens.session import shared_dir
from fleetlens.sources import advisories as feeds
from fleetlens.sources.tables import read_snapshot, write_snapshot

GROUP = Group()
query = GROUP.query

_P = "CAST(split_part(identifier, '-', 2) AS BIGINT)"


def _numbered(spark, d):
    return fixture(spark, d, "fx_advisories").withColumn("p", F.substring_index("identifier", "-", -1).cast("bigint"))


# ---------------------------------------------------------------- feeds


def _documents(spark, d):
    """OSV-format JSON text of every advisory; every 17th is cut off, every 19th has no id."""
    doc = F.to_json(
        F.expr(
            """named_struct('id', CASE WHEN p % 19 = 18 THEN NULL ELSE identifier END, 'aliases', array(alias), 'summary', concat('about ', package_name),
 'published', '2024-05-06T07:08:09.123456789Z', 'severity', array(named_struct('type', 'CVSS_V3', 'score', cvss_vector)),
 'references', array(named_struct('type', 'WEB', 'url', concat('https://w.example/', p)), named_struct('type', 'ADVISORY', 'url', concat('https://a.example/', p))),
 'affected', array(named_struct('package', named_struct('ecosystem', ecosystem, 'name', package_name), 'ranges', array(named_struct('type', 'ecosystem', 'events',
   array(named_struct('introduced', introduced, 'fixed', NULL), named_struct('introduced', NULL, 'fixed', fixed)))), 'versions', array('0.0.1'))))"""
        )
    )
    rows = _numbered(spark, d)
    return rows.select(F.when(F.col("p") % 17 == 16, F.regexp_replace(doc, ".$", "")).otherwise(doc).alias("value"))


_GOOD = f"{_P} % 17 <> 16 AND {_P} % 19 <> 18"


@query(
    "scan_advisories",
    ctes("fx_advisories")
    + f""" SELECT identifier, alias AS aliases, {band('score')} AS severity, score AS cvss_score, 'https://a.example/' || p AS reference_url, 1714979289123456 AS published_us, introduced, fixed, coalesce(fixed, '') AS fixes
 FROM (SELECT *, {_P} AS p, {cvss()} AS score FROM fx_advisories) s WHERE p % 17 <> 16 AND p % 19 <> 18""",
)
def _scan_advisories(spark, d):
    good, _ = feeds.split_malformed(feeds.parse_advisories(_documents(spark, d)))
    return good.select(
        "identifier",
        F.array_join("aliases", ",").alias("aliases"),
        "severity",
        "cvss_score",
        "reference_url",
        F.unix_micros("published_at").alias("published_us"),
        F.col("affected")[0]["ranges"][0]["introduced"].alias("introduced"),
        F.col("affected")[0]["ranges"][0]["fixed"].alias("fixed"),
        F.array_join(F.col("affected")[0]["fixed_versions"], ",").alias("fixes"),
    )


@query(
    "reject_malformed_advisories",
    ctes("fx_advisories")
    + f" SELECT CASE WHEN p % 17 = 16 THEN 'malformed record' ELSE 'record without an id' END AS reason, count(*) AS n FROM (SELECT {_P} AS p FROM fx_advisories) s WHERE p % 17 = 16 OR p % 19 = 18 GROUP BY 1",
)
def _rejected(spark, d):
    _, bad = feeds.split_malformed(feeds.parse_advisories(_documents(spark, d)))
    return bad.groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "scan_registry",
    ctes("fx_releases")
    + " SELECT ecosystem, package_name, version, bool_and(NOT withdrawn) AS installable FROM fx_releases GROUP BY 1, 2, 3",
)
def _registry(spark, d):
    rel = fixture(spark, d, "fx_releases").groupBy("ecosystem", "package_name", "version").agg(
        F.bool_or("withdrawn").alias("withdrawn")
    )
    pypi_meta = F.array(F.struct(F.col("withdrawn").alias("yanked")), F.struct(F.col("withdrawn").alias("yanked")))
    docs = rel.groupBy("ecosystem", "package_name").agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("version", pypi_meta.alias("f")))).alias("releases"))).alias("py"),
        F.to_json(
            F.struct(
                F.map_from_entries(
                    F.collect_list(
                        F.struct("version", F.struct(F.when(F.col("withdrawn"), "bad release").alias("deprecated")).alias("m"))
                    )
                ).alias("versions")
            )
        ).alias("js"),
    )
    raw = docs.select(
        "ecosystem", "package_name", F.when(F.col("ecosystem") == "PyPI", F.col("py")).otherwise(F.col("js")).alias("value")
    )
    return feeds.parse_registry(raw).select("ecosystem", "package_name", "version", "installable")


@query(
    "write_snapshot",
    ctes("fx_dependencies")
    + f" SELECT ecosystem, scope, count(*) AS n FROM (SELECT DISTINCT analysis_id, ecosystem, {norm()} AS norm_name, version, source_file, min(scope) AS scope FROM fx_dependencies GROUP BY 1, 2, 3, 4, 5) s GROUP BY 1, 2",
)
def _snapshot(spark, d):
    identity = ["analysis_id", "ecosystem", "norm_name", "version", "source_file"]
    deps = fleet.dependencies(spark, d).groupBy(*identity).agg(F.min("scope").alias("scope"))
    path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(deps, path, identity, buckets=8)
    write_snapshot(deps, path, identity, buckets=8)  # a second run of the same analysis adds nothing
    return read_snapshot(spark, path).groupBy("ecosystem", "scope").agg(F.count("*").alias("n"))


_SCORED = f"scored AS (SELECT *, {_P} AS p, {cvss()} AS score, {band(cvss())} AS sev FROM fx_advisories)"


@query(
    "upsert_advisories",
    ctes("fx_advisories")
    + f""", {_SCORED}, o AS (SELECT identifier, alias, CASE WHEN p % 4 = 0 THEN 'UNKNOWN' ELSE sev END AS severity, score, CASE WHEN p % 5 = 0 THEN NULL ELSE 'old ' || p END AS summary FROM scored),
 n AS (SELECT identifier || CASE WHEN p % 3 = 0 THEN '-new' ELSE '' END AS identifier, 'X-' || p AS alias, CASE WHEN p % 2 = 0 THEN 'UNKNOWN' ELSE 'CRITICAL' END AS severity, CASE WHEN p % 7 = 0 THEN NULL ELSE score END AS score, CASE WHEN p % 2 = 0 THEN NULL ELSE 'new ' || p END AS summary FROM scored)
 SELECT coalesce(n.identifier, o.identifier) AS identifier, concat_ws(',', o.alias, n.alias) AS aliases, CASE WHEN n.severity <> 'UNKNOWN' OR o.severity IS NULL THEN coalesce(n.severity, o.severity) ELSE o.severity END AS severity,
 coalesce(n.score, o.score) AS cvss_score, coalesce(n.summary, o.summary) AS summary FROM o FULL JOIN n ON o.identifier = n.identifier""",
)
def _upsert(spark, d):
    base = fleet.scored_advisories(spark, d).withColumn("p", F.substring_index("identifier", "-", -1).cast("bigint"))
    old = base.select(
        "identifier",
        F.lit("osv").alias("source"),
        F.array("alias").alias("aliases"),
        F.when(F.col("p") % 4 == 0, "UNKNOWN").otherwise(F.col("severity")).alias("severity"),
        "cvss_score",
        F.when(F.col("p") % 5 != 0, F.concat(F.lit("old "), "p")).alias("summary"),
    )
    new = base.select(
        F.concat("identifier", F.when(F.col("p") % 3 == 0, "-new").otherwise("")).alias("identifier"),
        F.lit("osv").alias("source"),
        F.array(F.concat(F.lit("X-"), "p")).alias("aliases"),
        F.when(F.col("p") % 2 == 0, "UNKNOWN").otherwise("CRITICAL").alias("severity"),
        F.when(F.col("p") % 7 != 0, F.col("cvss_score")).alias("cvss_score"),
        F.when(F.col("p") % 2 != 0, F.concat(F.lit("new "), "p")).alias("summary"),
    )
    merged = A.upsert_advisories(old, new)
    return merged.select("identifier", F.array_join("aliases", ",").alias("aliases"), "severity", "cvss_score", "summary")


def _entries(spark, d):
    """Package entries of the advisories with one interval each."""
    df = _numbered(spark, d)
    interval = F.expr(
        "named_struct('range_type', CASE WHEN p % 8 = 7 THEN 'GIT' ELSE 'ECOSYSTEM' END, 'introduced', introduced, 'fixed', fixed, 'last_affected', CAST(NULL AS STRING))"
    )
    return df.select(
        "identifier",
        "alias",
        "p",
        "ecosystem",
        "package_name",
        V.normalize_package_name(F.col("package_name"), F.col("ecosystem")).alias("norm_name"),
        F.array(interval).alias("ranges"),
        F.array(F.col("introduced")).alias("versions"),
        F.when(F.col("fixed").isNotNull() & (F.col("p") % 8 != 7), F.array("fixed"))
        .otherwise(F.array().cast("array<string>"))
        .alias("fixed_versions"),
    )


@query(
    "refresh_affected",
    ctes("fx_advisories")
    + f""", s AS (SELECT *, {_P} AS p, {norm()} AS norm_name FROM fx_advisories)
 SELECT identifier, ecosystem, norm_name, 'stored' AS origin FROM s WHERE p % 3 <> 0 UNION ALL SELECT identifier, ecosystem, norm_name || CASE WHEN p % 3 = 0 THEN '' ELSE '-x' END, 'incoming' FROM s""",
)
def _refresh(spark, d):
    stored = _entries(spark, d).withColumn("versions", F.array(F.lit("stored")))
    incoming = _entries(spark, d).withColumns(
        {
            "norm_name": F.concat("norm_name", F.when(F.col("p") % 3 == 0, "").otherwise("-x")),
            "versions": F.array(F.lit("incoming")),
        }
    )
    merged = A.refresh_affected(stored, incoming)
    return merged.select("identifier", "ecosystem", "norm_name", F.col("versions")[0].alias("origin"))


# ---------------------------------------------------------------- E1-E3


@query(
    "flatten_range_events",
    ctes("fx_advisories")
    + f""", s AS (SELECT *, {_P} AS p FROM fx_advisories)
 SELECT identifier, 'SEMVER' AS range_type, introduced, fixed, CAST(NULL AS VARCHAR) AS last_affected FROM s WHERE p % 3 <> 1
 UNION ALL SELECT identifier, 'SEMVER', NULL, fixed, NULL FROM s WHERE p % 3 = 1 UNION ALL SELECT identifier, 'SEMVER', introduced, NULL, NULL FROM s WHERE p % 3 = 1
 UNION ALL SELECT identifier, 'SEMVER', '9.0.0', NULL, '9.5.0' FROM s WHERE p % 3 = 2""",
)
def _flatten(spark, d):
    event = "named_struct('introduced', {}, 'fixed', {}, 'last_affected', {})"
    null = "CAST(NULL AS STRING)"
    opened, closed = event.format("introduced", null, null), event.format(null, "fixed", null)
    again = event.format("'9.0.0'", null, null) + ", " + event.format(null, null, "'9.5.0'")
    events = F.expr(
        f"CASE p % 3 WHEN 0 THEN array({opened}, {closed}) WHEN 1 THEN array({closed}, {opened}) ELSE array({opened}, {closed}, {again}) END"
    )
    df = _numbered(spark, d).select(
        "identifier", F.array(F.struct(F.lit("semver").alias("type"), events.alias("events"))).alias("ranges")
    )
    return df.select("identifier", F.explode(A.flatten_range_events(F.col("ranges"))).alias("r")).select("identifier", "r.*")


@query(
    "derive_fixed_versions",
    ctes("fx_advisories")
    + f" SELECT ecosystem, package_name, string_agg(fixed, ',' ORDER BY {vkey('fixed')}) AS fixes FROM (SELECT DISTINCT ecosystem, package_name, fixed FROM fx_advisories WHERE fixed IS NOT NULL AND {_P} % 8 <> 7) s GROUP BY 1, 2",
)
def _derive(spark, d):
    grouped = (
        _entries(spark, d)
        .groupBy("ecosystem", "package_name")
        .agg(F.array_sort(F.flatten(F.collect_list("ranges"))).alias("ranges"))
    )
    fixes = A.derive_fixed_versions(F.col("ranges"), F.col("ecosystem"))
    return grouped.select("ecosystem", "package_name", F.array_join(fixes, ",").alias("fixes")).filter("fixes <> ''")


@query(
    "filter_affected_for_package",
    ctes("fx_advisories", "fx_dependencies")
    + f""" SELECT identifier, a.ecosystem, a.package_name FROM fx_advisories a WHERE EXISTS (SELECT 1 FROM fx_dependencies d WHERE d.scope = 'direct' AND d.ecosystem = a.ecosystem AND {norm('d.package_name', 'd.ecosystem')} = {norm('a.package_name', 'a.ecosystem')})""",
)
def _filter_affected(spark, d):
    direct = fixture(spark, d, "fx_dependencies").filter("scope = 'direct'")
    return A.filter_affected_for_package(_entries(spark, d), direct).select("identifier", "ecosystem", "package_name")


# ---------------------------------------------------------------- E4-E10


@query(
    "alias_groups",
    ctes("fx_alias_records")
    + """, keyed AS (SELECT identifier, CASE WHEN p % 16 <= 4 THEN a WHEN p % 16 <= 8 THEN CASE WHEN b IS NULL THEN a ELSE least(a, b) END ELSE b END AS key
 FROM (SELECT identifier, p, 'CVE-X' || (p - p % 16 + 3) AS a, CASE WHEN p - p % 16 + 9 <= (SELECT max(p) FROM fx_alias_records) THEN 'CVE-X' || (p - p % 16 + 9) END AS b FROM fx_alias_records) s)
 SELECT identifier, min(identifier) OVER (PARTITION BY key) AS group_id FROM keyed""",
)
def _alias_groups(spark, d):
    return A.alias_groups(_alias_records(spark, d))


def _alias_records(spark, d):
    records = fixture(spark, d, "fx_alias_records")
    return records.select("identifier", F.array_compact(F.array("alias_m", "alias_n", "alias_cve")).alias("aliases"))


def _records(spark, d):
    """Advisories as records with the group the alias rule gives them (CVE ids stand alone, others share an alias)."""
    rows = fleet.scored_advisories(spark, d).withColumn("p", F.substring_index("identifier", "-", -1).cast("bigint"))
    return rows.select(
        "identifier",
        "alias",
        F.array("alias").alias("aliases"),
        F.when(F.col("p") % 4 == 2, "UNKNOWN").otherwise(F.col("severity")).alias("severity"),
        F.when(F.col("p") % 4 != 2, F.col("cvss_score")).alias("cvss_score"),
        "cvss_vector",
        F.date_add(F.lit("2020-01-01").cast("date"), F.pmod("p", F.lit(7)).cast("int")).cast("timestamp").alias("published_at"),
        F.when(F.col("p") % 5 != 0, F.concat(F.lit("about "), "p")).alias("summary"),
    )


def _groups(spark, d):
    return A.alias_groups(_records(spark, d).select("identifier", "aliases"))


_GROUPED = f"""rec AS (SELECT *, {_P} AS p, CASE WHEN {_P} % 4 = 2 THEN 'UNKNOWN' ELSE {band(cvss())} END AS sev, CASE WHEN {_P} % 4 <> 2 THEN {cvss()} END AS score,
   DATE '2020-01-01' + CAST({_P} % 7 AS INTEGER) AS pub, CASE WHEN {_P} % 5 <> 0 THEN 'about ' || {_P} END AS summary,
   CASE split_part(identifier, '-', 1) WHEN 'GHSA' THEN 0 WHEN 'CVE' THEN 1 ELSE 2 END AS tier, CASE WHEN identifier LIKE 'CVE-%' THEN identifier ELSE alias END AS key FROM fx_advisories),
 ranked AS (SELECT *, min(identifier) OVER (PARTITION BY key) AS group_id, row_number() OVER (PARTITION BY key ORDER BY tier, score IS NULL, pub, identifier) AS rn FROM rec)"""
_RANK = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
_NAME = "CASE {} WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'UNKNOWN' END"


@query(
    "merge_group",
    ctes("fx_advisories")
    + f""", {_GROUPED}, best AS (SELECT group_id, sev AS best_sev, score AS best_score, cvss_vector AS best_vector, row_number() OVER (PARTITION BY group_id ORDER BY score DESC NULLS LAST, rn) AS b FROM ranked),
 agg AS (SELECT group_id, max(CASE WHEN rn = 1 THEN identifier END) AS identifier, max(CASE WHEN rn = 1 THEN {_RANK.format('sev')} END) AS r1, max({_RANK.format('sev')}) AS rmax, max(alias) AS alias, arg_min(summary, rn) FILTER (summary IS NOT NULL) AS summary, count(*) AS members, arg_min('feed-' || right(identifier, 1), rn) AS source FROM ranked GROUP BY 1),
 refs AS (SELECT group_id, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM (SELECT group_id, 'https://a.example/' || identifier AS ref FROM ranked UNION ALL SELECT group_id, 'https://b.example/' || alias FROM ranked) u GROUP BY 1),
 names AS (SELECT r.group_id, string_agg(DISTINCT r.token, ',' ORDER BY r.token) AS aliases FROM (SELECT group_id, identifier AS token FROM ranked UNION ALL SELECT group_id, alias FROM ranked) r JOIN agg a ON a.group_id = r.group_id WHERE r.token <> a.identifier GROUP BY 1)
 SELECT a.group_id, a.identifier, n.aliases, {_NAME.format(f"greatest(CASE WHEN r1 = 0 THEN rmax ELSE r1 END, CASE WHEN best_score IS NULL THEN 0 ELSE {_RANK.format('best_sev')} END)")} AS severity, best_score AS cvss_score, best_vector AS cvss_vector, summary, members, source, refs.refs AS "references"
 FROM agg a JOIN best ON best.group_id = a.group_id AND b = 1 JOIN names n ON n.group_id = a.group_id JOIN refs ON refs.group_id = a.group_id""",
)
def _merge_group(spark, d):
    records = _records(spark, d)
    links = F.transform("aliases", lambda a: F.concat(F.lit("https://b.example/"), a))
    records = records.withColumns({"source": F.concat(F.lit("feed-"), F.expr("right(identifier, 1)")), "references": F.array_union(F.array(F.concat(F.lit("https://a.example/"), "identifier")), links)})
    merged = A.merge_group(records, _groups(spark, d))
    return merged.select(
        "group_id", "identifier", F.array_join("aliases", ",").alias("aliases"), "severity", "cvss_score", "cvss_vector", "summary", "members",
        "source", F.array_join(F.array_sort("references"), ",").alias("references"),
    )


_MERGED = f"""{_GROUPED}, ent AS (SELECT group_id, ecosystem, {norm()} AS norm_name, introduced, fixed, p FROM ranked),
 fixes AS (SELECT DISTINCT group_id, ecosystem, norm_name, fixed FROM ent WHERE fixed IS NOT NULL AND p % 8 <> 7),
 safe AS (SELECT * FROM fixes f WHERE NOT EXISTS (SELECT 1 FROM ent r WHERE r.group_id = f.group_id AND r.ecosystem = f.ecosystem AND r.norm_name = f.norm_name AND r.fixed IS DISTINCT FROM f.fixed
   AND {vkey('f.fixed')} >= {vkey('r.introduced')} AND (r.fixed IS NULL OR {vkey('f.fixed')} < {vkey('r.fixed')})))"""


@query(
    "merge_affected",
    ctes("fx_advisories")
    + f""", {_MERGED} SELECT e.group_id, e.ecosystem, e.norm_name, count(DISTINCT (e.introduced, coalesce(e.fixed, '-'), e.p % 8 = 7)) AS n_ranges, string_agg(DISTINCT e.introduced, ',' ORDER BY e.introduced) AS versions,
 coalesce(max(s.fixes), '') AS fixed_versions FROM ent e LEFT JOIN (SELECT group_id, ecosystem, norm_name, string_agg(fixed, ',' ORDER BY {vkey('fixed')}) AS fixes FROM safe GROUP BY 1, 2, 3) s ON s.group_id = e.group_id AND s.ecosystem = e.ecosystem AND s.norm_name = e.norm_name GROUP BY 1, 2, 3""",
)
def _merge_affected(spark, d):
    merged = A.merge_affected(_entries(spark, d), _groups(spark, d))
    return merged.select(
        "group_id", "ecosystem", "norm_name", F.size("ranges").cast("bigint").alias("n_ranges"),
        F.array_join("versions", ",").alias("versions"), F.array_join("fixed_versions", ",").alias("fixed_versions"),
    )


@query(
    "drop_unsafe_fixes",
    ctes("fx_advisories") + f", {_MERGED} SELECT group_id, ecosystem, norm_name, fixed FROM safe",
)
def _unsafe(spark, d):
    keys = ["group_id", "ecosystem", "norm_name"]
    rows = _entries(spark, d).join(_groups(spark, d), "identifier")
    fixes = rows.select(*keys, F.explode("fixed_versions").alias("fixed")).distinct()
    ranges = rows.select(*keys, F.explode("ranges").alias("r")).select(*keys, "r.*").distinct()
    return A.drop_unsafe_fixes(fixes, A.with_range_keys(ranges), keys)


@query(
    "canonical_map",
    ctes("fx_advisories")
    + f", {_GROUPED} SELECT identifier, first_value(identifier) OVER (PARTITION BY group_id ORDER BY rn) AS canonical FROM ranked",
)
def _canonical(spark, d):
    return A.canonical_map(_records(spark, d), _groups(spark, d))


@query(
    "fixed_versions_for",
    ctes("fx_advisories", "fx_dependencies")
    + f""" SELECT identifier, ecosystem, {norm()} AS norm_name, fixed AS fixes FROM fx_advisories a WHERE fixed IS NOT NULL AND {_P} % 8 <> 7
 AND EXISTS (SELECT 1 FROM fx_dependencies d WHERE d.ecosystem = a.ecosystem AND {norm('d.package_name', 'd.ecosystem')} = {norm('a.package_name', 'a.ecosystem')})""",
)
def _fixed_for(spark, d):
    rows = A.fixed_versions_for(_entries(spark, d), fixture(spark, d, "fx_dependencies"))
    return rows.select("identifier", "ecosystem", "norm_name", F.array_join("fixed_versions", ",").alias("fixes"))


@query(
    "affected_ranges_for",
    ctes("fx_advisories", "fx_dependencies")
    + f""" SELECT identifier, ecosystem, {norm()} AS norm_name, introduced, fixed FROM fx_advisories a
 WHERE EXISTS (SELECT 1 FROM fx_dependencies d WHERE d.ecosystem = a.ecosystem AND {norm('d.package_name', 'd.ecosystem')} = {norm('a.package_name', 'a.ecosystem')})""",
)
def _ranges_for(spark, d):
    rows = A.affected_ranges_for(_entries(spark, d), fixture(spark, d, "fx_dependencies"))
    return rows.select("identifier", "ecosystem", "norm_name", "introduced", "fixed")
