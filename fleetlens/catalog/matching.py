"""Queries of vulnerability matching and findings (F) and the end-to-end fleet answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.sqlparts import HITS, RISK_RANK, band, cvss, norm, valid, vkey
from fleetlens.operators import matching as M
from fleetlens.operators.state import RANGES, MatchState
from fleetlens.plans import fleet
from fleetlens.plans.bindings import ctes, fixture
from fleetlens.session import shared_dir

GROUP = Group()
query = GROUP.query

_BASE = ctes("fx_dependencies", "fx_advisories")
_LOOKUP_HITS = f"{HITS}, lh AS (SELECT DISTINCT ecosystem, norm_name, version, identifier FROM hits)"
_DEPS = f"deps AS (SELECT *, {norm()} AS norm_name, {valid()} AS ok FROM fx_dependencies)"


def _canon(name: str) -> str:
    """Advisories with the canonical one of their issue: CVE ids stand alone, others share their alias."""
    key = "PARTITION BY CASE WHEN identifier LIKE 'CVE-%' THEN identifier ELSE alias END"
    tier = "CASE split_part(identifier, '-', 1) WHEN 'GHSA' THEN 0 WHEN 'CVE' THEN 1 ELSE 2 END"
    return f"""{name} AS (SELECT identifier, canonical, {band('cvss_score')} AS severity, cvss_score FROM (SELECT identifier, max(score) OVER ({key}) AS cvss_score,
 first_value(identifier) OVER ({key} ORDER BY {tier}, score IS NULL, identifier) AS canonical FROM (SELECT identifier, alias, {cvss()} AS score FROM fx_advisories) r) m)"""


_CANON_HITS = f"{HITS}, {_canon('canon')}, lh AS (SELECT DISTINCT h.ecosystem, h.norm_name, h.version, c.canonical AS identifier FROM hits h JOIN canon c ON c.identifier = h.identifier)"
_STATUS = f"""{_CANON_HITS}, {_DEPS}, found AS (SELECT ecosystem, norm_name, version, count(*) AS n, string_agg(identifier, ', ' ORDER BY identifier) AS ids FROM lh GROUP BY 1, 2, 3),
 classified AS (SELECT d.*, f.n, CASE WHEN f.n IS NOT NULL THEN 'VULNERABLE' WHEN d.ok THEN 'SAFE' ELSE 'UNKNOWN' END AS vulnerability_status,
   CASE WHEN f.n = 1 THEN '1 known vulnerability (' || f.ids || ')' WHEN f.n > 1 THEN f.n || ' known vulnerabilities (' || f.ids || ')' WHEN d.version IS NULL THEN '{M.UNPINNED}'
   WHEN NOT d.ok THEN 'Version "' || d.version || '" is not a valid ' || d.ecosystem || ' version; it cannot be checked' END AS status_reason
   FROM deps d LEFT JOIN found f ON d.ecosystem = f.ecosystem AND d.norm_name = f.norm_name AND d.version = f.version)"""


@query(
    "distinct_lookups",
    _BASE + f", {_DEPS} SELECT ecosystem, norm_name, version, count(*) AS n_dependencies FROM deps WHERE ok GROUP BY 1, 2, 3",
)
def _lookups(spark, d):
    return fleet.lookups(spark, d).select(*M.LOOKUP, "n_dependencies")


@query("advisory_match", _BASE + f", {_LOOKUP_HITS} SELECT * FROM lh")
def _match(spark, d):
    return fleet.raw_hits(spark, d)


@query(
    "classify_dependencies",
    _BASE
    + f", {_STATUS} SELECT analysis_id, ecosystem, package_name, version, source_file, scope, vulnerability_status, status_reason FROM classified",
)
def _classify(spark, d):
    return fleet.classified(spark, d).drop("norm_name", "n_advisories")


@query(
    "status_reason",
    _BASE + f", {_STATUS} SELECT DISTINCT ecosystem, norm_name, version, status_reason FROM classified WHERE n IS NOT NULL",
)
def _reason(spark, d):
    found = fleet.run(spark, d).table("statuses")
    return found.filter("n_advisories > 0").select(*M.LOOKUP, "status_reason")


@query(
    "check_summary",
    _BASE
    + f""", {_STATUS} SELECT c.analysis_id, count(*) AS checked, count(*) FILTER (version IS NOT NULL) AS queried, count(*) FILTER (vulnerability_status = 'SAFE') AS safe, count(*) FILTER (vulnerability_status = 'VULNERABLE') AS vulnerable,
 count(*) FILTER (vulnerability_status = 'UNKNOWN') AS unknown, count(*) FILTER (version IS NULL) AS unpinned, coalesce(max(t.n), 0) AS vulnerabilities_total
 FROM classified c LEFT JOIN (SELECT analysis_id, count(DISTINCT canonical) AS n FROM hits h JOIN canon c ON c.identifier = h.identifier GROUP BY 1) t ON t.analysis_id = c.analysis_id GROUP BY 1""",
)
def _summary(spark, d):
    return M.check_summary(fleet.classified(spark, d), fleet.hits(spark, d), fleet.run(spark, d).table("hot"))


def _unanswered(spark, d):
    # lookups of the packages whose number ends in 3 got no answer
    return fleet.lookups(spark, d).filter("norm_name LIKE '%3'").select(*M.LOOKUP)


@query(
    "stage_status",
    _BASE
    + f""", {_DEPS}, l AS (SELECT DISTINCT analysis_id, ecosystem, norm_name, version FROM deps WHERE ok)
 SELECT analysis_id, count(*) FILTER (norm_name LIKE '%3') AS errors, count(*) AS lookups, CASE WHEN count(*) FILTER (norm_name LIKE '%3') = 0 THEN 'OK' WHEN count(*) FILTER (norm_name LIKE '%3') = count(*) THEN 'UNAVAILABLE' ELSE 'PARTIAL' END AS stage_status FROM l GROUP BY 1""",
)
def _stage(spark, d):
    deps = fleet.dependencies(spark, d).select("analysis_id", *M.LOOKUP).distinct()
    missing = _unanswered(spark, d).withColumn("missing", F.lit(True))
    valid_rows = deps.join(fleet.lookups(spark, d).select(*M.LOOKUP), M.LOOKUP, "left_semi").join(missing, M.LOOKUP, "left")
    counts = valid_rows.groupBy("analysis_id").agg(F.count("missing").alias("errors"), F.count("*").alias("lookups"))
    return counts.withColumn("stage_status", M.stage_status(F.col("errors"), F.col("lookups")))


FINDINGS = f"""{_canon('sev')},
 findings AS (SELECT DISTINCT h.analysis_id, h.ecosystem, h.norm_name, h.version, h.source_file, s.canonical AS identifier, s.severity, s.cvss_score, s.severity AS risk_level FROM hits h JOIN sev s ON s.identifier = h.identifier)"""


@query("create_findings", _BASE + f", {HITS}, {FINDINGS} SELECT * FROM findings")
def _findings(spark, d):
    return fleet.findings(spark, d).drop("scope")


@query(
    "check_package",
    ctes("fx_releases", "fx_advisories")
    + f""", {_canon('canon')}, d AS (SELECT DISTINCT ecosystem, package_name, version FROM fx_releases)
 SELECT d.ecosystem, d.package_name, d.version, CASE WHEN count(a.identifier) > 0 THEN 'VULNERABLE' ELSE 'SAFE' END AS vulnerability_status, count(DISTINCT c.canonical) AS n
 FROM d LEFT JOIN fx_advisories a ON d.ecosystem = a.ecosystem AND d.package_name = a.package_name AND {vkey('d.version')} >= {vkey('a.introduced')} AND (a.fixed IS NULL OR {vkey('d.version')} < {vkey('a.fixed')}) LEFT JOIN canon c ON c.identifier = a.identifier GROUP BY 1, 2, 3""",
)
def _check_package(spark, d):
    packages = fixture(spark, d, "fx_releases").select("ecosystem", "package_name", "version").distinct()
    rows = M.check_package(packages, fleet.ranges(spark, d), fleet.canonical(spark, d)[0])
    return rows.select(
        "ecosystem", "package_name", "version", "vulnerability_status", F.coalesce("n_advisories", F.lit(0)).cast("bigint").alias("n")
    )


@query(
    "provisional_risk",
    _BASE + f", {HITS}, {FINDINGS} SELECT risk_level, count(*) AS n FROM findings GROUP BY 1",
)
def _provisional(spark, d):
    # counted per lookup first: the findings themselves never have to exist
    per_lookup = fleet.hits(spark, d).groupBy(*M.LOOKUP, M.provisional_risk(F.col("severity")).alias("risk_level")).agg(
        F.count("*").alias("hits")
    )
    deps = fleet.dependencies(spark, d).select("analysis_id", *M.LOOKUP, "source_file").distinct()
    per_dep = deps.groupBy(*M.LOOKUP).agg(F.count("*").alias("deps"))
    return (
        per_dep.join(per_lookup, M.LOOKUP)
        .groupBy("risk_level")
        .agg(F.sum(F.col("hits") * F.col("deps")).alias("n"))
    )


@query(
    "recheck_statuses",
    _BASE
    + f""", {_STATUS} SELECT analysis_id, ecosystem, norm_name, version, source_file, scope, package_name, vulnerability_status, status_reason FROM classified""",
)
def _recheck(spark, d):
    """A state of stale intervals, then the delta that adds, changes and retracts advisories: what a whole run gives."""
    state = MatchState(spark, f"{shared_dir(spark)}/recheck-{uuid.uuid4().hex}", RECHECK_KEYS, fleet.canonical(spark, d)[0], buckets=16)
    stale, delta = stale_and_delta(fleet.ranges(spark, d))
    state.advise(stale, "advisories-0", F.lit("2024-01-01"))
    state.arrive(fleet.dependencies(spark, d), "dependencies-0", F.lit("2024-01-02"))
    state.advise(delta, "advisories-1", F.lit("2024-01-03"))
    return state.dependencies.read().select(*RECHECK_KEYS, "vulnerability_status", "status_reason")


RECHECK_KEYS = ["analysis_id", "ecosystem", "norm_name", "version", "source_file", "scope", "package_name"]


def stale_and_delta(ranges):
    """Intervals as they once were (a third not yet known, a third without their fix, some since retracted), and what changed."""
    kind = F.crc32("identifier") % 3
    rows = ranges.select(*[c.split()[0] for c in RANGES.split(", ")])
    open_end = rows.filter(kind == 1).withColumn("fixed", F.lit(None).cast("string"))
    gone = rows.filter(kind == 2).withColumns({"identifier": F.concat(F.lit("GONE-"), "identifier"), "introduced": F.lit(None).cast("string"), "fixed": F.lit(None).cast("string")})
    stale = rows.filter(kind == 2).unionByName(open_end).unionByName(gone)
    retracted = gone.withColumn("range_type", F.lit(None).cast("string"))
    return stale, rows.filter(kind != 2).unionByName(retracted)


FLEET_SQL = f""", {HITS}, {FINDINGS}, f AS (SELECT d.analysis_id, count(DISTINCT d.id) AS dependencies, count(DISTINCT CASE WHEN h.identifier IS NOT NULL THEN d.id END) AS vulnerable, count(DISTINCT CASE WHEN s.canonical IS NOT NULL THEN (d.id, s.canonical) END) AS findings, max(CASE WHEN s.severity IS NOT NULL THEN {RISK_RANK.format('s.severity')} END) AS worst
 FROM (SELECT *, row_number() OVER () AS id FROM fx_dependencies) d LEFT JOIN hits h ON h.analysis_id = d.analysis_id AND h.ecosystem = d.ecosystem AND h.package_name = d.package_name AND h.version = d.version AND h.source_file = d.source_file AND h.scope = d.scope LEFT JOIN sev s ON s.identifier = h.identifier GROUP BY 1)
 SELECT a.analysis_id, a.repository_id, coalesce(dependencies, 0) AS dependencies, coalesce(vulnerable, 0) AS vulnerable, coalesce(findings, 0) AS findings, CASE WHEN worst IS NULL THEN 'NONE' ELSE CASE worst WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 1 THEN 'UNKNOWN' END END AS overall_risk
 FROM fx_analyses a LEFT JOIN f ON f.analysis_id = a.analysis_id"""


@query("fleet_risk", ctes("fx_dependencies", "fx_advisories", "fx_analyses") + FLEET_SQL)
def fleet_risk(spark, d):
    return fleet.fleet_risk(fleet.dependencies(spark, d), fixture(spark, d, "fx_analyses"), fleet.hits(spark, d), fleet.run(spark, d).table("hot"))
