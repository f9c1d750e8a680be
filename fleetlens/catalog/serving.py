"""Read-side queries (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.matching import FINDINGS, _STATUS
from fleetlens.catalog.risk import _FID
from fleetlens.catalog.sqlparts import HITS, band, cvss
from fleetlens.plans import fleet
from fleetlens.plans import serving as M
from fleetlens.plans.bindings import ctes, fixture
from fleetlens.session import cut_lineage

GROUP = Group()
query = GROUP.query

_AN = ctes("fx_analyses")
_ALL = ctes("fx_dependencies", "fx_advisories", "fx_analyses", "fx_repositories") + f", {_STATUS}, {FINDINGS}"
_SNAP = "snap AS (SELECT repository_id, analysis_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY CASE WHEN status = 'COMPLETED' THEN 0 ELSE 1 END, analysis_id DESC) AS rn FROM fx_analyses) s WHERE rn = 1)"
_LATEST = "latest AS (SELECT repository_id, analysis_id, status FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY analysis_id DESC) AS rn FROM fx_analyses) s WHERE rn = 1)"
_DC = "dc AS (SELECT analysis_id, count(*) AS dependencies_count, count(*) FILTER (vulnerability_status = 'VULNERABLE') AS vulnerable_count FROM classified GROUP BY 1)"


def _analyses(spark, d):
    return fixture(spark, d, "fx_analyses")


def _findings(spark, d):
    return fleet.findings(spark, d).withColumn("finding_id", F.expr(_FID))


def _newest(tie="finding_id"):
    return [F.desc("analysis_id"), F.asc(tie), F.asc("identifier")]


@query("latest_analysis", _AN + f", {_LATEST} SELECT * FROM latest")
def _latest(spark, d):
    return M.latest_analysis(_analyses(spark, d))


@query("snapshot_analysis", _AN + f", {_SNAP} SELECT * FROM snap")
def _snapshot(spark, d):
    return M.snapshot_analysis(_analyses(spark, d))


@query(
    "dependency_counts",
    _ALL + f", {_SNAP}, {_DC} SELECT s.repository_id, s.analysis_id, coalesce(dependencies_count, 0) AS dependencies_count, coalesce(vulnerable_count, 0) AS vulnerable_count FROM snap s LEFT JOIN dc ON dc.analysis_id = s.analysis_id",
)
def _counts(spark, d):
    return M.dependency_counts(M.snapshot_analysis(_analyses(spark, d)), fleet.classified(spark, d)).drop("status")


@query(
    "analysis_summary",
    _ALL
    + " SELECT a.analysis_id, a.status, coalesce(f.n, 0) AS findings_count, coalesce(c.n, 0) AS dependencies_count FROM fx_analyses a LEFT JOIN (SELECT analysis_id, count(*) AS n FROM findings GROUP BY 1) f ON f.analysis_id = a.analysis_id LEFT JOIN (SELECT analysis_id, count(*) AS n FROM fx_dependencies GROUP BY 1) c ON c.analysis_id = a.analysis_id",
)
def _analysis_summary(spark, d):
    rows = M.analysis_summary(_analyses(spark, d), fleet.findings(spark, d), fixture(spark, d, "fx_dependencies"))
    return rows.select("analysis_id", "status", "findings_count", "dependencies_count")


@query(
    "repository_summary",
    _ALL
    + f", {_SNAP}, {_LATEST}, {_DC} SELECT r.repository_id, r.name, l.analysis_id AS latest_analysis_id, l.status AS latest_status, coalesce(dependencies_count, 0) AS dependencies_count, coalesce(vulnerable_count, 0) AS vulnerable_count FROM fx_repositories r LEFT JOIN latest l ON l.repository_id = r.repository_id LEFT JOIN snap s ON s.repository_id = r.repository_id LEFT JOIN dc ON dc.analysis_id = s.analysis_id",
)
def _repository_summary(spark, d):
    rows = M.repository_summary(fixture(spark, d, "fx_repositories"), _analyses(spark, d), fleet.classified(spark, d))
    return rows.select("repository_id", "name", "latest_analysis_id", "latest_status", "dependencies_count", "vulnerable_count")


@query("findings_by_risk", _ALL + " SELECT coalesce(risk_level, 'UNKNOWN') AS risk_level, count(*) AS n FROM findings GROUP BY 1")
def _by_risk(spark, d):
    return M.findings_by_risk(fleet.findings(spark, d))


@query(
    "dashboard_totals",
    ctes("fx_dependencies", "fx_advisories", "fx_analyses", "fx_repositories", "fx_remediations")
    + f""", {_STATUS}, {FINDINGS}, {_SNAP}, {_DC} SELECT (SELECT count(*) FROM fx_repositories) AS repositories, (SELECT count(*) FROM fx_analyses) AS analyses, (SELECT count(*) FROM findings) AS findings, (SELECT count(*) FROM fx_remediations) AS remediations,
 (SELECT sum(dependencies_count) FROM snap s JOIN dc ON dc.analysis_id = s.analysis_id) AS dependencies, (SELECT sum(vulnerable_count) FROM snap s JOIN dc ON dc.analysis_id = s.analysis_id) AS vulnerable_dependencies""",
)
def _dashboard(spark, d):
    counts = {
        "repositories": fixture(spark, d, "fx_repositories"),
        "analyses": _analyses(spark, d),
        "findings": fleet.findings(spark, d),
        "remediations": fixture(spark, d, "fx_remediations"),
    }
    return M.dashboard_totals(counts, M.snapshot_analysis(_analyses(spark, d)), fleet.classified(spark, d))


@query("recent_analyses", _AN + " SELECT analysis_id, repository_id, status FROM fx_analyses ORDER BY analysis_id DESC LIMIT 10")
def _recent(spark, d):
    return M.recent_analyses(_analyses(spark, d)).select("analysis_id", "repository_id", "status")


@query(
    "high_risk_findings",
    _ALL
    + f" SELECT analysis_id, identifier, finding_id, risk_level FROM (SELECT *, {_FID} AS finding_id FROM findings) f WHERE risk_level IN ('CRITICAL', 'HIGH') ORDER BY analysis_id DESC, finding_id, identifier LIMIT 10",
)
def _high_risk(spark, d):
    return M.high_risk_findings(_findings(spark, d), _newest()).select("analysis_id", "identifier", "finding_id", "risk_level")


@query(
    "list_findings",
    _ALL
    + f" SELECT analysis_id, identifier, finding_id, risk_level FROM (SELECT *, {_FID} AS finding_id FROM findings) f WHERE risk_level = 'MEDIUM' ORDER BY analysis_id DESC, finding_id, identifier LIMIT 100",
)
def _list(spark, d):
    rows = M.list_findings(_findings(spark, d), _newest(), risk_level="medium", limit=100)
    return rows.select("analysis_id", "identifier", "finding_id", "risk_level")


@query(
    "repository_dependencies",
    _ALL
    + f", {_SNAP} SELECT s.repository_id, c.ecosystem, c.package_name, c.version, c.source_file, c.scope FROM classified c JOIN snap s ON s.analysis_id = c.analysis_id WHERE vulnerability_status = 'VULNERABLE'",
)
def _repo_deps(spark, d):
    rows = M.repository_dependencies(_analyses(spark, d), fleet.classified(spark, d), "vulnerable")
    return rows.select("repository_id", "ecosystem", "package_name", "version", "source_file", "scope")


@query(
    "repository_findings",
    _ALL + f", {_SNAP} SELECT s.repository_id, f.analysis_id, {_FID} AS finding_id, f.identifier, f.severity FROM findings f JOIN snap s ON s.analysis_id = f.analysis_id",
)
def _repo_findings(spark, d):
    rows = M.repository_findings(_analyses(spark, d), _findings(spark, d))
    return rows.select("repository_id", "analysis_id", "finding_id", "identifier", "severity")


_IDS = ctes("fx_dep_ids", "fx_named_relations", "fx_dependencies", "fx_advisories")


@query(
    "dependency_detail",
    _IDS
    + f""", {HITS}, {FINDINGS}, ids AS (SELECT analysis_id, ecosystem, norm_name, version, min(dependency_id) AS id FROM fx_dep_ids GROUP BY 1, 2, 3, 4),
 ed AS (SELECT DISTINCT p.analysis_id, p.id AS pid, p.norm_name || '@' || coalesce(p.version, '?') AS pl, c.id AS cid, c.norm_name || '@' || coalesce(c.version, '?') AS cl FROM fx_named_relations r JOIN ids p ON p.analysis_id = r.analysis_id AND p.ecosystem = r.ecosystem AND p.norm_name = r.parent_name AND p.version IS NOT DISTINCT FROM r.parent_version
  JOIN ids c ON c.analysis_id = r.analysis_id AND c.ecosystem = r.ecosystem AND c.norm_name = r.child_name AND c.version IS NOT DISTINCT FROM r.child_version WHERE p.id <> c.id),
 fs AS (SELECT analysis_id, ecosystem, norm_name, version, count(*) AS n, string_agg(DISTINCT identifier, ',' ORDER BY identifier) AS v FROM findings GROUP BY 1, 2, 3, 4)
 SELECT i.analysis_id, i.id AS dependency_id, coalesce(fs.n, 0) AS findings, coalesce(fs.v, '') AS vulnerabilities, coalesce((SELECT string_agg(DISTINCT cl, ',' ORDER BY cl) FROM ed WHERE ed.analysis_id = i.analysis_id AND pid = i.id), '') AS depends_on, coalesce((SELECT string_agg(DISTINCT pl, ',' ORDER BY pl) FROM ed WHERE ed.analysis_id = i.analysis_id AND cid = i.id), '') AS depended_on_by
 FROM ids i LEFT JOIN fs ON fs.analysis_id = i.analysis_id AND fs.ecosystem = i.ecosystem AND fs.norm_name = i.norm_name AND fs.version = i.version""",
)
def _detail(spark, d):
    from fleetlens.operators.dependencies import IDENTITY, resolve_relations

    ids = fixture(spark, d, "fx_dep_ids").groupBy(*IDENTITY).agg(F.min("dependency_id").alias("id"))
    # the ids of the test tables repeat between analyses: make them global
    deps = ids.select(*IDENTITY, F.concat_ws("|", "analysis_id", "id").alias("dependency_id"), "id", F.col("norm_name").alias("package_name"))
    # both directions read the edges, and every label comes from the dependencies: each is made once
    deps = cut_lineage(deps)
    edges, _ = resolve_relations(fixture(spark, d, "fx_named_relations"), fixture(spark, d, "fx_dep_ids"))
    edges = edges.select(F.concat_ws("|", "analysis_id", "parent_id").alias("parent_id"), F.concat_ws("|", "analysis_id", "child_id").alias("child_id"))
    edges = cut_lineage(edges)
    rows = M.dependency_detail(deps, fleet.findings(spark, d), edges, IDENTITY)
    return rows.select(
        "analysis_id", F.col("id").alias("dependency_id"), F.col("findings").cast("bigint").alias("findings"),
        *[F.array_join(c, ",").alias(c) for c in ("vulnerabilities", "depends_on", "depended_on_by")],
    )


@query(
    "vulnerability_lookup",
    ctes("fx_advisories") + f" SELECT identifier, {band(cvss())} AS severity, {cvss()} AS cvss_score, fixed FROM fx_advisories WHERE identifier = 'GHSA-99' OR regexp_extract(identifier, '-(\\d+)$', 1) = '77'",
)
def _lookup(spark, d):
    advisories = fleet.scored_advisories(spark, d).withColumn("vulnerability_id", F.substring_index("identifier", "-", -1).cast("bigint"))
    both = M.vulnerability_lookup(advisories, "GHSA-99").unionByName(M.vulnerability_lookup(advisories, row_id=77))
    return both.select("identifier", "severity", "cvss_score", "fixed")


@query(
    "duplicate_repositories",
    ctes("fx_repositories")
    + """ SELECT repository_id, min(other) AS duplicate_of FROM (
  SELECT a.repository_id, CASE WHEN a.source_type <> 'local' AND a.branch IS NOT NULL AND EXISTS (SELECT 1 FROM fx_repositories n WHERE n.branch IS NULL AND n.source_type = a.source_type AND lower(n.source_url) = lower(a.source_url) AND n.repository_id < a.repository_id)
   THEN (SELECT min(n.repository_id) FROM fx_repositories n WHERE n.branch IS NULL AND n.source_type = a.source_type AND lower(n.source_url) = lower(a.source_url)) ELSE b.repository_id END AS other
  FROM fx_repositories a JOIN fx_repositories b ON lower(a.source_url) = lower(b.source_url) AND a.source_type = b.source_type AND b.repository_id < a.repository_id AND (a.source_type = 'local' OR a.branch IS NULL OR b.branch IS NULL OR a.branch = b.branch)) s GROUP BY 1""",
)
def _duplicates(spark, d):
    return M.duplicate_repositories(fixture(spark, d, "fx_repositories"))


@query(
    "cascade_delete",
    _ALL
    + """, gone AS (SELECT repository_id FROM fx_repositories WHERE name LIKE '%7'), an AS (SELECT * FROM fx_analyses WHERE repository_id IN (SELECT repository_id FROM fx_repositories) AND repository_id NOT IN (SELECT repository_id FROM gone))
 SELECT 'repositories' AS table_name, count(*) AS n FROM fx_repositories WHERE name NOT LIKE '%7' UNION ALL SELECT 'analyses', count(*) FROM an UNION ALL SELECT 'dependencies', count(*) FROM fx_dependencies WHERE analysis_id IN (SELECT analysis_id FROM an) UNION ALL SELECT 'findings', count(*) FROM findings WHERE analysis_id IN (SELECT analysis_id FROM an)""",
)
def _cascade(spark, d):
    repositories = fixture(spark, d, "fx_repositories")
    tables = {
        "repositories": (repositories, "repository_id", None),
        "analyses": (_analyses(spark, d), "repository_id", "repositories"),
        "dependencies": (fixture(spark, d, "fx_dependencies"), "analysis_id", "analyses"),
        "findings": (fleet.findings(spark, d), "analysis_id", "analyses"),
    }
    kept = M.cascade_delete(tables, repositories.filter("name LIKE '%7'"))
    rows = None
    for name, frame in kept.items():
        part = frame.groupBy().agg(F.lit(name).alias("table_name"), F.count("*").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows
