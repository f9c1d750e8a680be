"""Queries of source-usage evidence (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.matching import FINDINGS
from fleetlens.catalog.sqlparts import HITS, norm
from fleetlens.functions import text as T
from fleetlens.operators import usage as U
from fleetlens.plans import fleet
from fleetlens.plans.bindings import ctes, fixture
from fleetlens.session import cut_lineage

GROUP = Group()
query = GROUP.query


def _packages(spark, d):
    """Wanted packages per repository: what the repository's analyses depend on."""
    return fixture(spark, d, "fx_package_scopes").select("repository_id", "ecosystem", "package_name").distinct()


_WANTED = "wanted AS (SELECT DISTINCT a.repository_id, d.ecosystem, d.package_name FROM fx_dependencies d JOIN fx_analyses a ON a.analysis_id = d.analysis_id)"
_BASE = "lower(regexp_replace(package_name, '[-.]+', '_', 'g'))"


@query(
    "import_name_candidates",
    ctes("fx_dependencies")
    + f""", p AS (SELECT DISTINCT ecosystem, package_name FROM fx_dependencies)
 SELECT ecosystem, package_name, 0 AS position, CASE WHEN ecosystem = 'npm' THEN package_name ELSE {_BASE} END AS import_name FROM p UNION ALL SELECT ecosystem, package_name, 1, substr({_BASE}, 8) FROM p WHERE ecosystem = 'PyPI' AND {_BASE} LIKE 'python\\_%' ESCAPE '\\'""",
)
def _candidates(spark, d):
    packages = fixture(spark, d, "fx_dependencies").select("ecosystem", "package_name").distinct()
    return U.import_name_candidates(packages)


@query(
    "name_variants",
    ctes("fx_dependencies")
    + f""", p AS (SELECT DISTINCT ecosystem, package_name FROM fx_dependencies), c AS (SELECT ecosystem, package_name, CASE WHEN ecosystem = 'npm' THEN package_name ELSE {_BASE} END AS n FROM p UNION SELECT ecosystem, package_name, substr({_BASE}, 8) FROM p WHERE ecosystem = 'PyPI' AND {_BASE} LIKE 'python\\_%' ESCAPE '\\')
 SELECT ecosystem, package_name, n AS import_name FROM c UNION SELECT ecosystem, package_name, upper(left(n, 1)) || substr(n, 2) FROM c WHERE ecosystem = 'PyPI' UNION SELECT ecosystem, package_name, regexp_replace(package_name, '[-.]+', '_', 'g') FROM c WHERE ecosystem = 'PyPI'""",
)
def _variants(spark, d):
    packages = fixture(spark, d, "fx_dependencies").select("ecosystem", "package_name").distinct()
    return U.name_variants(U.import_name_candidates(packages))


def _names(spark, d):
    return U.name_variants(U.import_name_candidates(_packages(spark, d)))


# module of a line: import X / from X.core / import os, X as z; comments are no use
_MOD = "CASE WHEN text LIKE 'import os, %' THEN regexp_extract(text, '^import os, (\\w+)', 1) WHEN text LIKE 'import %' THEN regexp_extract(text, '^import (\\w+)', 1) WHEN text LIKE 'from %' THEN regexp_extract(text, '^from (\\w+)', 1) END"
_SPELL = f"""c AS (SELECT repository_id, package_name, lower(regexp_replace(package_name, '[-.]+', '_', 'g')) AS n FROM wanted WHERE ecosystem = 'PyPI'),
 spelled AS (SELECT * FROM c UNION SELECT repository_id, package_name, substr(n, 8) FROM c WHERE n LIKE 'python\\_%' ESCAPE '\\' UNION SELECT repository_id, package_name, upper(left(n, 1)) || substr(n, 2) FROM c UNION SELECT repository_id, package_name, upper(substr(n, 8, 1)) || substr(n, 9) FROM c WHERE n LIKE 'python\\_%' ESCAPE '\\' UNION SELECT repository_id, package_name, regexp_replace(package_name, '[-.]+', '_', 'g') FROM wanted WHERE ecosystem = 'PyPI')"""
_PYREFS = f"""{_WANTED}, {_SPELL}, refs AS (SELECT DISTINCT l.repository_id, l.path, l.line_no, s.package_name, 'PyPI' AS ecosystem FROM (SELECT *, {_MOD} AS module FROM fx_lines) l JOIN spelled s ON s.repository_id = l.repository_id AND s.n = l.module)"""
_PY = ctes("fx_lines", "fx_dependencies", "fx_analyses")


@query("match_python_imports", _PY + f", {_PYREFS} SELECT * FROM refs")
def _python(spark, d):
    refs = U.match_python_imports(fixture(spark, d, "fx_lines"), _names(spark, d))
    return refs.select("repository_id", "path", "line_no", "package_name", "ecosystem")


@query(
    "match_js_imports",
    ctes("fx_js_lines", "fx_dependencies", "fx_analyses")
    + f", {_WANTED} SELECT DISTINCT l.repository_id, l.path, l.line_no, w.package_name FROM fx_js_lines l JOIN wanted w ON w.repository_id = l.repository_id AND w.ecosystem = 'npm' AND w.package_name = l.pkg WHERE line_no % 6 IN (0, 3)",
)
def _js(spark, d):
    refs = U.match_js_imports(fixture(spark, d, "fx_js_lines"), _names(spark, d))
    return refs.select("repository_id", "path", "line_no", "package_name")


@query(
    "drop_comment_lines",
    ctes("fx_lines", "fx_js_lines")
    + " SELECT 'python' AS lang, count(*) AS n FROM fx_lines WHERE text NOT LIKE '#%' UNION ALL SELECT 'js', count(*) FROM fx_js_lines WHERE text NOT LIKE '//%'",
)
def _comments(spark, d):
    py = U.drop_comment_lines(fixture(spark, d, "fx_lines"), "PyPI").select(F.lit("python").alias("lang"))
    js = U.drop_comment_lines(fixture(spark, d, "fx_js_lines"), "npm").select(F.lit("js").alias("lang"))
    return py.unionByName(js).groupBy("lang").agg(F.count("*").alias("n"))


def _own(spark, d, name):
    """Each file's own package is wanted in its repository."""
    return fixture(spark, d, name).select("repository_id", F.lit("PyPI").alias("ecosystem"), F.col("pkg").alias("package_name")).distinct()


@query(
    "match_requirement_lines",
    ctes("fx_requirement_files") + " SELECT DISTINCT repository_id, path, 2 AS line_no, pkg AS package_name FROM fx_requirement_files",
)
def _requirement(spark, d):
    lines = T.explode_lines(fixture(spark, d, "fx_requirement_files").select("repository_id", "path", "content"))
    refs = U.match_requirement_lines(lines, _own(spark, d, "fx_requirement_files"))
    return refs.select("repository_id", "path", "line_no", "package_name").distinct()


def _manifest_lines(spark, d, kind):
    rows = fixture(spark, d, "fx_token_manifests").filter(F.col("kind").isin(kind))
    return T.explode_lines(rows.select("repository_id", "path", "content"))


_TOKENS = ctes("fx_token_manifests")


@query(
    "match_toml_manifest",
    _TOKENS + " SELECT repository_id, path, unnest([4, 9]) AS line_no, pkg AS package_name FROM fx_token_manifests WHERE kind = 'toml'",
)
def _toml(spark, d):
    refs = U.match_toml_manifest(_manifest_lines(spark, d, ["toml"]), _own(spark, d, "fx_token_manifests"))
    return refs.select("repository_id", "path", "line_no", "package_name")


@query(
    "match_setup_manifests",
    _TOKENS
    + " SELECT repository_id, path, unnest([3, 5]) AS line_no, pkg AS package_name FROM fx_token_manifests WHERE kind = 'py' UNION ALL SELECT repository_id, path, unnest([3, 7]), pkg FROM fx_token_manifests WHERE kind = 'cfg'",
)
def _setup(spark, d):
    refs = U.match_setup_manifests(_manifest_lines(spark, d, ["py", "cfg"]), _own(spark, d, "fx_token_manifests"))
    return refs.select("repository_id", "path", "line_no", "package_name")


@query(
    "match_package_json_lines",
    ctes("fx_package_json")
    + " SELECT repository_id, path, 2 AS line_no, 'p' || part AS package_name FROM fx_package_json UNION SELECT repository_id, path, 5, 'd' || part FROM fx_package_json",
)
def _package_json(spark, d):
    files = fixture(spark, d, "fx_package_json")
    pretty = F.regexp_replace("content", r"[{,] *", "$0\n")
    lines = T.explode_lines(files.select("repository_id", "path", pretty.alias("content")))
    # the manifest breaks after every brace and comma: p on one line, d three lines below
    wanted = files.select(
        "repository_id", F.lit("npm").alias("ecosystem"), F.explode(F.array(F.concat(F.lit("p"), "part"), F.concat(F.lit("d"), "part"))).alias("package_name")
    ).distinct()
    refs = U.match_package_json_lines(lines, wanted)
    first = refs.groupBy("repository_id", "path").agg(F.min("line_no").alias("first"))
    return refs.join(first, ["repository_id", "path"]).select(
        "repository_id", "path", (F.col("line_no") - F.col("first") + 2).alias("line_no"), "package_name"
    ).distinct()


_PAIRS = """fl AS (SELECT DISTINCT repository_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir FROM fx_lines), real AS (SELECT repository_id, path AS component FROM fx_components WHERE path <> '.'),
 pairs AS (SELECT repository_id, path, '.' AS component FROM fl WHERE dir = '' UNION SELECT f.repository_id, f.path, r.component FROM fl f JOIN real r ON r.repository_id = f.repository_id AND f.dir <> '' AND (f.dir = r.component OR f.dir LIKE r.component || '/%')
  UNION SELECT repository_id, path, split_part(dir, '/', 1) FROM fl f WHERE dir <> '' AND NOT EXISTS (SELECT 1 FROM real r WHERE r.repository_id = f.repository_id))"""


def _pairs(spark, d):
    return U.map_components(fixture(spark, d, "fx_lines"), fixture(spark, d, "fx_components"))


@query("map_components", ctes("fx_lines", "fx_components") + f", {_PAIRS} SELECT * FROM pairs")
def _map_components(spark, d):
    return _pairs(spark, d)


def evidence_of(spark, d, wanted):
    """Evidence of (repository_id, ecosystem, package_name) from the searched files of both ecosystems."""
    lines, wanted = U.by_reader(fixture(spark, d, "fx_source_lines")), U.with_names(wanted)
    refs = cut_lineage(U.match_usage(lines, wanted))  # parsed once, read by every aggregate
    pairs = U.map_components(refs, fixture(spark, d, "fx_components"))
    return U.usage_evidence(wanted, refs, pairs, U.scan_summary(fixture(spark, d, "fx_scan_files", fx_source_lines=lines)))


EVIDENCE_TABLES = ["fx_source_lines", "fx_scan_files", "fx_dependencies", "fx_analyses", "fx_components"]
#: ``evs``, the evidence of the CTE ``wanted`` (repository_id, ecosystem, package_name)
EVIDENCE = f"""{_SPELL}, m AS (SELECT DISTINCT repository_id, path, line_no, ecosystem, pkg, replace(pkg, '-', '_') AS module, CASE WHEN line_no = 6 THEN 'config' WHEN line_no % 4 IN (0, 1) THEN 'import' END AS kind FROM fx_source_lines),
 refs AS (SELECT m.repository_id, m.path, m.line_no, m.kind, 'PyPI' AS ecosystem, s.package_name FROM m JOIN spelled s ON s.repository_id = m.repository_id AND s.n = m.module WHERE m.ecosystem = 'PyPI' AND m.kind = 'import'
  UNION SELECT m.repository_id, m.path, m.line_no, m.kind, w.ecosystem, w.package_name FROM m JOIN wanted w ON w.repository_id = m.repository_id AND w.ecosystem = m.ecosystem AND w.package_name = m.pkg WHERE m.ecosystem = 'npm' AND m.kind IS NOT NULL
  UNION SELECT m.repository_id, m.path, m.line_no, m.kind, w.ecosystem, w.package_name FROM m JOIN wanted w ON w.repository_id = m.repository_id AND w.ecosystem = m.ecosystem AND {norm('w.package_name', 'w.ecosystem')} = {norm('m.pkg', 'm.ecosystem')} WHERE m.ecosystem = 'PyPI' AND m.kind = 'config'),
 {_PAIRS.replace('fx_lines', 'fx_source_lines')},
 scan AS (SELECT repository_id, count(DISTINCT path) FILTER (ok AND NOT is_too_large) AS scanned_files, count(DISTINCT path) FILTER (ok AND is_too_large) AS skipped FROM (SELECT *, path NOT LIKE 'node_modules/%' AND path NOT LIKE '%.md' AS ok FROM fx_scan_files) s GROUP BY 1),
 ev AS (SELECT w.repository_id, w.ecosystem, w.package_name, count(DISTINCT (r.path, r.line_no)) FILTER (r.path IS NOT NULL) AS n_references, count(DISTINCT (r.path, r.line_no)) FILTER (r.kind = 'config') AS n_config, count(DISTINCT r.path) FILTER (r.kind = 'import') AS total_files,
  coalesce(string_agg(DISTINCT p.component, ',' ORDER BY p.component) FILTER (r.kind = 'import'), '') AS components, coalesce(min(r.path) FILTER (r.kind = 'import'), '') AS first_file FROM wanted w LEFT JOIN refs r ON r.repository_id = w.repository_id AND r.ecosystem = w.ecosystem AND r.package_name = w.package_name LEFT JOIN pairs p ON p.repository_id = r.repository_id AND p.path = r.path GROUP BY 1, 2, 3),
 evs AS (SELECT ev.*, coalesce(s.scanned_files, 0) AS scanned_files, coalesce(s.skipped, 0) AS skipped_files_total, s.repository_id IS NOT NULL AS analysed, s.repository_id IS NULL OR s.skipped > 0 AS truncated FROM ev LEFT JOIN scan s ON s.repository_id = ev.repository_id)"""
_EV = ctes(*EVIDENCE_TABLES) + f", {_WANTED}, {EVIDENCE}"


@query("usage_evidence", _EV + " SELECT * FROM evs")
def _usage_evidence(spark, d):
    return evidence_of(spark, d, cut_lineage(_packages(spark, d))).select(
        "repository_id", "ecosystem", "package_name", "n_references", "n_config", "total_files", F.array_join("components", ",").alias("components"),
        F.coalesce(F.get("files", F.lit(0)), F.lit("")).alias("first_file"), "scanned_files", "skipped_files_total", "analysed", "truncated",
    )


def _files(spark, d):
    return fixture(spark, d, "fx_paths").withColumn("is_too_large", F.col("file_id") % 5 == 0)


@query(
    "skipped_files",
    ctes("fx_paths")
    + """ SELECT repository_id, count(*) AS skipped_files_total, string_agg(path, ',' ORDER BY path) AS skipped_files FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS rn FROM (SELECT DISTINCT repository_id, path FROM fx_paths WHERE file_id % 5 = 0) s) t GROUP BY 1""",
)
def _skipped(spark, d):
    rows = U.skipped_files(_files(spark, d))
    return rows.select("repository_id", "skipped_files_total", F.array_join("skipped_files", ",").alias("skipped_files"))


@query(
    "file_cap",
    ctes("fx_lines")
    + " SELECT repository_id, path, files > 3 AS is_capped FROM (SELECT repository_id, path, row_number() OVER (PARTITION BY repository_id ORDER BY path) AS rn, count(*) OVER (PARTITION BY repository_id) AS files FROM (SELECT DISTINCT repository_id, path FROM fx_lines) s) t WHERE rn <= 3",
)
def _file_cap(spark, d):
    files = fixture(spark, d, "fx_lines").select("repository_id", "path").distinct()
    kept, over = U.file_cap(files, 3)
    return kept.join(over, "repository_id").select("repository_id", "path", "is_capped")


VERDICT = """CASE WHEN total_files > 0 THEN 'used' WHEN NOT analysed THEN 'not-analysed' WHEN scope = 'transitive' THEN 'beyond-depth' WHEN truncated THEN 'scan-incomplete' WHEN scope <> 'direct' THEN 'unknown-scope' ELSE 'no-direct-import' END"""


@query(
    "usage_verdict",
    _EV
    + f""", s AS (SELECT DISTINCT a.repository_id, d.ecosystem, d.package_name, d.scope FROM fx_dependencies d JOIN fx_analyses a ON a.analysis_id = d.analysis_id)
 SELECT s.ecosystem, {VERDICT} AS kind, count(*) AS n FROM s JOIN evs ON evs.repository_id = s.repository_id AND evs.ecosystem = s.ecosystem AND evs.package_name = s.package_name GROUP BY 1, 2""",
)
def _verdict(spark, d):
    # stored: the packages to search for and the rows to judge come from the same distinct rows
    rows = cut_lineage(fixture(spark, d, "fx_package_scopes").distinct())
    evidence = evidence_of(spark, d, rows.select("repository_id", "ecosystem", "package_name"))
    rows = rows.join(evidence, ["repository_id", "ecosystem", "package_name"], "left")
    verdict = U.usage_verdict(
        F.col("total_files"), F.col("truncated"), F.col("skipped_files_total"), F.col("scope"), F.col("analysed")
    )
    return rows.groupBy("ecosystem", verdict["kind"].alias("kind")).agg(F.count("*").alias("n"))


#: wanted: the packages of the findings under their normalised names
WANTED_BY_FINDINGS = "wanted AS (SELECT DISTINCT a.repository_id, f.ecosystem, f.norm_name AS package_name FROM findings f JOIN fx_analyses a ON a.analysis_id = f.analysis_id)"


@query(
    "attach_usage",
    ctes(*EVIDENCE_TABLES, "fx_advisories")
    + f""", {HITS}, {FINDINGS}, {WANTED_BY_FINDINGS}, {EVIDENCE}, counted AS (SELECT repository_id, count(*) FILTER (analysed) AS dependencies_scanned, count(*) FILTER (total_files > 0) AS with_source_references FROM evs GROUP BY 1),
 used AS (SELECT a.repository_id, count(*) AS findings, count(*) FILTER (e.total_files > 0) AS findings_in_use FROM findings f JOIN fx_analyses a ON a.analysis_id = f.analysis_id JOIN evs e ON e.repository_id = a.repository_id AND e.ecosystem = f.ecosystem AND e.package_name = f.norm_name GROUP BY 1)
 SELECT counted.*, findings, findings_in_use FROM counted JOIN used ON used.repository_id = counted.repository_id""",
)
def _attach(spark, d):
    findings = fleet.findings(spark, d).select("analysis_id", "ecosystem", "norm_name", "identifier")
    analyses = fixture(spark, d, "fx_analyses").select("analysis_id", "repository_id")
    rows = cut_lineage(findings.join(analyses, "analysis_id"))
    wanted = rows.select("repository_id", "ecosystem", F.col("norm_name").alias("package_name")).distinct()
    evidence = cut_lineage(evidence_of(spark, d, wanted).withColumnRenamed("package_name", "norm_name"))
    attached, counts = U.attach_usage(rows, evidence, ["repository_id", "ecosystem", "norm_name"])
    used = attached.groupBy("repository_id").agg(F.count("*").alias("findings"), F.count_if(F.col("total_files") > 0).alias("findings_in_use"))
    return counts.join(used, "repository_id")
