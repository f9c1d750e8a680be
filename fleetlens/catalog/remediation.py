"""Queries of upgrade selection and manifest rewriting (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.matching import FINDINGS, _canon
from fleetlens.catalog.sqlparts import HITS, major, norm, vkey
from fleetlens.functions import versions as V
from fleetlens.operators import matching as M
from fleetlens.operators import remediate as K
from fleetlens.plans import fleet
from fleetlens.plans.bindings import ctes, fixture

GROUP = Group()
query = GROUP.query

_BASE = ctes("fx_dependencies", "fx_advisories", "fx_releases")
DEPENDENCY = ["analysis_id", *M.LOOKUP, "source_file"]


@query(
    "vulnerabilities_of_dependency",
    ctes("fx_dependencies", "fx_advisories")
    + f""", {HITS}, {FINDINGS}, g AS (SELECT analysis_id, ecosystem, norm_name, version, source_file, list_sort(list(identifier)) AS l FROM findings GROUP BY 1, 2, 3, 4, 5)
 SELECT f.analysis_id, f.ecosystem, f.norm_name, f.version, f.source_file, f.identifier, array_to_string(list_prepend(f.identifier, list_filter(g.l, lambda x: x <> f.identifier)), ',') AS identifiers FROM findings f JOIN g ON g.analysis_id = f.analysis_id AND g.ecosystem = f.ecosystem AND g.norm_name = f.norm_name AND g.version = f.version AND g.source_file = f.source_file""",
)
def _vulns(spark, d):
    rows = K.vulnerabilities_of_dependency(fleet.findings(spark, d), DEPENDENCY)
    return rows.select(*DEPENDENCY, "identifier", F.array_join("identifiers", ",").alias("identifiers"))


_SAME = "{0}.ecosystem = {1}.ecosystem AND {0}.norm_name = {1}.norm_name"
# intervals and safe fixes of merged advisories, the issues that a version has and the smallest fix of each above it
_ISSUES = f"""{HITS}, {_canon('canon')}, lh AS (SELECT DISTINCT h.ecosystem, h.norm_name, h.version, c.canonical AS identifier FROM hits h JOIN canon c ON c.identifier = h.identifier),
 adv AS (SELECT DISTINCT c.canonical AS identifier, a.ecosystem, {norm('a.package_name', 'a.ecosystem')} AS norm_name, a.introduced, a.fixed, {vkey('a.introduced')} AS ki, {vkey('a.fixed')} AS kf FROM fx_advisories a JOIN canon c ON c.identifier = a.identifier),
 fix AS (SELECT DISTINCT identifier, ecosystem, norm_name, fixed, kf AS k FROM adv f WHERE kf IS NOT NULL AND NOT EXISTS (SELECT 1 FROM adv o WHERE o.identifier = f.identifier AND {_SAME.format('o', 'f')} AND o.fixed IS DISTINCT FROM f.fixed AND f.kf >= o.ki AND (o.fixed IS NULL OR f.kf < o.kf)))"""
_NEXT = "SELECT {0}, arg_max(fixed, k) AS floor, count(*) AS fixable FROM (SELECT {1}, arg_min(f.fixed, f.k) AS fixed, min(f.k) AS k FROM {2} l JOIN fix f ON f.identifier = l.identifier AND " + _SAME.format("f", "l") + " AND f.k > {3} GROUP BY ALL) x GROUP BY ALL"
_LH = "l.ecosystem, l.norm_name, l.version, l.identifier"
_FLOORS = f"{_ISSUES}, floors AS ({_NEXT.format('ecosystem, norm_name, version', _LH, 'lh', vkey('l.version'))})"
_REL = f"""inst AS (SELECT DISTINCT ecosystem, {norm()} AS norm_name, version, {vkey()} AS k, version NOT LIKE '%-rc%' AS stable, {major()} AS major FROM fx_releases WHERE NOT withdrawn),
 latest AS (SELECT ecosystem, norm_name, arg_max(version, k) AS latest FROM inst WHERE stable GROUP BY 1, 2)"""
_SNAP = f"""{_FLOORS}, {_REL}, snapped AS (SELECT f.ecosystem, f.norm_name, f.floor, coalesce(arg_min(i.version, i.k) FILTER (i.k >= {vkey('f.floor')}), f.floor) AS snapped FROM (SELECT DISTINCT ecosystem, norm_name, floor FROM floors) f LEFT JOIN inst i ON i.ecosystem = f.ecosystem AND i.norm_name = f.norm_name AND i.stable GROUP BY 1, 2, 3)"""


def _installable(spark, d):
    return fleet.run(spark, d).table("installable")


def _floors(spark, d):
    return fleet.run(spark, d).table("floors")


@query("minimum_fixed_version", _BASE + f", {_FLOORS} SELECT * FROM floors")
def _minimum(spark, d):
    return _floors(spark, d).drop("floor_rank")


@query(
    "installable_releases",
    _BASE + f", {_REL} SELECT i.ecosystem, i.norm_name, count(*) AS releases, max(latest) AS latest FROM inst i LEFT JOIN latest l ON l.ecosystem = i.ecosystem AND l.norm_name = i.norm_name GROUP BY 1, 2",
)
def _releases(spark, d):
    inst = _installable(spark, d)
    n = inst.groupBy(*K.PACKAGE).agg(F.count("*").alias("releases"))
    return n.join(K.latest_releases(inst), K.PACKAGE, "left")


@query(
    "latest_in_same_major",
    _BASE
    + f""", l AS (SELECT DISTINCT ecosystem, {norm()} AS norm_name, version, {major()} AS major FROM fx_dependencies WHERE {vkey()} IS NOT NULL), {_REL}
 SELECT l.ecosystem, l.norm_name, l.version, arg_max(i.version, i.k) AS latest_same_major FROM l LEFT JOIN inst i ON i.ecosystem = l.ecosystem AND i.norm_name = l.norm_name AND i.major = l.major AND i.stable GROUP BY 1, 2, 3""",
)
def _same_major(spark, d):
    return K.latest_in_same_major(fleet.lookups(spark, d), _installable(spark, d), fleet.run(spark, d).table("index"))


@query("snap_to_release", _BASE + f", {_SNAP} SELECT * FROM snapped")
def _snap(spark, d):
    return K.snap_to_release(_floors(spark, d), fleet.run(spark, d).table("upcoming")).drop("floor_rank", "snapped_rank")


# every place that a candidate can come to, its next one, and the way from each first candidate to its end
_WALK = f"""{_SNAP}, fsnap AS (SELECT f.ecosystem, f.norm_name, f.fixed, coalesce(arg_min(i.version, i.k) FILTER (i.k >= f.k), f.fixed) AS snapped FROM (SELECT DISTINCT ecosystem, norm_name, fixed, k FROM fix) f LEFT JOIN inst i ON {_SAME.format('i', 'f')} AND i.stable GROUP BY 1, 2, 3),
 places AS (SELECT ecosystem, norm_name, snapped AS candidate FROM snapped UNION SELECT ecosystem, norm_name, snapped FROM fsnap),
 found AS (SELECT DISTINCT p.ecosystem, p.norm_name, p.candidate, a.identifier FROM places p JOIN adv a ON {_SAME.format('a', 'p')} AND {vkey('p.candidate')} >= a.ki AND (a.fixed IS NULL OR {vkey('p.candidate')} < a.kf)),
 onward AS ({_NEXT.format('ecosystem, norm_name, candidate', 'l.ecosystem, l.norm_name, l.candidate, l.identifier', 'found', vkey('l.candidate'))}),
 moves AS (SELECT o.ecosystem, o.norm_name, o.candidate, s.snapped FROM onward o JOIN fsnap s ON {_SAME.format('s', 'o')} AND s.fixed = o.floor),
 walk AS (SELECT DISTINCT ecosystem, norm_name, snapped AS start, snapped AS candidate FROM snapped UNION ALL SELECT w.ecosystem, w.norm_name, w.start, m.snapped FROM walk w JOIN moves m ON {_SAME.format('m', 'w')} AND m.candidate = w.candidate),
 ends AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM moves m WHERE {_SAME.format('m', 'w')} AND m.candidate = w.candidate)),
 rest AS (SELECT ecosystem, norm_name, candidate, string_agg(identifier, ',' ORDER BY identifier) AS remaining FROM found GROUP BY 1, 2, 3)"""


@query(
    "verify_candidates",
    (
        _BASE
        + f""", {_WALK} SELECT f.ecosystem, f.norm_name, f.version, e.start AS minimum_fixed_version, e.candidate, r.remaining IS NULL AS verified, coalesce(r.remaining, '') AS remaining FROM floors f JOIN snapped s ON {_SAME.format('s', 'f')} AND s.floor = f.floor
 JOIN ends e ON {_SAME.format('e', 'f')} AND e.start = s.snapped LEFT JOIN rest r ON {_SAME.format('r', 'f')} AND r.candidate = e.candidate"""
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _verify(spark, d):
    rows = _selected(spark, d)
    return rows.select(*M.LOOKUP, "minimum_fixed_version", "candidate", "verified", F.array_join("remaining", ",").alias("remaining"))


def _selected(spark, d):
    own = fleet.run(spark, d)
    return K.select_candidates(*[own.table(t) for t in ("hits", "spans", "fixes", "installable", "index")])


_CHECK = f"""{_SNAP}, cand AS (SELECT f.*, s.snapped AS candidate FROM floors f JOIN snapped s ON s.ecosystem = f.ecosystem AND s.norm_name = f.norm_name AND s.floor = f.floor),
 still AS (SELECT DISTINCT c.ecosystem, c.norm_name, c.candidate, a.identifier FROM cand c JOIN adv a ON a.ecosystem = c.ecosystem AND a.norm_name = c.norm_name AND {vkey('c.candidate')} >= a.ki AND (a.fixed IS NULL OR {vkey('c.candidate')} < a.kf))"""


def _first_round(spark, d):
    """Candidates after one check, before any bump, and the issues that they still have."""
    own = fleet.run(spark, d)
    rows, hits = own.table("candidates"), own.table("candidate_hits")
    bad = hits.select(*K.PACKAGE, "candidate").distinct().withColumn("_bad", F.lit(True))
    rows = rows.join(bad, [*K.PACKAGE, "candidate"], "left").withColumn("verified", F.col("_bad").isNull()).drop("_bad")
    return K.with_latest(rows, own.table("installable"), own.table("index")), hits, own


@query(
    "next_fixed_version",
    _BASE + f", {_CHECK} {_NEXT.format('ecosystem, norm_name, candidate', 'l.ecosystem, l.norm_name, l.candidate, l.identifier', 'still', vkey('l.candidate'))}",
)
def _next(spark, d):
    _, hits, own = _first_round(spark, d)
    return K.next_fixed_version(hits, own.table("fixes")).drop("floor_rank")


_SAFE = f"""{_CHECK}, sm AS (SELECT c.ecosystem, c.norm_name, c.version, arg_max(i.version, i.k) AS same_major_latest FROM cand c LEFT JOIN inst i ON i.ecosystem = c.ecosystem AND i.norm_name = c.norm_name AND i.stable AND i.major = {major('c.version')} GROUP BY 1, 2, 3),
 opts AS (SELECT c.ecosystem, c.norm_name, c.version, c.candidate AS option FROM cand c WHERE NOT EXISTS (SELECT 1 FROM still s WHERE s.ecosystem = c.ecosystem AND s.norm_name = c.norm_name AND s.candidate = c.candidate)
  UNION SELECT c.ecosystem, c.norm_name, c.version, o.option FROM cand c JOIN (SELECT ecosystem, norm_name, version, same_major_latest AS option FROM sm UNION SELECT c2.ecosystem, c2.norm_name, c2.version, l.latest FROM cand c2 JOIN latest l ON l.ecosystem = c2.ecosystem AND l.norm_name = c2.norm_name) o ON o.ecosystem = c.ecosystem AND o.norm_name = c.norm_name AND o.version = c.version
   WHERE o.option IS NOT NULL AND {vkey('o.option')} > {vkey('c.candidate')} AND NOT EXISTS (SELECT 1 FROM adv a WHERE a.ecosystem = c.ecosystem AND a.norm_name = c.norm_name AND {vkey('o.option')} >= a.ki AND (a.fixed IS NULL OR {vkey('o.option')} < a.kf)))"""


@query("safe_versions", _BASE + f", {_SAFE} SELECT * FROM opts")
def _safe(spark, d):
    rows, _, own = _first_round(spark, d)
    return K.safe_versions(rows, own.table("spans"), own.table("index")).drop("option_rank").distinct()


_CHOSEN = f"""{_SAFE}, chosen AS (SELECT c.ecosystem, c.norm_name, c.version, coalesce(p.preferred, c.candidate) AS preferred_version, coalesce(p.allowed, '') AS allowed_versions, p.preferred IS NOT NULL AS verified_safe FROM cand c LEFT JOIN (
  SELECT ecosystem, norm_name, version, max(CASE WHEN rn = 1 THEN option END) AS preferred, string_agg(option, ',' ORDER BY {vkey('option')}) AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY ecosystem, norm_name, version ORDER BY CASE WHEN {major('option')} = {major('version')} THEN 0 ELSE 1 END, {vkey('option')}) AS rn FROM opts) o GROUP BY 1, 2, 3) p ON p.ecosystem = c.ecosystem AND p.norm_name = c.norm_name AND p.version = c.version)"""


def _chosen(spark, d):
    rows, _, own = _first_round(spark, d)
    return K.choose_version(rows, K.safe_versions(rows, own.table("spans"), own.table("index")), own.table("index"))


@query("choose_version", _BASE + f", {_CHOSEN} SELECT * FROM chosen")
def _choose(spark, d):
    rows = _chosen(spark, d)
    return rows.select(*M.LOOKUP, "preferred_version", F.array_join("allowed_versions", ",").alias("allowed_versions"), "verified_safe")


@query(
    "deterministic_recommendation",
    _BASE
    + f""", {_CHOSEN} SELECT ecosystem, norm_name, version, preferred_version AS recommended_version, preferred_version || ' is the lowest version that is listed as fixing every known vulnerability of this dependency' || CASE WHEN verified_safe THEN ' and that was verified as clean' ELSE '' END || '.' AS reasoning, 0.5::DOUBLE AS confidence FROM chosen""",
)
def _recommend(spark, d):
    return K.deterministic_recommendation(_chosen(spark, d)).select(*M.LOOKUP, "recommended_version", "reasoning", "confidence")


_ALLOWED = f"rl AS (SELECT ecosystem, {norm()} AS norm_name, list(DISTINCT version) AS allowed, min(version) AS preferred FROM fx_releases GROUP BY 1, 2)"


@query(
    "version_guardrail",
    _BASE
    + f""", {_ALLOWED}, p AS (SELECT DISTINCT ecosystem, {norm()} AS norm_name, version AS proposed FROM fx_dependencies UNION SELECT ecosystem, {norm()}, '=v' || version FROM fx_releases)
 SELECT p.ecosystem, p.norm_name, p.proposed, CASE WHEN list_contains(allowed, regexp_replace(p.proposed, '^=?v?', '')) THEN regexp_replace(p.proposed, '^=?v?', '') ELSE preferred END AS final_version,
 CASE WHEN p.proposed IS NULL THEN '(no version proposed; using the preferred candidate ' || preferred || ')' WHEN NOT list_contains(allowed, regexp_replace(p.proposed, '^=?v?', '')) THEN '(adjusted: proposed ' || p.proposed || ' which is not an allowed candidate)' END AS note FROM p JOIN rl ON rl.ecosystem = p.ecosystem AND rl.norm_name = p.norm_name""",
)
def _guardrail(spark, d):
    eco = F.col("ecosystem")
    rel = fixture(spark, d, "fx_releases").withColumn("norm_name", V.normalize_package_name(F.col("package_name"), eco))
    allowed = rel.groupBy(*K.PACKAGE).agg(F.array_sort(F.collect_set("version")).alias("allowed_versions"), F.min("version").alias("preferred_version"))
    deps = fixture(spark, d, "fx_dependencies").select("ecosystem", V.normalize_package_name(F.col("package_name"), eco).alias("norm_name"), F.col("version").alias("proposed"))
    asked = deps.unionByName(rel.select(*K.PACKAGE, F.concat(F.lit("=v"), "version").alias("proposed"))).distinct()
    return K.version_guardrail(asked.join(allowed, K.PACKAGE)).select(*K.PACKAGE, "proposed", "final_version", "note")


@query(
    "component_guardrail",
    ctes("fx_components", "fx_repositories")
    + """, p AS (SELECT repository_id, unnest(['./SRC/', 'src/app', 'ghost', './', 'Tests', 'src']) AS name, unnest([0, 1, 2, 3, 4, 5]) AS position, unnest(['src', 'src/app', 'ghost', '.', 'tests', 'src']) AS low FROM fx_repositories),
 m AS (SELECT p.*, c.path FROM p LEFT JOIN fx_components c ON c.repository_id = p.repository_id AND c.path = p.low), k AS (SELECT repository_id, path, min(position) AS position FROM m WHERE path IS NOT NULL GROUP BY 1, 2)
 SELECT p.repository_id, coalesce((SELECT string_agg(path, ',' ORDER BY position) FROM k WHERE k.repository_id = p.repository_id), '') AS kept, coalesce((SELECT string_agg(name, ',' ORDER BY position) FROM m WHERE m.repository_id = p.repository_id AND path IS NULL), '') AS dropped FROM fx_repositories p""",
)
def _components(spark, d):
    names = ["./SRC/", "src/app", "ghost", "./", "Tests", "src"]
    proposals = fixture(spark, d, "fx_repositories").select("repository_id", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("position", "name"))
    evidence = fixture(spark, d, "fx_components").withColumnRenamed("path", "component")
    rows = K.component_guardrail(proposals, evidence, ["repository_id"])
    return rows.select("repository_id", F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


@query(
    "remediable_gate",
    ctes("fx_paths")
    + """ SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 'pkg has no concrete version in ' || path || '; pin it before remediating' WHEN split_part(path, '/', -1) = 'package.json' OR regexp_matches(split_part(lower(path), '/', -1), '^requirements([-_].*)?\\.txt$') OR (lower(path) LIKE 'requirements/%.txt') THEN NULL ELSE 'dependency file ''' || path || ''' is not supported for remediation' END AS reason FROM fx_paths""",
)
def _gate(spark, d):
    paths = fixture(spark, d, "fx_paths")
    version = F.when(F.col("file_id") % 4 != 0, "1.0.0")
    return paths.select("file_id", K.remediable_gate(version, F.col("path"), F.lit("pkg")).alias("reason"))


# one requirement line per line item, with what the rewrite must make of it
_LINE = "CASE l_linenumber % 7 WHEN 0 THEN '{p}[x] ==1.2.3 ; python_version > \"3\"  # keep' WHEN 1 THEN '{p}>=1.0' WHEN 2 THEN '{p}==1.0.0' WHEN 3 THEN '{p}==1.2.3 --hash=sha256:ab' WHEN 4 THEN '# {p}==1.2.3' WHEN 5 THEN 'other==1.2.3' ELSE '  {p} === 1.2.3 --no-binary :all:' END"
_EXPECT = "CASE l_linenumber % 7 WHEN 0 THEN '{p}[x] ==9.9.9 ; python_version > \"3\"  # keep' WHEN 6 THEN '  {p} == 9.9.9 --no-binary :all:' ELSE text END"


def _named(template: str, kind: str) -> str:
    return template.replace("'{p}", f"'Pkg.' || CAST(l_partkey AS {kind}) || '").replace("'  {p}", f"'  Pkg.' || CAST(l_partkey AS {kind}) || '").replace("'# {p}", f"'# Pkg.' || CAST(l_partkey AS {kind}) || '")


@query(
    "rewrite_requirement_pins",
    f"""SELECT l_orderkey AS repository_id, path, line_no, {_named(_EXPECT, 'VARCHAR')} AS text, l_linenumber % 7 IN (0, 6) AS rewritten, CASE l_linenumber % 7 WHEN 1 THEN 'not pinned with ''==''; pin the version before remediation' WHEN 2 THEN 'pinned to 1.0.0; re-run the analysis before remediation' WHEN 3 THEN 'uses --hash pins; hashes of the new version are not known' END AS refusal
 FROM (SELECT l_orderkey, l_partkey, l_linenumber, 'requirements.txt' AS path, l_linenumber AS line_no, {_named(_LINE, 'VARCHAR')} AS text FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber FROM lineitem) x) s""",
)
def _pins(spark, d):
    items = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber").distinct()
    lines = items.select(
        F.col("l_orderkey").alias("repository_id"), F.lit("requirements.txt").alias("path"), F.col("l_linenumber").alias("line_no"), F.expr(_named(_LINE, "STRING")).alias("text")
    )
    plan = items.select(
        F.col("l_orderkey").alias("repository_id"), F.lit("requirements.txt").alias("path"), F.concat(F.lit("pkg_"), "l_partkey").alias("package_name"),
        F.lit("1.2.3").alias("current_version"), F.lit("9.9.9").alias("new_version"),
    ).distinct()
    return K.rewrite_requirement_pins(lines, plan)


_OP = "regexp_extract(spec, '^(\\^|~|>=|=v|=|v)?', 1)"
_SIMPLE = "regexp_matches(spec, '^(\\^|~|>=|=v|=|v)?\\s*\\d+\\.\\d+\\.\\d+(?:-[0-9A-Za-z.-]+)?(?:\\+[0-9A-Za-z.-]+)?$')"


@query(
    "rewrite_manifest_specs",
    ctes("fx_specs")
    + f""" SELECT spec, CASE WHEN NOT {_SIMPLE} THEN '^9.9.9' WHEN {_OP} IN ('', '=', 'v', '=v') AND regexp_replace(spec, '^=?v?', '') <> '1.2.3' THEN NULL ELSE {_OP} || '9.9.9' END AS new_spec, CASE WHEN NOT {_SIMPLE} THEN 'complex range ''' || spec || ''' replaced with ^9.9.9' END AS note,
 CASE WHEN {_SIMPLE} AND {_OP} IN ('', '=', 'v', '=v') AND regexp_replace(spec, '^=?v?', '') <> '1.2.3' THEN 'pinned to ' || regexp_replace(spec, '^=?v?', '') || '; re-run the analysis before remediation' END AS refusal FROM fx_specs""",
)
def _specs(spark, d):
    specs = fixture(spark, d, "fx_specs").withColumns({"current_version": F.lit("1.2.3"), "new_version": F.lit("9.9.9")})
    return K.rewrite_manifest_specs(specs).select("spec", "new_spec", "note", "refusal")
