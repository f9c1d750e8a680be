"""Queries of dependency extraction (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.sqlparts import norm, valid
from fleetlens.functions import text as T
from fleetlens.operators import dependencies as D
from fleetlens.operators import extract_npm as N
from fleetlens.operators import extract_python as P
from fleetlens.plans.bindings import ctes, fixture

GROUP = Group()
query = GROUP.query


def _lines(spark, d):
    return T.logical_lines(fixture(spark, d, "fx_requirement_files").select("repository_id", "path", "content"))


_REQ = ctes("fx_requirement_files")


@query(
    "extract_requirements",
    _REQ
    + """ SELECT repository_id, path AS source_file, 2 AS line_no, pkg AS package_name, version, '[extra1]' || coalesce('==' || version, '') AS version_spec, 'unknown' AS scope, false AS dev FROM fx_requirement_files WHERE version IS NULL OR version <> 'not-a-version'
 UNION ALL SELECT repository_id, path, 7, 'Other.' || regexp_extract(content, 'Other\\.(\\d+)', 1), NULL, '>=1.0,<2 ; python_version > "3.8"', 'unknown', false FROM fx_requirement_files""",
)
def _requirements(spark, d):
    return P.extract_requirements(_lines(spark, d)).drop("ecosystem")


_PINNED = "CASE l_suppkey % 6 WHEN 0 THEN '==' || q WHEN 1 THEN '>=1, ===' || q WHEN 2 THEN '==1.*' WHEN 3 THEN '==1,==2' WHEN 4 THEN '==' || q || ', ==' || q || ' ; python_version == ''3.8''' ELSE '!=1.0,<=2,~=3' END"
_SPECS = f"SELECT DISTINCT {_PINNED} AS spec FROM (SELECT l_suppkey, CAST(l_orderkey AS {{}}) || '.' || CAST(l_linenumber AS {{}}) AS q FROM lineitem) s"


@query(
    "pinned_version",
    f"SELECT spec, CASE WHEN spec LIKE '==%.*' OR spec = '==1,==2' OR spec LIKE '!=%' THEN NULL WHEN spec LIKE '>=1%' THEN substr(spec, 9) ELSE regexp_extract(spec, '^==([0-9.]+)', 1) END AS version FROM ({_SPECS.format('VARCHAR', 'VARCHAR')}) x",
)
def _pinned(spark, d):
    lineitem = spark.read.parquet(f"{d}/lineitem.parquet")
    specs = spark.sql(_SPECS.format("STRING", "STRING").replace("''3.8''", "\\'3.8\\'").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    return specs.select("spec", P.pinned_version(F.col("spec")).alias("version"))


@query(
    "extract_url_requirements",
    _REQ
    + " SELECT repository_id, path AS source_file, 5 AS line_no, regexp_extract(content, '#egg=(egg_\\d+)', 1) AS package_name, 'git+https://git.example/acme.git#egg=' || regexp_extract(content, '#egg=(egg_\\d+)', 1) AS version_spec FROM fx_requirement_files",
)
def _urls(spark, d):
    return P.extract_url_requirements(_lines(spark, d)).select("repository_id", "source_file", "line_no", "package_name", "version_spec")


@query(
    "requirement_options",
    _REQ
    + """ SELECT repository_id, path AS source_file, 4 AS line_no, path || ':4: requirement include ''-r ../common/base.txt'' is not followed (the file is not parsed)' AS message FROM fx_requirement_files
 UNION ALL SELECT repository_id, path, 9, path || ':9: editable requirement ''-e ./local'' skipped (local/VCS installs have no registry version)' FROM fx_requirement_files""",
)
def _options(spark, d):
    files = fixture(spark, d, "fx_requirement_files").select("repository_id", "path")
    return P.requirement_options(_lines(spark, d), files)


_JSON = ctes("fx_package_json")


@query(
    "extract_manifest_direct",
    _JSON
    + """ SELECT repository_id, path, package_name, spec AS version_spec, dev, count(*) AS n FROM (SELECT repository_id, path, 'p' || part AS package_name, '^1.2.3' AS spec, false AS dev FROM fx_package_json UNION SELECT repository_id, path, 'd' || part, '~2', true FROM fx_package_json
 UNION SELECT repository_id, path, 'shared', '1.0.0', false FROM fx_package_json UNION SELECT repository_id, path, 'q', '*', false FROM fx_package_json) u GROUP BY 1, 2, 3, 4, 5""",
)
def _manifest(spark, d):
    rows = N.extract_manifest(N.parse_manifests(fixture(spark, d, "fx_package_json"))).drop("directory")
    return rows.withColumn("n", F.lit(1).cast("bigint"))


def _lock_files(spark, d):
    """One v3 lock file per analysis, as JSON text."""
    e = fixture(spark, d, "fx_lock_entries")
    entry = F.struct("version", F.col("dev").alias("dev"), F.create_map("dep_a", F.lit("*")).alias("dependencies"))
    return e.groupBy("repository_id", F.col("lock_path").alias("path")).agg(
        F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), F.map_from_entries(F.collect_list(F.struct("lock_key", entry))).alias("packages"))).alias("content")
    )


@query(
    "explode_lock_v2",
    ctes("fx_lock_entries") + " SELECT repository_id, lock_path, lock_key, version, CAST(dev AS VARCHAR) AS dev, dep_a AS dependency FROM fx_lock_entries",
)
def _explode_lock(spark, d):
    rows = N.explode_lock(_lock_files(spark, d))
    return rows.select("repository_id", "lock_path", "lock_key", "version", "dev", F.map_keys("dependencies")[0].alias("dependency"))


@query(
    "flatten_lock_v1",
    ctes("fx_package_json")
    + """ SELECT repository_id, path AS lock_path, k AS lock_key, v AS version, r AS requires FROM (SELECT repository_id, directory || '/package-lock.json' AS path, 'node_modules/a' AS k, '1.0.' || part AS v, 'b' AS r FROM fx_package_json
 UNION ALL SELECT repository_id, directory || '/package-lock.json', 'node_modules/a/node_modules/b', '2.0.0', NULL FROM fx_package_json UNION ALL SELECT repository_id, directory || '/package-lock.json', 'node_modules/a/node_modules/b/node_modules/@s/c', '3.0.0', NULL FROM fx_package_json) u""",
)
def _flatten_v1(spark, d):
    doc = F.concat(
        F.lit('{"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.'),
        F.col("part").cast("string"),
        F.lit('", "requires": {"b": "^2"}, "dependencies": {"b": {"version": "2.0.0", "dependencies": {"@s/c": {"version": "3.0.0"}}}}}}}'),
    )
    files = fixture(spark, d, "fx_package_json").select(
        "repository_id", F.concat("directory", F.lit("/package-lock.json")).alias("path"), doc.alias("content")
    )
    rows = N.flatten_lock_v1(files)
    return rows.select("repository_id", "lock_path", "lock_key", "version", F.map_keys("dependencies")[0].alias("requires"))


@query(
    "split_lock_key",
    ctes("fx_lock_entries")
    + " SELECT DISTINCT lock_key, rtrim(regexp_replace(lock_key, 'node_modules/(@s/)?[^/]*$', ''), '/') AS parent, regexp_extract(lock_key, 'node_modules/((@s/)?[^/]*)$', 1) AS name FROM fx_lock_entries",
)
def _split(spark, d):
    keys = fixture(spark, d, "fx_lock_entries").select("lock_key").distinct()
    return keys.select("lock_key", N.split_lock_key(F.col("lock_key")).alias("s")).select("lock_key", "s.parent", "s.name")


def _entries(spark, d):
    e = fixture(spark, d, "fx_lock_entries")
    null_map = F.lit(None).cast("map<string,string>")
    return e.select(
        "repository_id", "lock_path", "lock_key", "version",
        F.lit(None).cast("string").alias("resolved"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("link"),
        F.col("dev").cast("string").alias("dev"),
        F.create_map("dep_a", F.lit("*")).alias("dependencies"), null_map.alias("devDependencies"),
        F.create_map("dep_b", F.lit("*")).alias("optionalDependencies"), null_map.alias("peerDependencies"),
    )


# nearest installed candidate: own level, then each enclosing package, then the root
_UP = "regexp_replace({}, '/?node_modules/(@s/)?[^/]*$', '')"
_RESOLVE = f"""cand AS (SELECT repository_id, lock_key AS base_key, dep, level, CASE WHEN b = '' THEN '' ELSE b || '/' END || 'node_modules/' || dep AS candidate FROM (
   SELECT repository_id, lock_key, dep, 0 AS level, lock_key AS b FROM wanted UNION SELECT repository_id, lock_key, dep, 1, {_UP.format('lock_key')} FROM wanted
   UNION SELECT repository_id, lock_key, dep, 2, {_UP.format(_UP.format('lock_key'))} FROM wanted UNION SELECT repository_id, lock_key, dep, 3, '' FROM wanted) x),
 solved AS (SELECT c.repository_id, c.base_key, c.dep, arg_min(c.candidate, c.level) AS child_key FROM cand c JOIN fx_lock_entries e ON e.repository_id = c.repository_id AND e.lock_key = c.candidate GROUP BY 1, 2, 3)"""


@query(
    "resolve_lock_key",
    ctes("fx_lock_entries")
    + f", wanted AS (SELECT DISTINCT repository_id, lock_key, dep_a AS dep FROM fx_lock_entries), {_RESOLVE} SELECT w.repository_id, w.lock_key AS base_key, w.dep AS dependency, s.child_key FROM wanted w LEFT JOIN solved s ON s.repository_id = w.repository_id AND s.base_key = w.lock_key AND s.dep = w.dep",
)
def _resolve(spark, d):
    entries = _entries(spark, d)
    edges = fixture(spark, d, "fx_lock_entries").select(
        "repository_id", "lock_path", F.col("lock_key").alias("base_key"), F.col("dep_a").alias("dependency")
    )
    return N.resolve_lock_key(edges, entries, ["repository_id", "lock_path"]).drop("lock_path")


@query(
    "entry_version",
    ctes("fx_lock_entries") + f" SELECT repository_id, lock_key, CASE WHEN {valid()} THEN version END AS version FROM fx_lock_entries",
)
def _entry_version(spark, d):
    return fixture(spark, d, "fx_lock_entries").select("repository_id", "lock_key", N.entry_version(F.col("version")).alias("version"))


def _direct(spark, d):
    rows = fixture(spark, d, "fx_direct").select(
        "repository_id", F.lit("package.json").alias("path"), F.lit("").alias("directory"), F.lit("package-lock.json").alias("lock_path"),
        F.lit("").alias("lock_dir"), "package_name", "version_spec",
    )
    return N.direct_version(rows, _entries(spark, d))


_DIRECT = f"""direct AS (SELECT d.repository_id, d.package_name, d.version_spec, e.lock_key AS claimed_key, CASE WHEN {valid('e.version')} THEN e.version END AS installed,
  CASE WHEN version_spec = 'file:../x' THEN NULL WHEN regexp_full_match(version_spec, '[0-9.]+') THEN version_spec ELSE CASE WHEN {valid('e.version')} THEN e.version END END AS version
  FROM fx_direct d LEFT JOIN fx_lock_entries e ON e.repository_id = d.repository_id AND e.lock_key = 'node_modules/' || d.package_name)"""


@query(
    "direct_version",
    ctes("fx_direct", "fx_lock_entries")
    + f""", {_DIRECT} SELECT repository_id, package_name, version_spec, claimed_key, version, CASE WHEN version_spec = 'file:../x' THEN 'package.json: ''' || package_name || ''' uses a file: specifier (''file:../x''); version cannot be determined'
 WHEN regexp_full_match(version_spec, '[0-9.]+') AND installed <> version_spec THEN 'package.json: ''' || package_name || ''' pins ' || version_spec || ' but package-lock.json installs ' || installed
 WHEN version IS NULL THEN 'package.json: ''' || package_name || ''' (' || version_spec || ') not found in package-lock.json; version unresolved' END AS warning FROM direct""",
)
def _direct_version(spark, d):
    return _direct(spark, d).select("repository_id", "package_name", "version_spec", "claimed_key", "version", "warning")


_IS_PKG = "regexp_extract(e.lock_key, 'node_modules/((@s/)?[^/]*)$', 1)"
_VER = f"CASE WHEN {valid('e.version')} THEN e.version END"


@query(
    "extract_transitive",
    ctes("fx_direct", "fx_lock_entries")
    + f""", {_DIRECT} SELECT e.repository_id, {_IS_PKG} AS package_name, {_VER} AS version, bool_and(e.dev) AS dev FROM fx_lock_entries e
 WHERE NOT EXISTS (SELECT 1 FROM direct c WHERE c.repository_id = e.repository_id AND c.claimed_key = e.lock_key) AND NOT EXISTS (SELECT 1 FROM direct c WHERE c.repository_id = e.repository_id AND c.package_name = {_IS_PKG} AND c.version IS NOT DISTINCT FROM {_VER}) GROUP BY 1, 2, 3""",
)
def _transitive(spark, d):
    return N.extract_transitive(_entries(spark, d), _direct(spark, d)).drop("lock_path")


@query(
    "extract_relations",
    ctes("fx_lock_entries")
    + f""", wanted AS (SELECT DISTINCT repository_id, lock_key, dep_a AS dep FROM fx_lock_entries UNION SELECT DISTINCT repository_id, lock_key, dep_b FROM fx_lock_entries), {_RESOLVE},
 ident AS (SELECT e.repository_id, e.lock_key, {_IS_PKG} AS name, {_VER} AS version FROM fx_lock_entries e)
 SELECT DISTINCT p.repository_id, p.name AS parent_name, p.version AS parent_version, c.name AS child_name, c.version AS child_version FROM solved s JOIN ident p ON p.repository_id = s.repository_id AND p.lock_key = s.base_key JOIN ident c ON c.repository_id = s.repository_id AND c.lock_key = s.child_key
 WHERE NOT (p.name = c.name AND p.version IS NOT DISTINCT FROM c.version)""",
)
def _relations(spark, d):
    entries = _entries(spark, d)
    none = _direct(spark, d).filter("claimed_key = ''")
    relations, _ = N.extract_relations(entries, N.entry_identities(entries, none))
    return relations.drop("lock_path")


def _workspaces(spark, d):
    dirs = fixture(spark, d, "fx_package_json").select("repository_id", "directory").distinct()
    patterns = dirs.select("repository_id").distinct().select(
        "repository_id", F.explode(F.array(F.lit("./packages/*/"), F.lit("!packages/b"), F.lit("../evil"), F.lit("/abs"), F.lit("ex**/[x-z]"))).alias("pattern")
    )
    return N.workspace_match(dirs, patterns, ["repository_id"])


@query("workspace_match", _JSON + " SELECT DISTINCT repository_id, directory FROM fx_package_json WHERE directory IN ('packages/a', 'examples/x')")
def _workspace(spark, d):
    return _workspaces(spark, d)


@query(
    "governing_lock",
    _JSON
    + """ SELECT repository_id, path, CASE WHEN directory = 'examples/x' AND repository_id % 3 = 1 THEN 'examples/x/package-lock.json' WHEN repository_id % 3 = 2 THEN NULL WHEN directory = '' OR directory IN ('packages/a', 'examples/x') THEN 'package-lock.json' END AS lock_path,
 directory = 'packages/b' AND repository_id % 3 <> 2 AS warned FROM (SELECT DISTINCT repository_id, path, directory FROM fx_package_json) s""",
)
def _governing(spark, d):
    manifests = fixture(spark, d, "fx_package_json").select("repository_id", "path", "directory").distinct()
    repos = manifests.select("repository_id").distinct()
    root = repos.filter("repository_id % 3 <> 2").select("repository_id", F.lit("package-lock.json").alias("lock_path"), F.lit("").alias("directory"))
    own = repos.filter("repository_id % 3 = 1").select(
        "repository_id", F.lit("examples/x/package-lock.json").alias("lock_path"), F.lit("examples/x").alias("directory")
    )
    members = _workspaces(spark, d).withColumn("lock_path", F.lit("package-lock.json"))
    rows = N.governing_lock(manifests, root.unionByName(own), members)
    return rows.select("repository_id", "path", "lock_path", F.col("warning").isNotNull().alias("warned"))


@query(
    "lock_only_workspaces",
    _JSON + " SELECT DISTINCT repository_id, 'packages/gone' AS directory, 'package-lock.json' AS source FROM fx_package_json",
)
def _lock_only(spark, d):
    files = fixture(spark, d, "fx_package_json")
    manifests = N.parse_manifests(files)
    repos = files.select("repository_id").distinct()
    deps = F.create_map(F.lit("q"), F.lit("1.0.0"))
    null_map = F.lit(None).cast("map<string,string>")
    entries = repos.select(
        "repository_id", F.lit("package-lock.json").alias("lock_path"),
        F.explode(F.array(F.lit(""), F.lit("packages/gone"), F.lit("packages/empty"), F.lit("node_modules/q"))).alias("lock_key"),
    ).withColumns(
        {"dependencies": F.when(F.col("lock_key") != "packages/empty", deps), "devDependencies": null_map, "optionalDependencies": null_map, "peerDependencies": null_map}
    )
    return N.lock_only_workspaces(entries, manifests).select("repository_id", "directory", F.col("path").alias("source"))


@query(
    "extraction_warnings",
    _REQ
    + """ SELECT DISTINCT repository_id, path || ':9: editable requirement ''-e ./local'' skipped (local/VCS installs have no registry version)' AS message FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || ':4: requirement include ''-r ../common/base.txt'' is not followed (the file is not parsed)' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || ':8: cannot parse ''!!garbage line''' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || ':2: cannot parse ''' || pkg || '[extra1]==not-a-version     --hash=sha256:abc''' FROM fx_requirement_files WHERE version = 'not-a-version'
 UNION SELECT DISTINCT repository_id, path || ':6: URL/path requirement ''https://files.example/x.whl'' skipped (no package name)' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || ':5: ''' || regexp_extract(content, '#egg=(egg_\\d+)', 1) || ''' is installed from a URL (git+https://git.example/acme.git#egg=' || regexp_extract(content, '#egg=(egg_\\d+)', 1) || '); version cannot be determined' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || '/package.json: malformed JSON; file skipped' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || '/yarn.lock: lock files of this kind are not parsed; transitive dependencies are unavailable' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || '/requirements.txt: file was not read; what it declares is unknown' FROM fx_requirement_files
 UNION SELECT DISTINCT repository_id, path || '/package-lock.json: file was not read; what it declares is unknown' FROM fx_requirement_files""",
)
def _warnings(spark, d):
    files = fixture(spark, d, "fx_requirement_files")
    # next to every file one that was listed, but not read
    lost = files.select("repository_id", F.concat("path", F.lit("/requirements.txt")).alias("path"), F.lit(None).cast("string").alias("content"))
    _, warnings = P.extract_python(files.select("repository_id", "path", "content").unionByName(lost))
    broken = F.array(F.lit("/package.json"), F.lit("/yarn.lock"), F.lit("/package-lock.json"))
    # the same repositories with a cut manifest, a lock of another kind and a file that was not read
    other = files.select("repository_id", "path", "content", F.explode(broken).alias("name")).select(
        "repository_id",
        F.concat("path", "name").alias("path"),
        F.when(F.col("name") != "/package-lock.json", F.concat(F.lit("{"), "content")).alias("content"),
    )
    return D.extraction_warnings(warnings, D.json_warnings(other.filter("content IS NOT NULL")), D.unread_warnings(other))


_DEPS = ctes("fx_dependencies")


@query(
    "dependency_identity_dedupe",
    _DEPS
    + f" SELECT analysis_id, ecosystem, norm_name, version, source_file, scope, package_name FROM (SELECT *, {norm()} AS norm_name, row_number() OVER (PARTITION BY analysis_id, ecosystem, {norm()}, version, source_file ORDER BY scope, package_name) AS rn FROM fx_dependencies) s WHERE rn = 1",
)
def _dedupe(spark, d):
    deps = fixture(spark, d, "fx_dependencies")
    return D.dependency_identity_dedupe(deps, [F.col("scope"), F.col("package_name")])


@query(
    "resolve_relations",
    ctes("fx_dep_ids", "fx_named_relations")
    + """, ids AS (SELECT analysis_id, ecosystem, norm_name, version, min(dependency_id) AS id FROM fx_dep_ids GROUP BY 1, 2, 3, 4)
 SELECT DISTINCT r.analysis_id, p.id AS parent_id, c.id AS child_id FROM fx_named_relations r JOIN ids p ON p.analysis_id = r.analysis_id AND p.ecosystem = r.ecosystem AND p.norm_name = r.parent_name AND p.version IS NOT DISTINCT FROM r.parent_version
 JOIN ids c ON c.analysis_id = r.analysis_id AND c.ecosystem = r.ecosystem AND c.norm_name = r.child_name AND c.version IS NOT DISTINCT FROM r.child_version WHERE p.id <> c.id""",
)
def _resolve_relations(spark, d):
    edges, _ = D.resolve_relations(fixture(spark, d, "fx_named_relations"), fixture(spark, d, "fx_dep_ids"))
    return edges


@query(
    "extraction_summary",
    _DEPS
    + """ SELECT analysis_id, count(*) AS total, count(*) FILTER (ecosystem = 'PyPI') AS pypi, count(*) FILTER (ecosystem = 'npm') AS npm, count(*) FILTER (scope = 'direct') AS direct, count(*) FILTER (scope = 'transitive') AS transitive, count(*) FILTER (scope = 'unknown') AS unknown_scope,
 count(version) AS pinned, count(*) - count(version) AS unpinned, count(DISTINCT source_file) AS files FROM fx_dependencies GROUP BY 1""",
)
def _extraction_summary(spark, d):
    return D.extraction_summary(fixture(spark, d, "fx_dependencies"))


@query(
    "unsupported_repositories",
    ctes("fx_repositories", "fx_paths")
    + """ SELECT repository_id FROM fx_repositories r WHERE NOT EXISTS (SELECT 1 FROM fx_paths p WHERE p.repository_id = r.repository_id AND (split_part(path, '/', -1) = 'package.json' OR regexp_matches(split_part(lower(path), '/', -1), '^requirements([-_].*)?\\.txt$') OR (lower(path) LIKE '%.txt' AND path LIKE '%/%' AND split_part(lower(path), '/', -2) = 'requirements')))""",
)
def _unsupported(spark, d):
    return D.unsupported_repositories(fixture(spark, d, "fx_repositories").select("repository_id"), fixture(spark, d, "fx_paths"))


@query(
    "extract_npm",
    ctes("fx_npm_files")
    + """, g AS (SELECT d.*, directory IN ('', 'packages/a') OR (directory = 'packages/b' AND EXISTS (SELECT 1 FROM fx_npm_dirs r WHERE r.repository_id = d.repository_id AND r.directory = '')) AS governed FROM fx_npm_dirs d),
 t AS (SELECT repository_id, part, bool_or(governed) AS claimed FROM g GROUP BY 1, 2), r AS (SELECT repository_id, bool_or(governed) AS governed FROM g GROUP BY 1),
 w AS (SELECT repository_id FROM g UNION ALL SELECT repository_id FROM r WHERE repository_id % 5 = 0)
 SELECT repository_id, 'dependency' AS kind, path AS source_file, 'p' || part AS package_name, CASE WHEN governed THEN '1.2.' || part END AS version, 'direct' AS scope, false AS dev FROM g
 UNION ALL SELECT repository_id, 'dependency', path, 'fix', '2.0.0', 'direct', false FROM g UNION ALL SELECT repository_id, 'dependency', path, 'd' || part, NULL, 'direct', true FROM g
 UNION ALL SELECT repository_id, 'dependency', 'package-lock.json', 'p' || part, '1.2.' || part, 'transitive', false FROM t WHERE NOT claimed UNION ALL SELECT repository_id, 'dependency', 'package-lock.json', 'fix', '2.0.0', 'transitive', false FROM r WHERE NOT governed
 UNION ALL SELECT repository_id, 'dependency', 'package-lock.json', 'tiny', '0.1.0', 'transitive', true FROM r UNION ALL SELECT repository_id, 'relation', 'package-lock.json', 'p' || part, 'tiny', NULL, NULL FROM t
 UNION ALL SELECT repository_id, 'warnings', NULL, NULL, CAST(count(*) AS VARCHAR), NULL, NULL FROM w GROUP BY 1""",
)
def _extract_npm(spark, d):
    deps, relations, warnings = N.extract_npm(fixture(spark, d, "fx_npm_files"))
    null = F.lit(None).cast("string")
    rows = deps.select("repository_id", F.lit("dependency").alias("kind"), "source_file", "package_name", "version", "scope", "dev")
    edges = relations.select(
        "repository_id", F.lit("relation"), "lock_path", "parent_name", "child_name", null, F.lit(None).cast("boolean")
    )
    counts = warnings.groupBy("repository_id").agg(F.count("*").cast("string").alias("n"))
    return rows.union(edges).union(counts.select("repository_id", F.lit("warnings"), null, null, "n", null, F.lit(None).cast("boolean")))
