"""Queries of repository profiles (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.operators import profile as H
from fleetlens.plans.bindings import ctes, fixture

GROUP = Group()
query = GROUP.query

_DIRS = "string_split(regexp_replace(path, '/?[^/]*$', ''), '/')"
_IGN = "['.venv','venv','node_modules','dist','build','__pycache__','.pytest_cache','.tox','.mypy_cache']"
_FLAGS = f"""fl AS (SELECT *, split_part(path, '/', -1) AS name, len(string_split(path, '/')) - 1 AS depth, CASE regexp_extract(lower(split_part(path, '/', -1)), '^.+\\.([^.]+)$', 1) WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'tsx' THEN 'TypeScript' END AS language,
  split_part(path, '/', -1) IN ('test_main.py', 'conftest.py') AS is_test FROM fx_paths WHERE NOT list_has_any({_DIRS}, {_IGN}) AND len(list_filter({_DIRS}, lambda x: x LIKE '.%' AND x <> '.github')) = 0)"""
_STATS = f"""{_FLAGS}, st AS (SELECT repository_id, dir, level, count(*) AS files, count(language) AS programming, count(*) FILTER (is_test) AS tests, count(language) AS with_language FROM (
  SELECT *, '.' AS dir, 0 AS level FROM fl WHERE depth = 0 UNION ALL SELECT *, split_part(path, '/', 1), 1 FROM fl WHERE depth > 0 UNION ALL SELECT *, split_part(path, '/', 1) || '/' || split_part(path, '/', 2), 2 FROM fl WHERE depth >= 2) u GROUP BY 1, 2, 3)"""
_TD = f"""{_STATS}, tt AS (SELECT * FROM st WHERE level > 0 AND (split_part(dir, '/', -1) = 'tests' OR (tests > 0 AND tests * 2 > programming))),
 td AS (SELECT repository_id, dir FROM tt WHERE level = 1 UNION ALL SELECT repository_id, dir FROM tt n WHERE level = 2 AND NOT EXISTS (SELECT 1 FROM tt p WHERE p.level = 1 AND p.repository_id = n.repository_id AND p.dir = split_part(n.dir, '/', 1)))"""
_PATHS = ctes("fx_paths")


def _files(spark, d):
    return fixture(spark, d, "fx_paths").select("repository_id", "path")


@query("detect_language", _PATHS + f", {_FLAGS} SELECT DISTINCT path, language FROM fl")
def _language(spark, d):
    kept = H.T.prune_paths(_files(spark, d).select("path").distinct(), H.T.PROFILER_IGNORED, keep_hidden=[".github"])
    return kept.select("path", H.detect_language(F.col("path")).alias("language"))


@query("language_histogram", _PATHS + f", {_FLAGS} SELECT repository_id, language, count(*) AS files FROM fl WHERE language IS NOT NULL GROUP BY 1, 2")
def _histogram(spark, d):
    return H.language_histogram(_files(spark, d))


@query(
    "dominant_language",
    _PATHS
    + f""", {_FLAGS}, h AS (SELECT repository_id, language, count(*) AS n FROM fl WHERE language IS NOT NULL GROUP BY 1, 2), best AS (SELECT repository_id, language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, language) AS rn FROM h) s WHERE rn = 1),
 m AS (SELECT repository_id, max(CASE WHEN name LIKE 'requirements%' THEN 1 ELSE 0 END) AS py, max(CASE WHEN name = 'package.json' THEN 1 ELSE 0 END) AS js FROM fl GROUP BY 1)
 SELECT m.repository_id, coalesce(best.language, CASE WHEN py = 1 THEN 'Python' WHEN js = 1 THEN 'JavaScript' END) AS language FROM m LEFT JOIN best ON best.repository_id = m.repository_id""",
)
def _dominant(spark, d):
    files = _files(spark, d)
    kept = H.T.prune_paths(files, H.T.PROFILER_IGNORED, keep_hidden=[".github"])
    return H.dominant_language(H.language_histogram(files), ["repository_id"], kept)


@query("directory_stats", _PATHS + f", {_STATS} SELECT * FROM st")
def _stats(spark, d):
    return H.directory_stats(_files(spark, d))


@query("test_files", _PATHS + f", {_FLAGS} SELECT repository_id, path FROM fl WHERE is_test")
def _test_files(spark, d):
    return H.test_files(_files(spark, d))


@query("test_dirs", _PATHS + f", {_TD} SELECT * FROM td")
def _test_dirs(spark, d):
    return H.test_dirs(H.directory_stats(_files(spark, d)))


_TYPE = """CASE WHEN level = 0 THEN CASE WHEN tests > 0 AND tests * 2 > programming THEN 'tests' ELSE 'source' END WHEN EXISTS (SELECT 1 FROM td WHERE td.repository_id = st.repository_id AND td.dir = st.dir) THEN 'tests' WHEN dir = 'docs' THEN 'docs' WHEN dir IN ('.github', 'requirements') THEN 'config' WHEN with_language > 0 THEN 'source' ELSE 'other' END"""
_COMP = f"""{_TD}, dl AS (SELECT repository_id, dir, language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, dir ORDER BY n DESC, language) AS rn FROM (SELECT repository_id, CASE WHEN depth = 0 THEN '.' ELSE split_part(path, '/', 1) END AS dir, language, count(*) AS n FROM fl WHERE language IS NOT NULL GROUP BY 1, 2, 3) a) b WHERE rn = 1),
 comp AS (SELECT st.*, {_TYPE} AS component_type FROM st WHERE level < 2 AND (level = 1 OR with_language > 0))"""


@query("component_type", _PATHS + f", {_COMP} SELECT component_type, count(*) AS n FROM comp GROUP BY 1")
def _component_type(spark, d):
    return H.components(_files(spark, d)).groupBy("component_type").agg(F.count("*").alias("n"))


@query(
    "components",
    _PATHS
    + f""", {_COMP} SELECT c.repository_id, c.dir AS path, component_type, upper(left(t, 1)) || substr(t, 2) || ' (' || files || CASE WHEN files = 1 THEN ' file)' ELSE ' files)' END AS description, files AS file_count
 FROM (SELECT c.*, concat_ws(' ', CASE WHEN component_type IN ('source', 'tests') THEN dl.language END, CASE component_type WHEN 'tests' THEN 'test' WHEN 'docs' THEN 'documentation' WHEN 'config' THEN 'configuration' ELSE component_type END, CASE WHEN level = 0 THEN 'files in the repository root' ELSE 'directory' END) AS t FROM comp c LEFT JOIN dl ON dl.repository_id = c.repository_id AND dl.dir = c.dir) c""",
)
def _components(spark, d):
    return H.components(_files(spark, d))


@query(
    "source_dirs",
    _PATHS
    + f""", {_COMP}, src AS (SELECT repository_id, dir FROM comp WHERE component_type = 'source' AND dir <> '.')
 SELECT * FROM src UNION ALL SELECT repository_id, dir FROM st n WHERE level = 2 AND programming > 0 AND split_part(dir, '/', 1) IN ('src', 'app', 'lib', 'packages') AND split_part(dir, '/', 2) <> 'tests' AND EXISTS (SELECT 1 FROM src p WHERE p.repository_id = n.repository_id AND p.dir = split_part(n.dir, '/', 1)) AND NOT EXISTS (SELECT 1 FROM td WHERE td.repository_id = n.repository_id AND td.dir = n.dir)""",
)
def _source_dirs(spark, d):
    return H.source_dirs(_files(spark, d))


@query(
    "dependency_files",
    _PATHS
    + f", {_FLAGS} SELECT repository_id, path FROM fl WHERE depth <= 3 AND (name = 'package.json' OR (name LIKE 'requirements%' AND name LIKE '%.txt') OR (path LIKE 'requirements/%' AND name LIKE '%.txt'))",
)
def _dependency_files(spark, d):
    return H.dependency_files(_files(spark, d))


@query(
    "project_hints",
    _PATHS
    + f""", {_COMP}, best AS (SELECT repository_id, language FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY n DESC, language) AS rn FROM (SELECT repository_id, language, count(*) AS n FROM fl WHERE language IS NOT NULL GROUP BY 1, 2) h) s WHERE rn = 1)
 SELECT f.repository_id, bool_or((name = 'conftest.py' AND depth <= 2) OR (name = 'requirements-dev.txt') OR (name = 'test_main.py' AND EXISTS (SELECT 1 FROM td WHERE td.repository_id = f.repository_id AND f.path LIKE td.dir || '/%'))) AS has_pytest,
 bool_or(EXISTS (SELECT 1 FROM td WHERE td.repository_id = f.repository_id)) AS has_tests_dir, max(CASE WHEN path = 'package.json' THEN 'jest  --ci' END) AS npm_test_script, bool_or(path = 'Dockerfile') AS has_dockerfile, bool_or(path = 'readme.md') AS readme_present, max(CASE WHEN path = 'package.json' THEN 'web-' || f.repository_id END) AS project_name
 FROM fl f GROUP BY 1""",
)
def _hints(spark, d):
    files = _files(spark, d)
    name = F.substring_index("path", "/", -1)
    content = F.when(
        name == "package.json", F.concat(F.lit('{"name": " web-'), F.col("repository_id").cast("string"), F.lit('", "scripts": {"test": "jest  --ci"}}'))
    ).when(name == "requirements-dev.txt", F.lit("flask\n  pytest>=7\n")).otherwise("")
    return H.project_hints(files.withColumn("content", content))


@query(
    "sync_components",
    ctes("fx_components", "fx_paths")
    + f", {_COMP} SELECT coalesce(s.repository_id, c.repository_id) AS repository_id, coalesce(s.path, c.dir) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN c.dir IS NULL THEN 'removed' ELSE 'updated' END AS action FROM fx_components s FULL JOIN comp c ON c.repository_id = s.repository_id AND c.dir = s.path",
)
def _sync(spark, d):
    observed = H.components(_files(spark, d))
    return H.sync_components(fixture(spark, d, "fx_components"), observed).select("repository_id", "path", "action")
