"""Domain tables derived from the generic test tables, as portable SQL.

The same text feeds Spark (``fixture(spark, dir, name)``) and the SQL check (``ctes(names)``). Every binding covers
its whole source table: no subset, sample or limit. Package names grow with ``part`` (eight parts share one name and
two ecosystems), so no key grows without bound when the tables do.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_PKG = (
    "CASE WHEN CAST(floor(p_partkey / 8.0) AS BIGINT) % 5 = 0 THEN 'python-core-' ELSE 'lib-core-' END"
    " || CAST(CAST(floor(p_partkey / 8.0) AS BIGINT) AS STRING)"
)
_ECO = "CASE WHEN p_partkey % 2 = 0 THEN 'PyPI' ELSE 'npm' END"
_VERSION = """CASE WHEN round(l_tax * 100) = 0 THEN NULL WHEN round(l_tax * 100) = 8 THEN 'not-a-version'
  ELSE CAST(l_linenumber AS STRING) || '.' || CAST(CAST(l_quantity AS INT) AS STRING) || '.' || CAST(CAST(round(l_discount * 100) AS INT) AS STRING)
   || CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN '-rc.' || CAST(l_linenumber AS STRING) ELSE '' END END"""

VIEWS: dict[str, str] = {
    "fx_repositories": """
SELECT c_custkey AS repository_id, c_name AS name,
 CASE WHEN c_custkey % 10 = 9 THEN upper('https://git.example/r' || CAST(c_custkey - 1 AS STRING)) ELSE 'https://git.example/r' || CAST(c_custkey AS STRING) END AS source_url,
 CASE WHEN c_nationkey % 2 = 0 THEN 'github' ELSE 'local' END AS source_type,
 CASE c_custkey % 3 WHEN 1 THEN 'main' WHEN 2 THEN 'dev' END AS branch FROM customer""",
    "fx_analyses": """
SELECT o_orderkey AS analysis_id, o_custkey AS repository_id, o_orderdate AS started_at,
 CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
 CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS INT) ELSE CAST(o_orderkey % 3600 AS INT) END AS heartbeat_age_s FROM orders""",
    "fx_dependencies": f"""
SELECT DISTINCT l_orderkey AS analysis_id, {_ECO} AS ecosystem,
 CASE WHEN p_partkey % 4 = 0 THEN upper(replace({_PKG}, '-', '_')) ELSE {_PKG} END AS package_name,
 {_VERSION} AS version,
 CASE WHEN l_linestatus = 'F' THEN 'main' ELSE 'dev' END AS source_file,
 CASE WHEN p_partkey % 2 = 0 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'direct' ELSE 'transitive' END AS scope
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # what the analyses of each repository depend on, without versions and files; rows repeat
    "fx_package_scopes": f"""
SELECT o_custkey AS repository_id, {_ECO} AS ecosystem,
 CASE WHEN p_partkey % 4 = 0 THEN upper(replace({_PKG}, '-', '_')) ELSE {_PKG} END AS package_name,
 CASE WHEN p_partkey % 2 = 0 THEN 'unknown' WHEN l_returnflag = 'R' THEN 'direct' ELSE 'transitive' END AS scope
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_advisories": f"""
SELECT CASE p_partkey % 3 WHEN 0 THEN 'GHSA-' WHEN 1 THEN 'CVE-' ELSE 'PYSEC-' END || CAST(p_partkey AS STRING) AS identifier,
 'CVE-A' || CAST(CAST(floor(p_partkey / 4.0) AS BIGINT) AS STRING) AS alias,
 {_ECO} AS ecosystem, {_PKG} AS package_name,
 CAST(p_size % 5 AS STRING) || '.0.0' AS introduced,
 CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 5 + 1 + p_size % 2 AS STRING) || '.' || CAST(p_size AS STRING) || '.0' END AS fixed,
 'CVSS:3.1/AV:' || substr('NALP', p_size % 4 + 1, 1) || '/AC:' || substr('LH', p_size % 2 + 1, 1) || '/PR:' || substr('NLH', p_size % 3 + 1, 1)
  || '/UI:' || substr('NR', CAST(p_partkey % 2 AS INT) + 1, 1) || '/S:' || substr('UC', CAST(p_partkey % 5 AS INT) % 2 + 1, 1)
  || '/C:' || substr('HLN', p_size % 3 + 1, 1) || '/I:' || substr('NLH', p_size % 3 + 1, 1) || '/A:' || substr('HLN', CAST(p_partkey % 3 AS INT) + 1, 1) AS cvss_vector
 FROM part""",
    # records without a CVE chained by shared aliases, sixteen to a chain, two CVE sets touching each chain
    "fx_alias_records": """
SELECT p_partkey AS p, CASE p_partkey % 2 WHEN 0 THEN 'GHSA-' ELSE 'PYSEC-' END || CAST(p_partkey AS STRING) AS identifier,
 'M-' || CAST(CAST(floor(p_partkey / 2.0) AS BIGINT) AS STRING) AS alias_m, CASE WHEN p_partkey % 16 <> 15 THEN 'N-' || CAST(CAST(floor((p_partkey + 1) / 2.0) AS BIGINT) AS STRING) END AS alias_n,
 CASE p_partkey % 16 WHEN 3 THEN 'CVE-X' || CAST(p_partkey AS STRING) WHEN 4 THEN 'CVE-X' || CAST(p_partkey - 1 AS STRING) WHEN 9 THEN 'CVE-X' || CAST(p_partkey AS STRING) END AS alias_cve FROM part""",
    "fx_releases": f"""
SELECT DISTINCT {_ECO} AS ecosystem, {_PKG} AS package_name,
 CAST(p_size % 12 AS STRING) || '.' || CAST(p_partkey % 10 AS STRING) || '.0' || CASE WHEN p_partkey % 13 = 0 THEN '-rc.1' ELSE '' END AS version,
 p_partkey % 11 = 0 AS withdrawn FROM part""",
    "fx_components": """
SELECT DISTINCT o_custkey AS repository_id, CASE o_orderkey % 5 WHEN 0 THEN '.' WHEN 1 THEN 'src' WHEN 2 THEN 'src/app' WHEN 3 THEN 'tests' ELSE 'docs' END AS path FROM orders""",
    "fx_lines": f"""
SELECT o_custkey AS repository_id,
 CASE l_orderkey % 4 WHEN 0 THEN 'src/app/f' WHEN 1 THEN 'src/f' WHEN 2 THEN 'tests/f' ELSE 'f' END || CAST(l_orderkey AS STRING) || '.py' AS path, l_linenumber AS line_no,
 CASE l_linenumber % 5 WHEN 0 THEN 'import ' || replace({_PKG}, '-', '_') WHEN 1 THEN 'from ' || replace({_PKG}, '-', '_') || '.core import x' WHEN 2 THEN '# import ' || replace({_PKG}, '-', '_')
  WHEN 3 THEN 'import os, ' || replace({_PKG}, '-', '_') || ' as z' ELSE 'x = 1' END AS text
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "fx_relations": """
SELECT DISTINCT a.l_orderkey AS analysis_id, a.l_partkey AS parent, b.l_partkey AS child FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
 AND (b.l_linenumber = a.l_linenumber + 1 OR (a.l_orderkey % 5 = 0 AND a.l_linenumber = 3 AND b.l_linenumber = 1)) WHERE a.l_partkey <> b.l_partkey""",
    "fx_remediations": """
SELECT o_orderkey AS remediation_id, o_custkey AS finding_id, o_orderdate AS created_at,
 CASE o_orderkey % 4 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIPPED' ELSE 'PASS' END AS test_status, CASE WHEN o_orderkey % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS build_status,
 CASE WHEN o_orderkey % 6 = 0 THEN 'UNKNOWN' ELSE 'PASS' END AS security_scan_status, CASE WHEN o_orderkey % 10 = 3 THEN 'FAILED' ELSE 'COMPLETED' END AS validation_status FROM orders""",
    "fx_verdicts": """
SELECT DISTINCT l_orderkey AS analysis_id, l_suppkey % 8 AS slot, CASE l_suppkey % 8 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'NONE' WHEN 5 THEN 'UNKNOWN' WHEN 6 THEN 'garbage' END AS judged_risk FROM lineitem""",
    "fx_heartbeats": """
SELECT event_id, user_id AS job_id, ts AS seen_at, event_type AS stage, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'OK' ELSE 'RUNNING' END AS status FROM events""",
    # version texts in every shape the grammars know, one per line item
    "fx_versions": """
SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'PyPI' ELSE 'npm' END AS ecosystem,
 CASE l_suppkey % 13 WHEN 0 THEN 'v' || n || '.' || q || '.' || d WHEN 1 THEN n WHEN 2 THEN n || '.' || q WHEN 3 THEN n || '.' || q || '.' || d || '-alpha.' || q
  WHEN 4 THEN n || '.' || q || '.' || d || '+b' || q WHEN 5 THEN '0' || n || '.1.2' WHEN 6 THEN n || '.' || q || '.' || d || '-' || q || '.x' WHEN 7 THEN n || '!' || q || '.0.0'
  WHEN 8 THEN n || '.' || q || '.post' || d WHEN 9 THEN n || '.' || q || '.dev' || d WHEN 10 THEN n || '.' || q || 'rc' || d || '.dev' || n WHEN 11 THEN 'latest' ELSE n || '.' || q || '.0' END AS version
 FROM (SELECT l_partkey, l_suppkey, CAST(l_linenumber AS STRING) AS n, CAST(CAST(l_quantity AS INT) AS STRING) AS q, CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS d FROM lineitem) s""",
    # npm specifiers and tags
    "fx_specs": """
SELECT DISTINCT CASE l_suppkey % 16 WHEN 0 THEN n || '.' || q || '.' || d WHEN 1 THEN '=' || n || '.' || q || '.' || d WHEN 2 THEN 'v' || n || '.' || q || '.' || d WHEN 3 THEN '^' || n || '.' || q || '.' || d
  WHEN 4 THEN '~' || n || '.' || q || '.' || d WHEN 5 THEN '>=' || n || '.' || q || '.' || d WHEN 6 THEN '>=' || n || '.0.0 <' || q || '.0.0' WHEN 7 THEN 'file:../pkg' || q WHEN 8 THEN 'git+https://git.example/a' || q || '.git'
  WHEN 9 THEN 'acme/repo' || q || '#main' WHEN 10 THEN 'npm:other@^' || n WHEN 11 THEN 'latest' WHEN 12 THEN '*' WHEN 13 THEN 'GitHub:acme/x' || q WHEN 14 THEN n || '.' || q || '.' || d || '-beta.1+b' ELSE '=v' || n || '.' || q || '.' || d END AS spec
 FROM (SELECT l_suppkey, CAST(l_linenumber AS STRING) AS n, CAST(CAST(l_quantity AS INT) AS STRING) AS q, CAST(CAST(round(l_discount * 100) AS INT) AS STRING) AS d FROM lineitem) s""",
    # whole documents with credentials planted in them
    "fx_texts": """
SELECT doc_id, replace(replace(replace(text, 'token = "', 'token = '), ', ', ' https://deploy:' || CAST(doc_id AS STRING) || '@git.example/x '), '? ', ' ghp_aaaabbbbccccddddeeeeffff ') || ' api_key=k' || CAST(doc_id AS STRING) || ' v==2' AS text FROM documents""",
    # whole documents turned into requirement-like files: continuations and comments
    "fx_manifest_texts": """
SELECT doc_id AS repository_id, source || '/requirements-' || lang || '.txt' AS path, replace(replace(text, ', ', ' \\' || chr(10)), '. ', ' # note' || chr(10)) AS content FROM documents""",
    "fx_paths": """
SELECT o_orderkey AS file_id, o_custkey AS repository_id,
 CASE o_orderkey % 9 WHEN 0 THEN 'src/app/' WHEN 1 THEN 'src/node_modules/x/' WHEN 2 THEN 'tests/' WHEN 3 THEN '' WHEN 4 THEN '.github/workflows/' WHEN 5 THEN 'docs/build/' WHEN 6 THEN 'requirements/' WHEN 7 THEN '.idea/' ELSE 'lib/env/' END
 || CASE o_orderkey % 11 WHEN 0 THEN 'main.py' WHEN 1 THEN 'test_main.py' WHEN 2 THEN 'index.js' WHEN 3 THEN 'requirements-dev.txt' WHEN 4 THEN 'requirements-latest.txt' WHEN 5 THEN 'package.json' WHEN 6 THEN 'App.TSX' WHEN 7 THEN 'readme.md' WHEN 8 THEN 'base_pytest.txt' WHEN 9 THEN 'conftest.py' ELSE 'Dockerfile' END AS path
 FROM orders""",
    # installed npm entries of one lock file per analysis, nested below other packages at times
    "fx_lock_entries": f"""
SELECT l_orderkey AS repository_id, 'package-lock.json' AS lock_path,
 CASE WHEN l_linenumber <= 4 THEN 'node_modules/p' || CAST(l_partkey % 10 AS STRING) WHEN l_linenumber <= 6 THEN 'node_modules/p' || CAST(l_suppkey % 10 AS STRING) || '/node_modules/p' || CAST(l_partkey % 10 AS STRING)
  ELSE 'node_modules/p' || CAST(l_suppkey % 10 AS STRING) || '/node_modules/p' || CAST(l_suppkey % 7 AS STRING) || '/node_modules/@s/p' || CAST(l_partkey % 10 AS STRING) END AS lock_key,
 min({_VERSION}) AS version, 'p' || CAST(min(l_suppkey % 10) AS STRING) AS dep_a, 'p' || CAST(max(l_partkey % 7) AS STRING) AS dep_b, bool_and(l_returnflag = 'R') AS dev
 FROM lineitem GROUP BY 1, 2, 3""",    # one requirement file per line item, every kind of line in it
    "fx_requirement_files": f"""
SELECT l_orderkey AS repository_id, 'svc/requirements-' || CAST(l_linenumber AS STRING) || '.txt' AS path, {_PKG} AS pkg, {_VERSION} AS version,
 '# deps' || chr(10) || {_PKG} || '[extra1]' || coalesce('==' || {_VERSION}, '') || ' \\' || chr(10) || '    --hash=sha256:abc  # pinned' || chr(10) || '-r ../common/base.txt' || chr(10) || 'git+https://git.example/acme.git#egg=egg_' || CAST(l_partkey AS STRING) || chr(10)
 || 'https://files.example/x.whl' || chr(10) || 'Other.' || CAST(l_partkey AS STRING) || ' >=1.0,<2 ; python_version > "3.8"' || chr(10) || '!!garbage line' || chr(10) || '-e ./local' AS content
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_package_json": """
SELECT l_orderkey AS repository_id, l_linenumber AS line_no, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'packages/a' WHEN 2 THEN 'packages/b' ELSE 'examples/x' END AS directory,
 min(l_partkey) AS part, CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'packages/a/' WHEN 2 THEN 'packages/b/' ELSE 'examples/x/' END || 'package.json' AS path,
 '{"name": "app", "dependencies": {"p' || CAST(min(l_partkey) AS STRING) || '": "^1.2.3", "shared": "1.0.0"}, "devDependencies": {"d' || CAST(min(l_partkey) AS STRING) || '": " ~2 ", "shared": "2.0.0"}, "peerDependencies": {"q": "*"}}' AS content
 FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    # manifests of nested workspaces and one lock per repository, as files
    "fx_npm_dirs": """
SELECT repository_id, directory, path, CAST(min(part) AS STRING) AS part FROM fx_package_json GROUP BY repository_id, directory, path""",
    "fx_npm_files": """
SELECT repository_id, path, '{"name": "app", ' || CASE WHEN directory = '' THEN '"workspaces": ["packages/*"], ' ELSE '' END || '"dependencies": {"p' || part || '": "^1.2.3", "fix": "2.0.0"}, "devDependencies": {"d' || part || '": "~2"}}' AS content FROM fx_npm_dirs UNION ALL
SELECT repository_id, 'package-lock.json', '{"lockfileVersion": 3, "packages": {"": {"name": "app"}, "packages/a": {"version": "1.0.0"}, ' || string_agg(DISTINCT '"node_modules/p' || part || '": {"version": "1.2.' || part || '", "dependencies": {"tiny": "*"}}', ', ') || ', "node_modules/fix": {"version": "2.0.0"}, "node_modules/tiny": {"version": "0.1.0", "dev": true}}}' FROM fx_npm_dirs GROUP BY repository_id UNION ALL
SELECT repository_id, 'tools/yarn.lock', '# v1' FROM fx_npm_dirs WHERE repository_id % 5 = 0 GROUP BY repository_id""",
    "fx_direct": """
SELECT DISTINCT l_orderkey AS repository_id, 'p' || CAST(l_suppkey % 10 AS STRING) AS package_name, CASE l_partkey % 4 WHEN 0 THEN '^1.0.0' WHEN 1 THEN '2.' || CAST(l_linenumber AS STRING) || '.0' WHEN 2 THEN 'file:../x' ELSE 'latest' END AS version_spec FROM lineitem""",
    "fx_dep_ids": f"""
SELECT l_orderkey AS analysis_id, {_ECO} AS ecosystem, {_PKG} AS norm_name, {_VERSION} AS version, l_partkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS dependency_id
 FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_named_relations": """
SELECT a.analysis_id, a.ecosystem, a.norm_name AS parent_name, a.version AS parent_version, b.norm_name AS child_name, CASE WHEN b.dependency_id % 10 = 0 THEN '99.0.0' ELSE b.version END AS child_version
 FROM fx_dep_ids a JOIN fx_dep_ids b ON a.analysis_id = b.analysis_id AND a.ecosystem = b.ecosystem AND a.dependency_id < b.dependency_id""",
    "fx_js_lines": f"""
SELECT o_custkey AS repository_id, 'web/f' || CAST(l_orderkey AS STRING) || '.ts' AS path, l_linenumber AS line_no,
 CASE l_linenumber % 6 WHEN 0 THEN 'const a = require("' || {_PKG} || '/lib/x")' WHEN 1 THEN 'import y from ' || chr(39) || '@acme/' || {_PKG} || chr(39) WHEN 2 THEN '// import z from "' || {_PKG} || '"' WHEN 3 THEN 'await import(`' || {_PKG} || '`)' WHEN 4 THEN 'import "' || {_PKG} || '-es"' ELSE 'export * from "./' || {_PKG} || '"' END AS text, {_PKG} AS pkg
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    # the searched files of both ecosystems, one line per line item; every ninth repository was never searched
    "fx_source_lines": f"""
SELECT o_custkey AS repository_id, {_ECO} AS ecosystem, {_PKG} AS pkg, l_linenumber AS line_no,
 CASE WHEN l_linenumber = 6 THEN 'svc' || CAST(l_orderkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '/requirements.txt' ELSE '/package.json' END
  ELSE CASE l_orderkey % 3 WHEN 0 THEN 'src/app/f' WHEN 1 THEN 'src/f' ELSE 'f' END || CAST(l_orderkey AS STRING) || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.ts' END END AS path,
 CASE WHEN l_linenumber = 6 AND p_partkey % 2 = 0 THEN {_PKG} || '==1.0' WHEN l_linenumber = 6 THEN '  "' || {_PKG} || '": "^1.0",'
  WHEN p_partkey % 2 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN 'import ' || replace({_PKG}, '-', '_') || '.core as z' WHEN 1 THEN 'from ' || replace({_PKG}, '-', '_') || ' import x' WHEN 2 THEN '# import ' || replace({_PKG}, '-', '_') ELSE 'x = 1' END
  ELSE CASE l_linenumber % 4 WHEN 0 THEN 'const a = require("' || {_PKG} || '/lib/x")' WHEN 1 THEN 'import y from "' || {_PKG} || '"' WHEN 2 THEN '// import z from "' || {_PKG} || '"' ELSE 'import "' || {_PKG} || '-es"' END END AS text
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey % 9 <> 4""",
    # their listing, with sources nobody could read, ignored directories and other files
    "fx_scan_files": """
SELECT DISTINCT repository_id, path, false AS is_too_large FROM fx_source_lines UNION ALL
SELECT o_custkey, CASE o_orderkey % 50 WHEN 0 THEN 'src/big' || CAST(o_orderkey AS STRING) || '.py' WHEN 1 THEN 'node_modules/x/big' || CAST(o_orderkey AS STRING) || '.js' ELSE 'n' || CAST(o_orderkey AS STRING) || '.md' END, o_orderkey % 50 < 2 FROM orders WHERE o_custkey % 9 <> 4""",
    "fx_token_manifests": f"""
SELECT l_orderkey AS repository_id, {_PKG} AS pkg, CASE l_linenumber % 3 WHEN 0 THEN 'toml' WHEN 1 THEN 'py' ELSE 'cfg' END AS kind,
 CAST(l_linenumber AS STRING) || '/' || CAST(p_partkey AS STRING) || '/' || CASE l_linenumber % 3 WHEN 0 THEN 'pyproject.toml' WHEN 1 THEN 'setup.py' ELSE 'setup.cfg' END AS path,
 CASE l_linenumber % 3 WHEN 0 THEN '[project]' || chr(10) || 'name = "' || {_PKG} || '"' || chr(10) || 'dependencies = [' || chr(10) || '  "' || {_PKG} || '>=1.0",' || chr(10) || '  "other[x]; python_version<3",' || chr(10) || ']' || chr(10) || 'keywords = ["' || {_PKG} || '"]' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || replace({_PKG}, '-', '_') || ' = "^1"' || chr(10) || '[tool.mypy]' || chr(10) || {_PKG} || ' = "x"'
 WHEN 1 THEN 'setup(' || chr(10) || '    name="' || {_PKG} || '",' || chr(10) || '    install_requires=["' || {_PKG} || '>=1", "zzz"],' || chr(10) || '    extras_require={{' || chr(10) || '        "dev": ["' || upper({_PKG}) || '"],' || chr(10) || '    }},' || chr(10) || '    keywords="' || {_PKG} || '",' || chr(10) || ')'
 ELSE '[options]' || chr(10) || 'install_requires =' || chr(10) || '    ' || {_PKG} || '>=1' || chr(10) || '    zzz' || chr(10) || 'description = ' || {_PKG} || chr(10) || '[options.extras_require]' || chr(10) || 'dev = zzz; ' || {_PKG} || '==2' END AS content
 FROM (SELECT DISTINCT l_orderkey, l_linenumber, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey) s""",
}

#: bindings whose consumers parse text: worth spreading when the source is a single small file
TEXT_BOUND = {
    "fx_requirement_files", "fx_token_manifests", "fx_package_json", "fx_texts", "fx_manifest_texts", "fx_lines", "fx_js_lines", "fx_source_lines",
}

_NEEDS = {name: [t for t in (*TABLES, *VIEWS) if t != name and re.search(rf"\b{t}\b", sql)] for name, sql in VIEWS.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A binding as DataFrame; the source tables are passed as query arguments, no temporary views.

    ``given`` are source tables by name that a query has filtered already.
    """
    sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
    frames = {}
    for source in _NEEDS[name]:
        if source in given:
            frames[source] = given[source]
        else:
            frames[source] = fixture(spark, sf_dir, source, **given) if source in VIEWS else table(spark, sf_dir, source)
        sql = re.sub(rf"(FROM|JOIN) {source}\b", rf"\1 {{{source}}}", sql)
    # Spark string literals know escapes, the portable text means one backslash
    rows = spark.sql(sql.replace("\\", "\\\\"), **frames)
    spread = spark.conf.get("fleetlens.spread", None)
    # the bench and the tests ask for it, as their tables are one small file each; a large table has a task per split
    return rows.repartition(int(spread)) if spread and name in TEXT_BOUND else rows


def ctes(*names: str) -> str:
    """``WITH`` prefix that defines the named bindings (and what they need) for the SQL check."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            if needed in VIEWS:
                add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].replace('AS STRING', 'AS VARCHAR')})" for n in ordered)
