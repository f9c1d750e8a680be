"""Repository profiles of the whole fleet (H1-H11). Input is a file table (repository_id, path[, content])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as T
from fleetlens.functions.scores import lookup
from fleetlens.functions.versions import strip

# File extensions, directory names and manifest names the profile knows.
LANGUAGES = {
    "py": "Python", "pyi": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "java": "Java", "go": "Go",
    "rs": "Rust", "rb": "Ruby", "php": "PHP", "cs": "C#", "sh": "Shell", "bash": "Shell", "html": "HTML",
    "htm": "HTML", "css": "CSS", "scss": "CSS",
}
PROGRAMMING = ["Python", "JavaScript", "TypeScript", "Java", "Go", "Rust", "Ruby", "PHP", "C#"]
TEST_DIRS = ["tests", "test", "__tests__", "spec", "specs", "testing"]
DOC_DIRS = ["docs", "doc", "documentation"]
CONFIG_DIRS = [".github", "config", "configs", "ci", "deploy", "deployment", "docker", "k8s", "infra", "requirements"]
SCRIPT_DIRS = ["scripts", "script", "bin", "tools"]
LAYOUT_DIRS = ["src", "app", "lib", "packages"]
DEPENDENCY_FILES = [
    "package.json", "package-lock.json", "pyproject.toml", "Pipfile", "Pipfile.lock", "poetry.lock", "setup.py",
    "setup.cfg", "yarn.lock", "pnpm-lock.yaml",
]
TEST_FILE = r"^(test_.*\.py|.*_test\.py|conftest\.py|.*\.(test|spec)\.(js|jsx|ts|tsx|mjs|cjs))$"
PYTHON_TEST_FILE = r"^(test_.*\.py|.*_test\.py)$"
DOCKERFILE = r"^(dockerfile|dockerfile\..*|.*\.dockerfile)$"
MAX_DEPENDENCY_DEPTH, MAX_TEST_DEPTH = 3, 2


def depth(path: Column) -> Column:
    """Directories between the root and the file."""
    return F.size(F.split(path, "/")) - 1


def detect_language(path: Column) -> Column:
    """H1: language by the file extension, null when unknown."""
    return lookup(LANGUAGES, F.lower(F.regexp_extract(T.base_name(path), r"^.+\.([^.]+)$", 1)))


def _flags(files: DataFrame) -> DataFrame:
    path = F.col("path")
    rows = T.prune_paths(files, T.PROFILER_IGNORED, keep_hidden=T.PROFILER_HIDDEN_KEPT)
    return rows.select(
        "repository_id",
        "path",
        detect_language(path).alias("language"),
        T.base_name(path).rlike(TEST_FILE).alias("is_test"),
        depth(path).alias("depth"),
    )


def language_histogram(files: DataFrame) -> DataFrame:
    """H2: files per repository and language; ``rank`` is count descending, then name."""
    return (
        _flags(files).filter("language IS NOT NULL").groupBy("repository_id", "language").agg(F.count("*").alias("files"))
    )


def dominant_language(histogram: DataFrame, keys: list[str], manifests: DataFrame | None = None) -> DataFrame:
    """H3: the programming language with most files, else any language, else what the manifest names say."""
    order = F.struct((~F.col("language").isin(*PROGRAMMING)).alias("markup"), (-F.col("files")).alias("n"), F.col("language"))
    rows = histogram.groupBy(*keys).agg(F.min_by("language", order).alias("language"))
    if manifests is None:
        return rows
    name = T.base_name(F.col("path"))
    python = name.startswith("requirements") | name.isin("pyproject.toml", "Pipfile", "setup.py")
    hints = manifests.groupBy(*keys).agg(F.bool_or(python).alias("py"), F.bool_or(name == "package.json").alias("js"))
    guess = F.when(F.col("py"), "Python").when(F.col("js"), "JavaScript")
    return hints.join(rows, keys, "full").select(*keys, F.coalesce("language", guess).alias("language"))


def directory_stats(files: DataFrame) -> DataFrame:
    """H4: counts per directory: level 0 the root files, level 1 the top directories, level 2 their children.

    One pass: each file is emitted for its one or two directories and aggregated map-side.
    """
    parts = F.split("path", "/")
    places = F.when(F.col("depth") == 0, F.array(F.struct(F.lit(".").alias("dir"), F.lit(0).alias("level")))).otherwise(
        F.filter(
            F.array(
                F.struct(parts[0].alias("dir"), F.lit(1).alias("level")),
                F.when(F.col("depth") >= 2, F.struct(F.concat(parts[0], F.lit("/"), F.get(parts, F.lit(1))).alias("dir"), F.lit(2).alias("level"))),
            ),
            lambda p: p.isNotNull(),
        )
    )
    rows = _flags(files).select("repository_id", "language", "is_test", F.explode(places).alias("p")).select("*", "p.*")
    return rows.groupBy("repository_id", "dir", "level").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("language").isin(*PROGRAMMING)).alias("programming"),
        F.count_if("is_test").alias("tests"),
        F.count("language").alias("with_language"),
    )


def directory_languages(files: DataFrame) -> DataFrame:
    """Files per (repository_id, dir, language) of the root and the top directories."""
    top = F.when(F.col("depth") == 0, F.lit(".")).otherwise(F.substring_index("path", "/", 1))
    rows = _flags(files).filter("language IS NOT NULL").withColumn("dir", top)
    return rows.groupBy("repository_id", "dir", "language").agg(F.count("*").alias("files"))


def test_files(files: DataFrame) -> DataFrame:
    return _flags(files).filter("is_test").select("repository_id", "path")


def test_dirs(stats: DataFrame) -> DataFrame:
    """H5: outermost test directories: by name, or more than half as many test files as program files."""
    name = F.substring_index("dir", "/", -1)
    is_test = name.isin(*TEST_DIRS) | ((F.col("tests") > 0) & (F.col("tests") * 2 > F.col("programming")))
    found = stats.filter((F.col("level") > 0) & is_test).select("repository_id", "dir", "level")
    top = found.filter("level = 1").select("repository_id", "dir")
    nested = found.filter("level = 2").select("repository_id", F.substring_index("dir", "/", 1).alias("_top"), "dir")
    covered = top.withColumnRenamed("dir", "_top")
    return top.unionByName(nested.join(covered, ["repository_id", "_top"], "left_anti").select("repository_id", "dir"))


def component_type(name: Column, is_test: Column, with_language: Column) -> Column:
    """H6: tests, docs, config, scripts, source or other, in this order."""
    return (
        F.when(is_test, "tests")
        .when(name.isin(*DOC_DIRS), "docs")
        .when(name.isin(*CONFIG_DIRS), "config")
        .when(name.isin(*SCRIPT_DIRS), "scripts")
        .when(with_language > 0, "source")
        .otherwise("other")
    )


def components(files: DataFrame) -> DataFrame:
    """H7: the root when it holds source files, and one component per top directory, with description and count."""
    stats = directory_stats(files)
    tests = test_dirs(stats).withColumn("is_test", F.lit(True))
    languages = dominant_language(directory_languages(files), ["repository_id", "dir"])
    rows = stats.filter("level < 2 AND (level = 1 OR with_language > 0)")
    rows = rows.join(tests, ["repository_id", "dir"], "left").join(languages, ["repository_id", "dir"], "left")
    root = F.col("level") == 0
    mostly = (F.col("tests") > 0) & (F.col("tests") * 2 > F.col("programming"))
    kind = F.when(root, F.when(mostly, "tests").otherwise("source")).otherwise(
        component_type(F.col("dir"), F.coalesce("is_test", F.lit(False)), F.col("with_language"))
    )
    word = lookup(
        {"source": "source", "tests": "test", "docs": "documentation", "config": "configuration", "scripts": "scripts", "other": "other"},
        F.col("component_type"),
    )
    shown = F.when(F.col("component_type").isin("source", "tests"), F.col("language"))
    text = F.concat_ws(" ", shown, word, F.when(root, "files in the repository root").otherwise("directory"))
    text = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    plural = F.when(F.col("files") == 1, " file)").otherwise(" files)")
    return rows.withColumn("component_type", kind).select(
        "repository_id",
        F.col("dir").alias("path"),
        "component_type",
        F.concat(text, F.lit(" ("), F.col("files").cast("string"), plural).alias("description"),
        F.col("files").alias("file_count"),
    )


def source_dirs(files: DataFrame) -> DataFrame:
    """H8: source components and the children of layout directories such as ``src``."""
    stats = directory_stats(files)
    tests = test_dirs(stats)
    top = components(files).filter("component_type = 'source' AND path <> '.'").select("repository_id", F.col("path").alias("dir"))
    child = F.substring_index("dir", "/", -1)
    nested = stats.filter((F.col("level") == 2) & (F.col("programming") > 0) & ~child.isin(*TEST_DIRS)).select(
        "repository_id", "dir", F.substring_index("dir", "/", 1).alias("_top")
    )
    nested = nested.filter(F.col("_top").isin(*LAYOUT_DIRS)).join(tests, ["repository_id", "dir"], "left_anti")
    nested = nested.join(top.withColumnRenamed("dir", "_top"), ["repository_id", "_top"], "left_semi")
    return top.unionByName(nested.select("repository_id", "dir"))


def dependency_files(files: DataFrame) -> DataFrame:
    """H9: known manifests within three directories of the root."""
    rows = T.prune_paths(files, T.PROFILER_IGNORED, keep_hidden=T.PROFILER_HIDDEN_KEPT)
    name = T.base_name(F.col("path"))
    known = name.isin(*DEPENDENCY_FILES) | name.rlike(r"^requirements.*\.txt$") | F.col("path").rlike(r"(^|/)requirements/[^/]*\.txt$")
    return rows.filter(known & (depth(F.col("path")) <= MAX_DEPENDENCY_DEPTH)).select("repository_id", "path")


def project_hints(files: DataFrame) -> DataFrame:
    """Test runner, scripts, container and readme flags and the project name, one row per repository."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    kept = T.prune_paths(files, T.PROFILER_IGNORED, keep_hidden=T.PROFILER_HIDDEN_KEPT)
    tests = test_dirs(directory_stats(files))
    name, level = T.base_name(path), depth(path)
    root = level == 0
    script = F.get_json_object(F.when(path == "package.json", content), "$.scripts.test")
    normal = strip(F.regexp_replace(script, r"(?U)\s+", " "))
    pytest_signs = (
        (path == "pytest.ini")
        | ((name == "conftest.py") & (level <= MAX_TEST_DEPTH))
        | ((path == "pyproject.toml") & content.contains("[tool.pytest"))
        | ((path == "setup.cfg") & content.contains("[tool:pytest]"))
        | ((path == "tox.ini") & content.rlike(r"(?m)^\[pytest\]"))
        | (name.rlike(r"^requirements.*\.txt$") & (level <= MAX_DEPENDENCY_DEPTH) & content.rlike(r"(?im)^[ \t]*pytest\b"))
    )
    section = r"(?s)(?:^|\n)\[(?:project|tool\.poetry)\][^\[]*?\nname\s*=\s*[\"']([^\"'\n]*)[\"']"
    python_name = F.nullif(strip(F.regexp_extract(F.when(path == "pyproject.toml", content), section, 1)), F.lit(""))
    npm_name = F.nullif(strip(F.get_json_object(F.when(path == "package.json", content), "$.name")), F.lit(""))
    flags = kept.groupBy("repository_id").agg(
        F.bool_or(pytest_signs).alias("_pytest"),
        F.max(F.when((normal != "") & ~normal.contains("no test specified"), strip(script))).alias("npm_test_script"),
        F.bool_or(root & F.lower(name).rlike(DOCKERFILE)).alias("has_dockerfile"),
        F.bool_or(root & F.lower(name).startswith("readme")).alias("readme_present"),
        F.max(python_name).alias("_python_name"),
        F.max(npm_name).alias("_npm_name"),
    )
    inside = kept.filter(name.rlike(PYTHON_TEST_FILE)).select(
        "repository_id", F.explode(T.ancestors(T.parent_dir(path))).alias("dir")
    )
    in_tests = inside.join(tests, ["repository_id", "dir"], "left_semi").select("repository_id").distinct().withColumn("_in_tests", F.lit(True))
    any_tests = tests.select("repository_id").distinct().withColumn("_has_dir", F.lit(True))
    language = dominant_language(language_histogram(files), ["repository_id"])
    rows = flags.join(in_tests, "repository_id", "left").join(any_tests, "repository_id", "left").join(language, "repository_id", "left")
    web = F.col("language").isin("JavaScript", "TypeScript")
    return rows.select(
        "repository_id",
        (F.col("_pytest") | F.coalesce("_in_tests", F.lit(False))).alias("has_pytest"),
        F.coalesce("_has_dir", F.lit(False)).alias("has_tests_dir"),
        "npm_test_script",
        "has_dockerfile",
        "readme_present",
        F.when(web, F.coalesce("_npm_name", "_python_name")).otherwise(F.coalesce("_python_name", "_npm_name")).alias("project_name"),
    )


def sync_components(stored: DataFrame, observed: DataFrame) -> DataFrame:
    """What a re-profile does to the stored components: added, updated or removed, by path."""
    keys = ["repository_id", "path"]
    old = stored.select(*keys, F.lit(True).alias("_old"))
    new = observed.select("*", F.lit(True).alias("_new"))
    action = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("updated")
    return old.join(new, keys, "full").withColumn("action", action).drop("_old", "_new")
