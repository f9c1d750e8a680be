"""Source-usage evidence for all repositories and packages at once.

Each source line is looked at once: the modules it imports are extracted as tokens and meet the wanted packages in
an equi-join on (repository_id, import name). There is never one pattern per package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as T
from fleetlens.functions import versions as V
from fleetlens.functions.importnames import PYTHON_IMPORT_NAMES
from fleetlens.functions.versions import bind, strip
from fleetlens.session import cut_lineage
from fleetlens.skew import top_per_key

# File kinds and the words that mark dependency tables and keys.
PYTHON_SUFFIX = r"\.py$"
JS_SUFFIX = r"\.(js|jsx|ts|tsx|mjs|cjs|vue)$"
TOKEN_MANIFESTS = ["pyproject.toml", "setup.cfg", "setup.py", "Pipfile"]
DEPENDENCY_SECTION = r"(?i)require|depend|extras|^(?:dev-)?packages$"
DEPENDENCY_KEY = r"(?i)require|depend|deps"
KEY_ASSIGNMENT = r"(?<![\w\"'.\-])([A-Za-z_][\w.\-]*)\s*=(?!=)"
SECTION_HEADER = r"^\s*\[\[?\s*([^\]]*?)\s*\]\]?"
INI_KEY = r"^([A-Za-z_][\w.\-]*)\s*[=:]\s*(.*)$"
QUOTED_REQUIREMENT = r"(?<quote>[\"'])\s*[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\]\s*)?(?:[<>=!~;@(]|\k<quote>)"

LINE = ["repository_id", "path", "line_no"]


# ---------------------------------------------------------------- names


def _candidate_names(name: Column, ecosystem: Column) -> Column:
    """The import names of a package as an array, most likely name first."""
    curated = F.create_map(*[F.lit(x) for pair in PYTHON_IMPORT_NAMES.items() for x in pair])
    key = V.normalize_package_name(name, F.lit(V.PYPI))
    cleaned = F.lower(strip(name))
    base = F.regexp_replace(F.regexp_replace(cleaned, r"(?U)[-.\s]+", "_"), "^_+|_+$", "")
    stripped = F.regexp_replace(F.regexp_replace(base, "^(?:python_|py_)", ""), "_python$", "")
    dotted = F.when(
        cleaned.contains("."), F.regexp_replace(F.regexp_replace(cleaned, r"(?U)[-\s]+", "_"), "^[_.]+|[_.]+$", "")
    )
    derived = F.array_distinct(
        F.filter(
            F.array(base, F.regexp_replace(stripped, "^_+|_+$", ""), dotted), lambda n: n.isNotNull() & (n != "")
        )
    )
    python = bind(F.try_element_at(curated, key), lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(derived))
    return F.when(ecosystem == V.PYPI, python).otherwise(F.array(strip(name)))


def _spellings(name: Column, package: Column, ecosystem: Column) -> Column:
    """The spellings of an import name that the matchers try, as an array."""
    capital = F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, F.lit(2), F.length(name))))
    original = F.regexp_replace(F.regexp_replace(strip(package), r"(?U)[-.\s]+", "_"), "^_+|_+$", "")
    return F.when(
        ecosystem == V.PYPI, F.filter(F.array_distinct(F.array(name, F.lower(name), capital, original)), lambda n: n != "")
    ).otherwise(F.array(name))


def import_name_candidates(packages: DataFrame) -> DataFrame:
    """G1: (…, import_name, position) for PyPI and npm packages, most likely name first.

    The curated table wins; otherwise the name with ``-``, ``.`` and blanks as ``_``, without a ``python_``/``py_``
    head and a ``_python`` tail, and the dotted form of a namespace package. npm packages import under their name.
    """
    names = _candidate_names(F.col("package_name"), F.col("ecosystem"))
    return packages.select("*", F.posexplode(names).alias("position", "import_name"))


def name_variants(candidates: DataFrame) -> DataFrame:
    """The spellings the Python matcher tries: as is, lower case, capitalised, and the original name."""
    spelled = _spellings(F.col("import_name"), F.col("package_name"), F.col("ecosystem"))
    return candidates.select(*[c for c in candidates.columns if c not in ("import_name", "position")], F.explode(spelled).alias("import_name")).distinct()


NAMED = ["searched", "spelled", "norm_name"]


def with_names(wanted: DataFrame) -> DataFrame:
    """Distinct (repository_id, ecosystem, package_name) with the names of the package: searched[] (G1), spelled[] (G2), norm_name.

    Names are worked out once per package, however many repositories want it, and stored with the rows, as every matcher
    and the evidence read them. Rows that have their names pass through.
    """
    if set(NAMED) <= set(wanted.columns):
        return wanted
    rows = wanted.select("repository_id", "ecosystem", "package_name").distinct()
    name, ecosystem = F.col("package_name"), F.col("ecosystem")
    packages = wanted.select("ecosystem", "package_name").distinct().withColumn("searched", _candidate_names(name, ecosystem))
    spelled = F.array_distinct(F.flatten(F.transform("searched", lambda n: _spellings(n, name, ecosystem))))
    packages = cut_lineage(packages.withColumn("spelled", spelled).withColumn("norm_name", V.normalize_package_name(name, ecosystem)))
    packages = packages.withColumnsRenamed({"ecosystem": "_ecosystem", "package_name": "_package"})
    met = rows.join(packages, ecosystem.eqNullSafe(F.col("_ecosystem")) & name.eqNullSafe(F.col("_package")))
    return cut_lineage(met.drop("_ecosystem", "_package"))


# ---------------------------------------------------------------- lines


def drop_comment_lines(lines: DataFrame, ecosystem: str) -> DataFrame:
    """Without blank and whole-line comment lines of the language."""
    stripped = strip(F.col("text"))
    mark = r"^#" if ecosystem == V.PYPI else r"^(//|/\*|\*)"
    return lines.filter((stripped != "") & ~stripped.rlike(mark))


def _snippet() -> Column:
    return strip(F.col("text")).alias("snippet")


def _references(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Token rows joined to the wanted names; the last and longest token of a line speaks for a package."""
    wanted = names.select("repository_id", "ecosystem", F.col("import_name").alias("token"), "package_name")
    hits = tokens.join(wanted, ["repository_id", "ecosystem", "token"])
    best = hits.groupBy(*LINE, "ecosystem", "package_name").agg(
        F.max_by(F.struct("token", "snippet"), F.struct("priority", "position", F.length("token"))).alias("b")
    )
    return best.select(
        *LINE, "ecosystem", "package_name", F.col("b.snippet").alias("snippet"), F.col("b.token").alias("import_name"), F.lit("import").alias("kind")
    )


def match_python_imports(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``import``, ``from … import`` and dynamic imports of the wanted names in ``.py`` lines.

    ``names`` is (repository_id, ecosystem, package_name, import_name). A dotted module counts for each of its
    prefixes, so ``import a.b`` is a use of ``a``.
    """
    return _references(_python_tokens(lines), names)


def _python_tokens(lines: DataFrame) -> DataFrame:
    source = drop_comment_lines(lines.filter(F.col("path").rlike(PYTHON_SUFFIX)), V.PYPI)
    source = source.filter(F.col("text").contains("import"))
    text = F.col("text")
    plain = F.regexp_extract(text, r"(?U)^\s*import\s+((?:[\w.]+(?:\s+as\s+\w+)?\s*,\s*)*[\w.]+)", 1)
    listed = F.regexp_extract_all(plain, F.lit(r"(?U)(?:^|,)\s*([\w.]+)"), 1)
    origin = F.regexp_extract_all(text, F.lit(r"(?U)^\s*from\s+([\w.]+)\s+import\b"), 1)
    dynamic = F.regexp_extract_all(text, F.lit(r"(?U)(?:__import__|import_module)\(\s*['\"]([\w.]+)"), 1)

    def ranked(modules: Column, priority: int) -> Column:
        return F.transform(
            modules, lambda m, i: F.struct(F.lit(priority).alias("priority"), i.alias("position"), m.alias("module"))
        )

    found = F.concat(ranked(listed, 2), ranked(origin, 1), ranked(dynamic, 0))
    modules = source.select(*LINE, _snippet(), F.explode(found).alias("m")).select(*LINE, "snippet", "m.*")
    parts = F.split("module", r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")
    )
    return modules.select(*LINE, F.lit(V.PYPI).alias("ecosystem"), "snippet", "priority", "position", F.explode(prefixes).alias("token"))


def match_js_imports(lines: DataFrame, names: DataFrame) -> DataFrame:
    """``require``, ``import`` and ``from`` with exactly the package or a path below it."""
    return _references(_js_tokens(lines), names)


def _js_tokens(lines: DataFrame) -> DataFrame:
    source = drop_comment_lines(lines.filter(F.col("path").rlike(JS_SUFFIX)), V.NPM)
    pattern = (
        r"(?:\brequire(?:\.resolve)?\s*\(\s*|\bimport\s*\(\s*|\bfrom\s+|\bimport\s+)(['\"`])([^'\"`\s]+)\1"
    )
    specs = F.regexp_extract_all(F.col("text"), F.lit(pattern), 2)
    rows = source.select(*LINE, _snippet(), F.posexplode(specs).alias("position", "spec"))
    root = F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)
    own = [F.lit(V.NPM).alias("ecosystem"), "snippet", F.lit(0).alias("priority"), (-F.col("position")).alias("position")]
    return rows.select(*LINE, *own, root.alias("token"))


def _declared(rows: DataFrame, name: Column) -> DataFrame:
    """Names that PyPI manifests declare, under the normalised name."""
    return rows.select(*LINE, "snippet", F.lit(V.PYPI).alias("ecosystem"), V.normalize_package_name(name, F.lit(V.PYPI)).alias("norm_name"))


def _by_name(declared: DataFrame, packages: DataFrame) -> DataFrame:
    """Declared names joined to the wanted packages of the repository: PyPI on the normalised name, npm on the name itself."""
    if "norm_name" not in packages.columns:
        packages = packages.withColumn("norm_name", V.normalize_package_name(F.col("package_name"), F.col("ecosystem")))
    npm = F.col("ecosystem") == V.NPM
    wanted = packages.filter(npm | (F.col("ecosystem") == V.PYPI)).select(
        "repository_id", "ecosystem", "package_name", F.when(npm, F.col("package_name")).otherwise(F.col("norm_name")).alias("norm_name")
    )
    return (
        declared.join(wanted, ["repository_id", "ecosystem", "norm_name"])
        .select(*LINE, "ecosystem", "package_name", "snippet")
        .distinct()
        .withColumns({"import_name": F.lit(None).cast("string"), "kind": F.lit("config")})
    )


REQUIREMENT_NAME = r"^\s*(?:-e\s+)?([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)"


def is_requirement_manifest(path: Column) -> Column:
    lowered = F.lower(T.base_name(path))
    return lowered.endswith(".txt") & (
        lowered.startswith("requirements") | lowered.startswith("constraints") | path.rlike(r"(^|/)requirements/[^/]*$")
    )


def match_requirement_lines(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """Lines of requirement and constraint files that name a wanted package."""
    return _by_name(_requirement_names(lines), packages)


def _requirement_names(lines: DataFrame) -> DataFrame:
    rows = drop_comment_lines(lines.filter(is_requirement_manifest(F.col("path"))), V.PYPI)
    name = F.regexp_extract("text", REQUIREMENT_NAME, 1)
    return _declared(rows.select(*LINE, _snippet(), name.alias("name")).filter("name <> ''"), F.col("name"))


def _carried(lines: DataFrame, comment: str) -> DataFrame:
    """Section and key state of manifest lines: what the last header and the last key before a line were.

    The window covers one manifest file.
    """
    stripped = strip(F.col("text"))
    rows = lines.filter((stripped != "") & ~stripped.rlike(comment))
    header = F.when(stripped.rlike(SECTION_HEADER), F.regexp_extract(stripped, SECTION_HEADER, 1))
    rows = rows.withColumn("header", header)
    in_file = Window.partitionBy("repository_id", "path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns(
        {"section": F.coalesce(F.last("header", True).over(in_file), F.lit("")), "block": F.count("header").over(in_file)}
    )


def _quoted_in_context(in_section: Column, carried: Column) -> Column:
    """Names of quoted requirements of a line that stand below a dependency key or table."""
    tokens = F.regexp_extract_all(F.col("text"), F.lit(f"{KEY_ASSIGNMENT}|{QUOTED_REQUIREMENT}"), 0)

    def pick(seq: Column) -> Column:
        def with_context(token: Column, i: Column) -> Column:
            before = F.filter(F.slice(seq, F.lit(1), i), lambda t: ~t.rlike("^[\"']"))
            under_key = F.when(F.size(before) > 0, F.exists(before, lambda k: k.rlike(DEPENDENCY_KEY))).otherwise(
                F.coalesce(carried.rlike(DEPENDENCY_KEY), F.lit(False))
            )
            return F.when(
                token.rlike("^[\"']") & (in_section | under_key),
                F.regexp_extract(token, r"^[\"']\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1),
            )

        return F.filter(F.transform(seq, with_context), lambda n: n.isNotNull())

    return bind(tokens, pick)


def match_toml_manifest(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """Entries of dependency tables and quoted requirements under a dependency key (pyproject.toml, Pipfile)."""
    return _by_name(_toml_names(lines), packages)


def _toml_names(lines: DataFrame) -> DataFrame:
    return _token_manifest(lines.filter(T.base_name(F.col("path")).isin("pyproject.toml", "Pipfile")), True)


def _token_manifest(lines: DataFrame, sections: bool) -> DataFrame:
    rows = _carried(lines, "^#") if sections else _carried(lines, "^#").withColumns({"header": F.lit(None).cast("string"), "block": F.lit(0)})
    keys = F.regexp_extract_all(F.col("text"), F.lit(KEY_ASSIGNMENT), 1)
    rows = rows.withColumn("last_key", F.when(F.col("header").isNull(), F.try_element_at(keys, F.lit(-1))))
    earlier = Window.partitionBy("repository_id", "path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("carried", F.last("last_key", True).over(earlier)).filter("header IS NULL")
    name = F.regexp_replace("section", "^[\"' ]+|[\"' ]+$", "")
    in_section = name.rlike(DEPENDENCY_SECTION) if sections else F.lit(False)
    entry = F.regexp_extract(F.col("text"), r"^\s*([\"']?)([A-Za-z0-9._-]+)\1\s*=(?!=)", 2)
    own = F.when(in_section & (entry != ""), F.array(entry)).otherwise(F.array().cast("array<string>"))
    found = F.concat(own, _quoted_in_context(in_section, F.col("carried")))
    return _declared(rows.select(*LINE, _snippet(), F.explode(found).alias("name")), F.col("name"))


def match_setup_manifests(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """Keyword arguments of ``setup.py`` and the keys and continuations of ``setup.cfg``."""
    return _by_name(_setup_names(lines), packages)


def _setup_names(lines: DataFrame) -> DataFrame:
    python = _token_manifest(lines.filter(T.base_name(F.col("path")) == "setup.py"), False)
    rows = _carried(lines.filter(T.base_name(F.col("path")) == "setup.cfg"), "^[#;]").filter("header IS NULL")
    stripped = strip(F.col("text"))
    indented = F.col("text").rlike(r"^\s")
    entry = F.when(~indented & stripped.rlike(INI_KEY), F.regexp_extract(stripped, INI_KEY, 1))
    # a line that starts in the first column sets or clears the key
    rows = rows.withColumn("own_key", F.when(~indented, F.coalesce(entry, F.lit(""))))
    inside = Window.partitionBy("repository_id", "path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("ini_key", F.last("own_key", True).over(inside))
    value = F.when(indented, stripped).otherwise(F.regexp_extract(stripped, INI_KEY, 2))
    bears = F.col("section").rlike(DEPENDENCY_SECTION) | F.coalesce(F.col("ini_key").rlike(DEPENDENCY_KEY), F.lit(False))
    names = F.transform(F.split(value, ";"), lambda s: F.regexp_extract(s, REQUIREMENT_NAME, 1))
    ini = rows.filter(bears).select(*LINE, _snippet(), F.explode(F.filter(names, lambda n: n != "")).alias("name"))
    return python.unionByName(_declared(ini, F.col("name")))


def match_package_json_lines(lines: DataFrame, packages: DataFrame) -> DataFrame:
    """``"pkg":`` lines of package.json."""
    return _by_name(_package_json_names(lines), packages)


def _package_json_names(lines: DataFrame) -> DataFrame:
    rows = lines.filter(T.base_name(F.col("path")) == "package.json")
    name = F.regexp_extract(strip(F.col("text")), r"^\"([^\"]+)\"\s*:", 1)
    return rows.select(*LINE, _snippet(), F.lit(V.NPM).alias("ecosystem"), name.alias("norm_name")).filter("norm_name <> ''")


def by_reader(lines: DataFrame) -> DataFrame:
    """Stored lines with ``reader``, the kind of their file, null if no matcher reads it; lines that have it pass through.

    A line of ``setup.py`` is source and manifest: its kind is the manifest, and the matcher of imports takes both.
    """
    if "reader" in lines.columns:
        return lines
    path = F.col("path")
    base = T.base_name(path)
    reader = (
        F.when(base == "setup.py", "setup.py")
        .when(path.rlike(PYTHON_SUFFIX), "python")
        .when(path.rlike(JS_SUFFIX), "js")
        .when(base.isin(*TOKEN_MANIFESTS, "package.json"), base)
        .when(is_requirement_manifest(path), "requirements")
    )
    return cut_lineage(lines.select(*LINE, "text", reader.alias("reader")))


def match_usage(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """References of both ecosystems, imports and manifest lines, as rows.

    ``wanted`` is (repository_id, ecosystem, package_name). Lines and names are stored once (``by_reader``, ``with_names``);
    every matcher reads its own kind of file. All imports meet the wanted names in one join, all declared names in another.
    """
    lines, packages = by_reader(lines), with_names(wanted)
    names = packages.select("repository_id", "ecosystem", "package_name", F.explode("spelled").alias("import_name"))

    def of(*readers: str) -> DataFrame:
        return lines.filter(F.col("reader").isin(*readers))

    imports = _references(_python_tokens(of("python", "setup.py")).unionByName(_js_tokens(of("js"))), names)
    declared = _requirement_names(of("requirements"))
    for rows in (_toml_names(of("pyproject.toml", "Pipfile")), _setup_names(of("setup.py", "setup.cfg")), _package_json_names(of("package.json"))):
        declared = declared.unionByName(rows)
    return imports.unionByName(_by_name(declared, packages))


# ---------------------------------------------------------------- components and evidence


def map_components(files: DataFrame, components: DataFrame) -> DataFrame:
    """(repository_id, path, component): every component above a file; top-level files are ".".

    A repository without any real component falls back to the top directory. The ancestors of a file become rows
    and meet the components in an equi-join.
    """
    directory = T.parent_dir(F.col("path"))
    rows = files.select("repository_id", "path").distinct().withColumn("directory", directory)
    top = rows.filter("directory = ''").select("repository_id", "path", F.lit(".").alias("component"))
    clean = F.regexp_replace(F.regexp_replace(strip(F.col("path")), r"^(\./)+", ""), "^/+|/+$", "")
    real = components.select("repository_id", clean.alias("component")).filter("component NOT IN ('', '.')").distinct()
    nested = rows.filter("directory <> ''")
    above = nested.select("repository_id", "path", F.explode(T.ancestors(F.col("directory"))).alias("component"))
    matched = above.join(real, ["repository_id", "component"]).select("repository_id", "path", "component")
    bare = nested.join(real.select("repository_id").distinct(), "repository_id", "left_anti")
    fallback = bare.select("repository_id", "path", F.substring_index("directory", "/", 1).alias("component"))
    return top.unionByName(matched).unionByName(fallback)


def eligible_files(files: DataFrame) -> DataFrame:
    """Files the scan reads: sources and dependency manifests outside ignored directories."""
    path = F.col("path")
    manifest = is_requirement_manifest(path) | T.base_name(path).isin(*TOKEN_MANIFESTS, "package.json")
    source = path.rlike(PYTHON_SUFFIX) | path.rlike(JS_SUFFIX)
    return T.prune_paths(files.filter(source | manifest), T.SCANNER_IGNORED)


def skipped_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Per repository the skipped files in path order, the first ``limit`` if one is given, and how many there are (``is_too_large`` marks them)."""
    skipped = files.filter("is_too_large").select("repository_id", "path").distinct()
    total = skipped.groupBy("repository_id").agg(F.count("*").alias("skipped_files_total"))
    first = skipped if limit is None else top_per_key(skipped, ["repository_id"], [F.col("path")], limit)
    listed = first.groupBy("repository_id").agg(F.array_sort(F.collect_list("path")).alias("skipped_files"))
    return total.join(listed, "repository_id")


def scan_summary(files: DataFrame, limit: int | None = None) -> DataFrame:
    """What the scan of each listed repository read: scanned_files, is_capped, skipped_files, skipped_files_total.

    ``files`` is the listing (repository_id, path, is_too_large). Only sources and manifests outside ignored directories
    count; a listed repository without any of them was scanned all the same. ``limit`` bounds the list of skipped files.
    """
    eligible = eligible_files(files)
    seen = eligible.filter(~F.col("is_too_large")).groupBy("repository_id").agg(F.countDistinct("path").alias("scanned_files"))
    rows = files.select("repository_id").distinct().join(seen, "repository_id", "left")
    rows = rows.join(skipped_files(eligible, limit), "repository_id", "left")
    return rows.select(
        "repository_id",
        F.coalesce("scanned_files", F.lit(0)).alias("scanned_files"),
        F.lit(False).alias("is_capped"),
        F.coalesce("skipped_files", F.array().cast("array<string>")).alias("skipped_files"),
        F.coalesce("skipped_files_total", F.lit(0)).alias("skipped_files_total"),
    )


def file_cap(files: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n files of each repository in path order, repositories that have more)."""
    kept = top_per_key(files, ["repository_id"], [F.col("path")], n, "position").drop("position")
    over = files.groupBy("repository_id").agg(F.count("*").alias("files")).withColumn("is_capped", F.col("files") > n)
    return kept, over


def usage_evidence(
    wanted: DataFrame,
    references: DataFrame,
    pairs: DataFrame,
    scans: DataFrame | None = None,
    max_references: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """One evidence row per wanted (repository_id, ecosystem, package_name).

    ``references`` are the rows of ``match_usage``, ``pairs`` those of ``map_components``, ``scans`` those of
    ``scan_summary``. A repository that ``scans`` lacks, or all if there are none, is not ``analysed``: the absence of a
    reference then says nothing. References stay rows of their own; the first ``max_references`` of a package, imports
    before config lines, come as a list only if asked for. ``files`` is whole, or the first ``max_files``. Totals are exact.
    """
    keys = ["repository_id", "ecosystem", "package_name"]
    order = [F.when(F.col("kind") == "import", 0).otherwise(1), F.col("path"), F.col("line_no")]
    imports = F.when(F.col("kind") == "import", F.col("path"))
    whole = [F.array_sort(F.collect_set(imports)).alias("files")] if max_files is None else []
    parts = [
        references.groupBy(*keys).agg(
            F.count("*").alias("n_references"),
            F.count_if(F.col("kind") == "config").alias("n_config"),
            F.array_sort(F.collect_set("import_name")).alias("observed"),
            F.countDistinct(imports).alias("total_files"),
            *whole,
        )
    ]
    importing = references.filter("kind = 'import'").select(*keys, "path").distinct()
    if max_files is not None:
        first = top_per_key(importing, keys, [F.col("path")], max_files)
        parts.append(first.groupBy(*keys).agg(F.array_sort(F.collect_list("path")).alias("files")))
    if max_references is not None:
        entry = F.struct(F.col("path").alias("file"), F.col("line_no").alias("line"), "snippet", "kind")
        ranked = top_per_key(references, keys, order, max_references, "rank").select(*keys, F.struct("rank", entry.alias("r")).alias("s"))
        parts.append(ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]).alias("references")))
    placed = importing.join(pairs, ["repository_id", "path"])
    parts.append(placed.groupBy(*keys).agg(F.array_sort(F.collect_set("component")).alias("components")))
    rows = with_names(wanted).filter(F.size("searched") > 0).select(*keys, "searched")
    for part in parts:
        rows = rows.join(part, keys, "left")
    none = F.array().cast("array<string>")
    if scans is not None:
        rows = rows.join(scans.withColumn("analysed", F.lit(True)), "repository_id", "left")
    else:
        rows = rows.withColumns(
            {"analysed": F.lit(False), "is_capped": F.lit(False), "scanned_files": F.lit(0), "skipped_files": none, "skipped_files_total": F.lit(0)}
        )
    analysed = F.coalesce("analysed", F.lit(False))
    total, found = F.coalesce("total_files", F.lit(0)), F.coalesce("n_references", F.lit(0))
    skipped = F.coalesce("skipped_files_total", F.lit(0))
    cut = ~analysed | F.coalesce("is_capped", F.lit(False)) | (skipped > 0)
    if max_references is not None:
        cut = cut | (found > max_references)
    if max_files is not None:
        cut = cut | (total > max_files)
    return rows.select(
        *keys,
        F.when(F.size("observed") > 0, F.col("observed")).otherwise(F.col("searched")).alias("import_names"),
        *(["references"] if max_references is not None else []),
        F.coalesce("files", none).alias("files"),
        F.coalesce("components", none).alias("components"),
        total.alias("total_files"),
        found.alias("n_references"),
        F.coalesce("n_config", F.lit(0)).alias("n_config"),
        F.coalesce("scanned_files", F.lit(0)).alias("scanned_files"),
        F.coalesce("skipped_files", none).alias("skipped_files"),
        skipped.alias("skipped_files_total"),
        analysed.alias("analysed"),
        cut.alias("truncated"),
    )


def usage_verdict(total_files: Column, truncated: Column, skipped: Column, scope: Column, analysed: Column) -> Column:
    """struct(kind, message) of what the evidence, or its absence, means; never a bare "not used"."""
    bare = F.lower(strip(F.coalesce(scope, F.lit("unknown"))))
    partial = F.when(truncated, F.lit(" (others may exist: not every file was read)")).otherwise("")
    detail = F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" source file(s) could not be read"))).otherwise(
        "the caller's limits left files out"
    )

    def verdict(kind: str, *message) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message]).alias("message"))

    return (
        F.when(total_files > 0, verdict("used", "Imported by ", total_files.cast("string"), " source file(s)", partial, "."))
        .when(~F.coalesce(analysed, F.lit(False)), verdict("not-analysed", "The sources of this repository have not been searched."))
        .when(bare == "transitive", verdict("beyond-depth", "A package in between pulls this dependency in; whether that package calls it was not examined."))
        .when(truncated, verdict("scan-incomplete", "No import seen so far, yet ", detail, "; it may still be in use."))
        .when(bare != "direct", verdict("unknown-scope", "No import seen; its manifest does not say who asked for the package, so another package may use it."))
        .otherwise(verdict("no-direct-import", "Every source file was read and none imports this declared dependency."))
    )


def attach_usage(findings: DataFrame, evidence: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Findings with the evidence of their package, and per repository how many packages were analysed and used."""
    rows = findings.join(evidence, keys, "left")
    counts = evidence.groupBy("repository_id").agg(
        F.count_if("analysed").alias("dependencies_scanned"), F.count_if(F.col("total_files") > 0).alias("with_source_references")
    )
    return rows, counts
