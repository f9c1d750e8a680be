"""npm manifests and lock files of the whole fleet.

Manifests and locks are exploded into rows once; everything after that is joins and aggregates keyed by
(repository_id, lock_path), so a repository with a huge lock file is spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import text as X
from fleetlens.functions import versions as V
from fleetlens.functions.versions import bind
from fleetlens.operators.dependencies import extraction_warnings, json_warnings, unread_warnings
from fleetlens.session import cut_lineage
from fleetlens.skew import first_per_key

# Npm file names and manifest sections; the first section that names a package wins.
MANIFEST = "package.json"
LOCK_FILES = ["package-lock.json", "npm-shrinkwrap.json"]
UNSUPPORTED_LOCKS = ["yarn.lock", "pnpm-lock.yaml"]
SECTIONS = ["dependencies", "devDependencies", "optionalDependencies", "peerDependencies"]
RELATION_SECTIONS = ["dependencies", "optionalDependencies", "peerDependencies"]
GIT_RESOLVED = r"^(git\+|git:|github:|gitlab:|bitbucket:|ssh://)"

_MAP = T.MapType(T.StringType(), T.StringType())
_ENTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("version", "resolved", "name", "link", "dev")]
    + [T.StructField(n, _MAP) for n in SECTIONS]
)
_LOCK = T.StructType(
    [T.StructField("lockfileVersion", T.StringType()), T.StructField("packages", T.MapType(T.StringType(), _ENTRY))]
)
_MANIFEST = T.StructType([T.StructField("name", T.StringType())] + [T.StructField(n, _MAP) for n in SECTIONS])
ENTRY_COLUMNS = ["version", "resolved", "name", "link", "dev", *SECTIONS]


def directory_of(path: Column) -> Column:
    return X.parent_dir(path)


# ---------------------------------------------------------------- manifests


def parse_manifests(files: DataFrame) -> DataFrame:
    """(repository_id, path, directory, section maps); files that are no JSON object have ``is_malformed``."""
    rows = files.filter(X.base_name(F.col("path")) == MANIFEST)
    parsed = rows.select("repository_id", "path", F.from_json("content", _MANIFEST).alias("m"), "content")
    return parsed.select(
        "repository_id",
        "path",
        directory_of(F.col("path")).alias("directory"),
        *[F.col(f"m.{s}").alias(s) for s in SECTIONS],
        (F.try_parse_json("content").isNull() | ~F.trim(F.col("content")).startswith("{")).alias("is_malformed"),
    )


def extract_manifest(manifests: DataFrame) -> DataFrame:
    """Direct dependencies; the first section that declares a name wins and only the second one is dev.

    The sections of one manifest are united inside its row, so the choice needs no shuffle.
    """

    def entries_of(section: str, position: int) -> Column:
        listed = F.map_entries(F.coalesce(F.col(section), F.create_map().cast("map<string,string>")))
        return F.transform(
            listed,
            lambda e: F.struct(e["key"].alias("name"), F.lit(position).alias("section"), e["value"].alias("spec")),
        )

    pairs = [entries_of(section, position) for position, section in enumerate(SECTIONS)]
    keys = [c for c in ("repository_id", "path", "directory") if c in manifests.columns]
    listed = manifests.select(*keys, F.explode(F.concat(*pairs)).alias("d")).select(*keys, "d.*").filter("name <> ''")
    first = listed.groupBy(*keys, "name").agg(F.min(F.struct("section", "spec")).alias("d"))
    return first.select(
        *keys,
        F.col("name").alias("package_name"),
        F.nullif(V.strip(F.col("d.spec")), F.lit("")).alias("version_spec"),
        (F.col("d.section") == 1).alias("dev"),
    )


# ---------------------------------------------------------------- lock entries


def explode_lock(files: DataFrame) -> DataFrame:
    """One row per entry of the ``packages`` map of a v2/v3 lock."""
    rows = files.filter(X.base_name(F.col("path")).isin(*LOCK_FILES))
    parsed = rows.select("repository_id", F.col("path").alias("lock_path"), F.from_json("content", _LOCK).alias("l"))
    entries = parsed.select("repository_id", "lock_path", F.explode("l.packages").alias("lock_key", "e"))
    return entries.filter("e IS NOT NULL").select("repository_id", "lock_path", "lock_key", *[f"e.{c}" for c in ENTRY_COLUMNS])


def flatten_lock_v1(files: DataFrame) -> DataFrame:
    """The nested v1 tree as the same entry rows with ``node_modules/…`` keys.

    One ``variant_explode`` per nesting level over all lock files at once; the loop ends when no entry has children,
    whatever the depth.
    """
    rows = files.filter(X.base_name(F.col("path")).isin(*LOCK_FILES)).select(
        "repository_id", F.col("path").alias("lock_path"), F.try_parse_json("content").alias("v")
    )
    rows = rows.filter("try_variant_get(v, '$.packages') IS NULL")
    level = rows.select(
        "repository_id", "lock_path", F.lit("").alias("prefix"), F.expr("try_variant_get(v, '$.dependencies')").alias("tree")
    )
    done: DataFrame | None = None
    while True:
        level = level.filter("tree IS NOT NULL AND schema_of_variant(tree) LIKE 'OBJECT%'")
        entries = level.lateralJoin(_children()).select("repository_id", "lock_path", "prefix", "name", "entry")
        entries = entries.filter("schema_of_variant(entry) LIKE 'OBJECT%'").withColumn(
            "lock_key",
            F.concat(F.when(F.col("prefix") == "", "").otherwise(F.concat("prefix", F.lit("/"))), F.lit("node_modules/"), "name"),
        )
        entries = cut_lineage(entries)
        if entries.isEmpty():
            break
        flat = entries.select(
            "repository_id",
            "lock_path",
            "lock_key",
            *[F.expr(f"try_variant_get(entry, '$.{c}', 'string')").alias(c) for c in ("version", "resolved")],
            F.lit(None).cast("string").alias("name"),
            F.lit(None).cast("string").alias("link"),
            F.expr("try_variant_get(entry, '$.dev', 'string')").alias("dev"),
            F.expr("try_variant_get(entry, '$.requires', 'map<string,string>')").alias("dependencies"),
            *[F.lit(None).cast(_MAP).alias(s) for s in SECTIONS[1:]],
        )
        done = flat if done is None else done.unionByName(flat)
        level = entries.select(
            "repository_id", "lock_path", F.col("lock_key").alias("prefix"), F.expr("try_variant_get(entry, '$.dependencies')").alias("tree")
        )
    if done is None:
        return files.sparkSession.createDataFrame([], T.StructType([T.StructField("repository_id", files.schema["repository_id"].dataType), T.StructField("lock_path", T.StringType()), T.StructField("lock_key", T.StringType())] + _ENTRY.fields))
    return done


def _children():
    """Lateral table of the (name, entry) pairs of the outer row's ``tree``."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    return spark.tvf.variant_explode(F.col("tree").outer()).select(F.col("key").alias("name"), F.col("value").alias("entry"))


def split_lock_key(key: Column) -> Column:
    """struct(parent, name) of an entry key."""
    greedy = r"^(.*)node_modules/(.*?)$"
    parent = F.regexp_replace(F.regexp_extract(key, r"^(.*)node_modules/", 1), "/+$", "")
    name = F.when(key.contains("node_modules/"), F.regexp_extract(key, greedy, 2)).otherwise(key)
    return F.struct(parent.alias("parent"), name.alias("name"))


def lookup_candidates(base: Column, dependency: Column) -> Column:
    """Keys at which a package seen from ``base`` may be installed, nearest first."""

    def levels(parts: Column) -> Column:
        # "a/node_modules/b" -> prefixes [a/node_modules/b, a, root]
        prefixes = F.transform(
            F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/node_modules/"),
        )
        return F.when(F.element_at(prefixes, -1) == "", prefixes).otherwise(F.concat(prefixes, F.array(F.lit(""))))

    # a key that starts with node_modules/ splits into a leading '' part, which is the root itself
    parts = F.split(F.regexp_replace(base, "^node_modules/", "/node_modules/"), "/node_modules/")
    return F.transform(
        bind(parts, levels),
        lambda b: F.concat(
            F.when(b == "", F.lit("")).otherwise(F.concat(F.regexp_replace(b, "^/", ""), F.lit("/"))),
            F.lit("node_modules/"),
            dependency,
        ),
    )


def resolve_lock_key(edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-ancestor lookup of (keys…, base_key, dependency) in the entries of the same lock.

    The candidate keys of an edge become rows with their distance, one equi-join finds the installed ones and a
    ``min_by`` keeps the nearest. Edges without any installed candidate keep a null ``child_key``.
    """
    wanted = edges.select(*keys, "base_key", "dependency").distinct()
    spread = wanted.select(
        "*", F.posexplode(lookup_candidates(F.col("base_key"), F.col("dependency"))).alias("distance", "lock_key")
    )
    installed = entries.select(*keys, "lock_key")
    found = (
        spread.join(installed, [*keys, "lock_key"])
        .groupBy(*keys, "base_key", "dependency")
        .agg(F.min_by("lock_key", "distance").alias("child_key"))
    )
    return edges.join(found, [*keys, "base_key", "dependency"], "left")


def entry_version(version: Column) -> Column:
    """The installed version when it is a real SemVer, not a git or file specifier."""
    good = V.is_valid_version(version, F.lit(V.NPM)) & V.unresolvable_kind(version).isNull()
    return F.when(good, V.strip(version))


def direct_version(direct: DataFrame, entries: DataFrame) -> DataFrame:
    """Version, claimed lock key and warning of each declared dependency.

    ``direct`` carries repository_id, path, directory, lock_path (null without a lock), lock_dir, package_name and
    version_spec. Exact specifier first, else the installed entry unless it is a link or an alias.
    """
    keys = ["repository_id", "lock_path"]
    spec = F.coalesce("version_spec", F.lit(""))
    inside = F.when(F.col("lock_dir") == "", F.col("directory")).when(
        F.col("directory") == F.col("lock_dir"), F.lit("")
    ).otherwise(F.substring(F.col("directory"), F.length("lock_dir") + 2, F.length("directory")))
    rows = direct.withColumns({"base_key": inside, "dependency": F.col("package_name")})
    resolved = resolve_lock_key(rows, entries, keys)
    installed = entries.select(
        *keys,
        F.col("lock_key").alias("child_key"),
        entry_version(F.col("version")).alias("installed"),
        (F.lower("link") == "true").alias("is_link"),
        F.col("resolved").alias("link_target"),
        F.col("name").alias("real_name"),
    )
    rows = resolved.join(installed, [*keys, "child_key"], "left")
    kind = V.unresolvable_kind(spec)
    exact = F.when(kind.isNull(), V.exact_version(spec))
    link = F.coalesce("is_link", F.lit(False))
    alias = F.coalesce(F.col("real_name") != F.col("package_name"), F.lit(False))
    is_entry = F.col("child_key").isNotNull() & ~link & ~alias
    version = F.when(kind.isNotNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(exact, F.when(is_entry, F.col("installed")))
    )
    head = F.concat(F.col("path"), F.lit(": '"), F.col("package_name"), F.lit("'"))
    reason = (
        F.when(link, F.concat(F.lit("is a linked local package ('"), F.coalesce("link_target", F.lit("None")), F.lit("')")))
        .when(alias, F.concat(F.lit("is an alias of '"), F.col("real_name"), F.lit("'")))
        .otherwise(F.concat(F.lit("not found in "), F.col("lock_path")))
    )
    warning = (
        F.when(kind.isNotNull(), F.concat(head, F.lit(" uses a "), kind, F.lit(" specifier ('"), spec, F.lit("'); version cannot be determined")))
        .when(exact.isNotNull() & is_entry & (F.col("installed") != exact), F.concat(head, F.lit(" pins "), exact, F.lit(" but "), F.col("lock_path"), F.lit(" installs "), F.col("installed")))
        .when(F.col("lock_path").isNotNull() & version.isNull(), F.concat(head, F.lit(" ("), spec, F.lit(") "), reason, F.lit("; version unresolved")))
    )
    return rows.select(
        *[F.col(c) for c in direct.columns],
        version.alias("version"),
        F.when(is_entry, F.col("child_key")).alias("claimed_key"),
        warning.alias("warning"),
    )


def extract_transitive(entries: DataFrame, direct: DataFrame) -> DataFrame:
    """Installed entries no manifest claims and whose (name, version) is not direct; dev only if all copies are.

    ``direct`` carries repository_id, lock_path, package_name, version and claimed_key.
    """
    keys = ["repository_id", "lock_path"]
    is_package = F.col("lock_key").contains("node_modules/") & ~F.coalesce(F.lower("link") == "true", F.lit(False))
    named = entries.filter(is_package).select(
        *keys,
        "lock_key",
        F.coalesce("name", split_lock_key(F.col("lock_key"))["name"]).alias("package_name"),
        entry_version(F.col("version")).alias("version"),
        F.coalesce(F.lower("dev") == "true", F.lit(False)).alias("dev"),
    )
    claimed = direct.filter("claimed_key IS NOT NULL").select(*keys, F.col("claimed_key").alias("lock_key"))
    free = named.join(claimed, [*keys, "lock_key"], "left_anti").alias("e")
    known = direct.select(*keys, "package_name", "version").distinct().alias("d")
    same = [F.col(f"e.{k}") == F.col(f"d.{k}") for k in [*keys, "package_name"]]
    same.append(F.col("e.version").eqNullSafe(F.col("d.version")))
    return free.join(known, same, "left_anti").groupBy(*keys, "package_name", "version").agg(F.bool_and("dev").alias("dev"))


def entry_identities(entries: DataFrame, direct: DataFrame) -> DataFrame:
    """(keys…, lock_key, package_name, version) of the entries that are dependencies, claims first."""
    keys = ["repository_id", "lock_path"]
    is_package = F.col("lock_key").contains("node_modules/") & ~F.coalesce(F.lower("link") == "true", F.lit(False))
    own = entries.filter(is_package).select(
        *keys,
        "lock_key",
        F.coalesce("name", split_lock_key(F.col("lock_key"))["name"]).alias("own_name"),
        entry_version(F.col("version")).alias("own_version"),
    )
    claims = first_per_key(
        direct.filter("claimed_key IS NOT NULL").select(
            *keys, F.col("claimed_key").alias("lock_key"), F.col("package_name"), F.col("version"), F.lit(True).alias("is_claimed")
        ),
        [*keys, "lock_key"],
        [F.col("package_name"), F.col("version").desc_nulls_last()],
    )
    rows = own.join(claims, [*keys, "lock_key"], "left")
    return rows.select(
        *keys,
        "lock_key",
        F.when(F.col("is_claimed"), F.col("package_name")).otherwise(F.col("own_name")).alias("package_name"),
        F.when(F.col("is_claimed"), F.col("version")).otherwise(F.col("own_version")).alias("version"),
    )


def extract_relations(entries: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct parent -> child identities from the three dependency sections, and unresolved counts per lock."""
    keys = ["repository_id", "lock_path"]
    empty = F.create_map().cast("map<string,string>")
    declared = F.flatten(F.array(*[F.map_keys(F.coalesce(s, empty)) for s in RELATION_SECTIONS]))
    parents = entries.select(*keys, "lock_key", F.explode(declared).alias("dependency")).join(
        identities.withColumnsRenamed({"package_name": "parent_name", "version": "parent_version"}), [*keys, "lock_key"]
    )
    edges = resolve_lock_key(cut_lineage(parents.withColumnRenamed("lock_key", "base_key")), entries, keys)
    children = identities.select(
        *keys, F.col("lock_key").alias("child_key"), F.col("package_name").alias("child_name"), F.col("version").alias("child_version")
    )
    rows = cut_lineage(edges.join(children, [*keys, "child_key"], "left").select(*keys, "parent_name", "parent_version", "child_name", "child_version"))
    unresolved = rows.groupBy(*keys).agg(F.count_if(F.col("child_name").isNull()).alias("unresolved"))
    names = ["parent_name", "parent_version", "child_name", "child_version"]
    same = (F.col("parent_name") == F.col("child_name")) & F.col("parent_version").eqNullSafe(F.col("child_version"))
    relations = rows.filter(F.col("child_name").isNotNull() & ~same).select(*keys, *names).distinct()
    return relations, unresolved


# ---------------------------------------------------------------- workspaces


def workspace_pattern(pattern: Column) -> Column:
    """Anchored regular expression of a workspace glob, null for unsafe or root patterns."""
    text = V.strip(F.regexp_replace(pattern, "^!", ""))
    slashes = F.replace(text, F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(slashes, "/"), lambda s: ~s.isin("", "."))
    quoted = F.transform(
        segments,
        lambda s: F.when(s == "**", F.lit("**")).otherwise(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"([.+^$(){}|\\])", r"\\$1"), r"\[!", "[^"), r"\*", "[^/]*"),
                r"\?",
                "[^/]",
            )
        ),
    )
    joined = F.array_join(quoted, "/")
    # "**" stands for any number of whole path components, none included
    wide = F.regexp_replace(joined, r"(^|/)\*\*(/|$)", "$1(?:[^/]+(?:/|\\$))*")
    unsafe = text.rlike(r"^[/\\]") | F.array_contains(segments, "..") | (F.size(segments) == 0)
    return F.when(~unsafe, F.concat(F.lit("^"), wide, F.lit("$")))


def workspace_match(directories: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Directories that match an including glob of their root manifest and no excluding one.

    Patterns belong to a root manifest, so the join is an equality on ``keys`` with the match as residual.
    """
    rules = patterns.select(*keys, F.col("pattern").startswith("!").alias("excludes"), workspace_pattern(F.col("pattern")).alias("regex"))
    rules = rules.filter("regex IS NOT NULL")
    matched = directories.join(rules, keys).filter(F.rlike("directory", F.col("regex")) & (F.col("directory") != ""))
    flags = matched.groupBy(*keys, "directory").agg(F.bool_or("excludes").alias("is_out"), F.bool_or(~F.col("excludes")).alias("is_in"))
    return flags.filter("is_in AND NOT is_out").select(*keys, "directory")


def governing_lock(manifests: DataFrame, locks: DataFrame, members: DataFrame) -> DataFrame:
    """(repository_id, path, lock_path, warning): the adjacent lock, else the nearest ancestor's if it governs.

    ``locks`` is (repository_id, lock_path, directory), ``members`` (repository_id, lock_path, directory of a
    workspace). Only the nearest lock counts; if it does not know the directory the manifest has none.
    """
    climb = manifests.select(
        "repository_id", "path", "directory", F.posexplode(X.ancestors(F.col("directory"))).alias("distance", "lock_dir")
    )
    named = locks.select(
        "repository_id", F.col("directory").alias("lock_dir"), "lock_path", F.array_position(F.array(*[F.lit(n) for n in LOCK_FILES]), X.base_name(F.col("lock_path"))).alias("_order")
    )
    nearest = (
        climb.join(named, ["repository_id", "lock_dir"])
        .groupBy("repository_id", "path", "directory")
        .agg(F.min_by(F.struct("lock_path", "distance", "lock_dir"), F.struct("distance", "_order")).alias("n"))
        .select("repository_id", "path", "directory", "n.*")
    )
    known = members.select("repository_id", "lock_path", "directory", F.lit(True).alias("is_member")).distinct()
    rows = nearest.join(known, ["repository_id", "lock_path", "directory"], "left")
    governs = (F.col("distance") == 0) | F.coalesce("is_member", F.lit(False))
    warning = F.when(
        ~governs,
        F.concat(F.col("path"), F.lit(": not a workspace of "), F.col("lock_path"), F.lit("; versions are taken from exact specs only")),
    )
    decided = rows.select(
        "repository_id",
        "path",
        F.when(governs, F.col("lock_path")).alias("lock_path"),
        F.when(governs, F.col("lock_dir")).alias("lock_dir"),
        warning.alias("warning"),
    )
    return manifests.select("repository_id", "path", "directory").join(decided, ["repository_id", "path"], "left")


def lock_only_workspaces(entries: DataFrame, manifests: DataFrame) -> DataFrame:
    """Workspace entries of a lock without a readable manifest, as manifest rows sourced from the lock."""
    declares = F.lit(False)
    for section in SECTIONS:
        declares = declares | F.col(section).isNotNull()
    own = entries.filter((F.col("lock_key") != "") & ~F.col("lock_key").contains("node_modules/")).filter(declares)
    lock_dir = directory_of(F.col("lock_path"))
    rows = own.withColumn(
        "directory", F.when(lock_dir == "", F.col("lock_key")).otherwise(F.concat(lock_dir, F.lit("/"), F.col("lock_key")))
    )
    known = manifests.filter("NOT is_malformed").select("repository_id", "directory").distinct()
    return rows.join(known, ["repository_id", "directory"], "left_anti").select(
        "repository_id", F.col("lock_path").alias("path"), "directory", "lock_path", *SECTIONS
    )


# ---------------------------------------------------------------- whole extraction


def workspace_members(files: DataFrame, locks: DataFrame, entries: DataFrame) -> DataFrame:
    """(repository_id, lock_path, directory) of the workspaces of each lock: its own entries, and globs of its manifest."""
    keys = ["repository_id", "lock_path"]

    def full(part: Column) -> Column:
        return F.when(F.col("lock_dir") == "", part).otherwise(F.concat("lock_dir", F.lit("/"), part))

    placed = locks.withColumnRenamed("directory", "lock_dir")
    listed = entries.filter((F.col("lock_key") != "") & ~F.col("lock_key").contains("node_modules/"))
    own = listed.join(placed, keys).select(*keys, full(F.col("lock_key")).alias("directory"))
    manifests = files.filter(X.base_name(F.col("path")) == MANIFEST).withColumn("directory", directory_of(F.col("path")))
    globs = F.expr("coalesce(try_variant_get(v, '$.workspaces', 'array<string>'), try_variant_get(v, '$.workspaces.packages', 'array<string>'))")
    rules = manifests.select("repository_id", F.col("directory").alias("lock_dir"), F.try_parse_json("content").alias("v"))
    rules = rules.select("repository_id", "lock_dir", F.explode(globs).alias("pattern")).join(placed, ["repository_id", "lock_dir"])
    below = manifests.select("repository_id", "directory", F.explode(X.ancestors(F.col("directory"))).alias("lock_dir")).distinct()
    below = below.filter("directory <> lock_dir").join(placed, ["repository_id", "lock_dir"])
    cut = F.when(F.col("lock_dir") == "", F.col("directory")).otherwise(F.substring("directory", F.length("lock_dir") + 2, F.length("directory")))
    matched = workspace_match(below.select(*keys, cut.alias("directory")), rules.select(*keys, "pattern"), keys)
    return own.unionByName(matched.join(placed, keys).select(*keys, full(F.col("directory")).alias("directory"))).distinct()


def extract_npm(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dependencies, relations and warnings of every manifest and lock of (repository_id, path, content).

    Dependencies have the columns of ``extract_python``; relations are (repository_id, lock_path, parent_name,
    parent_version, child_name, child_version); warnings (repository_id, message). A file that was not read, is no JSON
    object or has a format that is not parsed gives a warning, never a silent gap.
    """
    named = [MANIFEST, *LOCK_FILES, *UNSUPPORTED_LOCKS]
    # stored once: what follows reads these files many times, and their source may be a scan or a plan of its own
    files = cut_lineage(files.filter(X.base_name(F.col("path")).isin(named)).select("repository_id", "path", "content"))
    manifests = cut_lineage(parse_manifests(files))
    entries = cut_lineage(explode_lock(files).unionByName(flatten_lock_v1(files)))
    is_lock = X.base_name(F.col("path")).isin(LOCK_FILES) & F.try_parse_json("content").isNotNull()
    locks = files.filter(is_lock).select("repository_id", F.col("path").alias("lock_path"), directory_of(F.col("path")).alias("directory")).distinct()
    readable = manifests.filter("NOT is_malformed")
    governed = governing_lock(readable.select("repository_id", "path", "directory").distinct(), locks, workspace_members(files, locks, entries))
    governed = cut_lineage(governed)
    direct = extract_manifest(readable).join(governed.select("repository_id", "path", "lock_path", "lock_dir"), ["repository_id", "path"], "left")
    lock_only = extract_manifest(lock_only_workspaces(entries, manifests))
    direct = direct.unionByName(lock_only.withColumns({"lock_path": F.col("path"), "lock_dir": directory_of(F.col("path"))}))
    found = cut_lineage(direct_version(cut_lineage(direct), entries))
    columns = ["repository_id", "package_name", "source_file", "version", "version_spec", "scope", "dev"]
    transitive = extract_transitive(entries, found.select("repository_id", "lock_path", "package_name", "version", "claimed_key"))
    transitive = transitive.withColumnRenamed("lock_path", "source_file").withColumns({"version_spec": F.lit(None).cast("string"), "scope": F.lit("transitive")})
    deps = found.withColumnRenamed("path", "source_file").withColumn("scope", F.lit("direct")).select(columns).unionByName(transitive.select(columns))
    deps = deps.withColumns({"ecosystem": F.lit(V.NPM), "line_no": F.lit(None).cast("int")})
    relations, unresolved = extract_relations(entries, cut_lineage(entry_identities(entries, found)))
    gaps = F.concat("lock_path", F.lit(": "), F.col("unresolved").cast("string"), F.lit(" relation(s) lead to no installed package"))
    warnings = extraction_warnings(
        found.select("repository_id", F.col("warning").alias("message")),
        governed.select("repository_id", F.col("warning").alias("message")),
        unresolved.filter("unresolved > 0").select("repository_id", gaps.alias("message")),
        json_warnings(files.filter("content IS NOT NULL")),
        unread_warnings(files),
    )
    return deps, relations, warnings
