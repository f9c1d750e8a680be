"""Advisory normalisation, alias groups and merging.

Working form of affected data is one row per package entry or per interval, so merging and matching are joins and
aggregates. Arrays appear only at the edges, where one advisory or one merged package is a row of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scores as S
from fleetlens.functions import versions as V
from fleetlens.functions.versions import bind
from fleetlens.session import cut_lineage

RANGE_TYPE = "array<struct<range_type:string,introduced:string,fixed:string,last_affected:string>>"


# ---------------------------------------------------------------- intervals of one record


def flatten_range_events(ranges: Column) -> Column:
    """Intervals of ``array<struct<type, events[]>>``; ``introduced`` opens one, the next bound closes it."""

    def one(r: Column) -> Column:
        kind = F.upper(F.coalesce(F.nullif(r["type"], F.lit("")), F.lit("ECOSYSTEM")))

        def interval(introduced, fixed, last_affected) -> Column:
            return F.struct(
                kind.alias("range_type"),
                introduced.alias("introduced"),
                fixed.alias("fixed"),
                last_affected.alias("last_affected"),
            )

        def step(acc: Column, e: Column) -> Column:
            fixed, last = F.nullif(e["fixed"], F.lit("")), F.nullif(e["last_affected"], F.lit(""))
            null = F.lit(None).cast("string")
            closed = bind(
                F.element_at(acc, -1),
                lambda p: F.concat(
                    F.slice(acc, F.lit(1), F.size(acc) - 1),
                    F.array(
                        interval(
                            p["introduced"], F.coalesce(fixed, p["fixed"]), F.coalesce(last, p["last_affected"])
                        )
                    ),
                ),
            )
            return (
                F.when(e["introduced"].isNotNull(), F.concat(acc, F.array(interval(e["introduced"], null, null))))
                .when(F.size(acc) == 0, F.array(interval(null, fixed, last)))
                .otherwise(closed)
            )

        return F.aggregate(r["events"], F.array().cast(RANGE_TYPE), step)

    flat = F.flatten(F.transform(F.filter(ranges, lambda r: r["events"].isNotNull()), one))
    return F.coalesce(flat, F.array().cast(RANGE_TYPE))


def derive_fixed_versions(ranges: Column, ecosystem: Column) -> Column:
    """Distinct fixes outside GIT intervals in version order, unparsable ones last."""
    fixes = F.array_distinct(
        F.transform(
            F.filter(ranges, lambda r: (r["range_type"] != "GIT") & r["fixed"].isNotNull()), lambda r: r["fixed"]
        )
    )
    return bind(fixes, lambda x: F.array_union(V.sort_versions(x, ecosystem), x))


def affected_rows(advisories: DataFrame) -> DataFrame:
    """One row per package entry of an advisory, with its normalised name."""
    rows = advisories.select("identifier", F.explode("affected").alias("a")).select("identifier", "a.*")
    return rows.withColumn("norm_name", V.normalize_package_name(F.col("package_name"), F.col("ecosystem")))


def range_rows(affected: DataFrame) -> DataFrame:
    """One row per interval with the order keys the range joins compare."""
    eco = F.col("ecosystem")
    rows = affected.select("identifier", "ecosystem", "norm_name", F.explode("ranges").alias("r")).select(
        "identifier", "ecosystem", "norm_name", "r.*"
    )
    return with_range_keys(rows, eco)


def with_range_keys(rows: DataFrame, eco: Column | None = None) -> DataFrame:
    eco = F.col("ecosystem") if eco is None else eco
    return rows.withColumns(
        {
            "introduced_key": V.version_key(F.col("introduced"), eco),
            "fixed_key": V.version_key(F.col("fixed"), eco),
            "last_key": V.version_key(F.col("last_affected"), eco),
        }
    )


def filter_affected_for_package(affected: DataFrame, packages: DataFrame) -> DataFrame:
    """The package entries of the asked (ecosystem, package_name) pairs."""
    wanted = packages.select(
        "ecosystem", V.normalize_package_name(F.col("package_name"), F.col("ecosystem")).alias("norm_name")
    ).distinct()
    return affected.join(wanted, ["ecosystem", "norm_name"], "left_semi")


def fixed_versions_for(affected: DataFrame, packages: DataFrame) -> DataFrame:
    """Distinct fixes per (advisory, package) in version order, unparsable ones last."""
    rows = filter_affected_for_package(affected, packages)
    fixes = rows.select("identifier", "ecosystem", "norm_name", F.explode("fixed_versions").alias("v")).distinct()
    key = V.version_key(F.col("v"), F.col("ecosystem"))
    return (
        fixes.withColumn("_k", F.struct(key.isNull().alias("bad"), key.alias("key"), F.col("v")))
        .groupBy("identifier", "ecosystem", "norm_name")
        .agg(F.transform(F.array_sort(F.collect_list("_k")), lambda s: s["v"]).alias("fixed_versions"))
    )


def affected_ranges_for(affected: DataFrame, packages: DataFrame) -> DataFrame:
    """The intervals of the asked packages, one row each."""
    rows = filter_affected_for_package(affected, packages)
    return rows.select("identifier", "ecosystem", "norm_name", F.explode("ranges").alias("r")).select(
        "identifier", "ecosystem", "norm_name", "r.*"
    )


# ---------------------------------------------------------------- alias groups


def _tokens(records: DataFrame) -> DataFrame:
    ids = F.array_union(F.array("identifier"), F.coalesce("aliases", F.array().cast("array<string>")))
    return records.select("identifier", F.explode(ids).alias("token")).distinct()


def alias_groups(records: DataFrame) -> DataFrame:
    """(identifier, group_id) of records (identifier, aliases[]) that describe one issue.

    Records naming different CVE sets are never merged. Two records with the same non-empty CVE set share a CVE
    token by definition, so their group is an aggregate. Only records without any CVE need connected components;
    each component joins the smallest CVE set it touches, whatever the order of the input. ``group_id`` is the
    smallest identifier of the group. A component loop takes a logarithmic number of rounds (minimum label over
    shared tokens, then a jump to the label of the label), each cut off by a reliable checkpoint.
    """
    tokens = _tokens(records)
    is_cve = F.upper("token").startswith("CVE-")
    signature = (
        tokens.groupBy("identifier")
        .agg(F.array_sort(F.collect_set(F.when(is_cve, F.col("token")))).alias("cves"))
        .select("identifier", F.nullif(F.array_join("cves", "|"), F.lit("")).alias("cves"))
    )
    marked = cut_lineage(tokens.join(signature, "identifier"))
    free = marked.filter("cves IS NULL").select("identifier", "token")
    labels = cut_lineage(free.select("identifier").distinct().withColumn("label", F.col("identifier")))
    while True:
        by_token = free.join(labels, "identifier").groupBy("token").agg(F.min("label").alias("label"))
        spread = free.join(by_token, "token").groupBy("identifier").agg(F.min("label").alias("label"))
        jump = spread.select(F.col("identifier").alias("label"), F.col("label").alias("further"))
        moved = spread.join(jump, "label").select("identifier", F.least("label", "further").alias("label"))
        changed = cut_lineage(
            moved.join(labels.withColumnRenamed("label", "before"), "identifier").select(
                "identifier", "label", (F.col("label") != F.col("before")).alias("changed")
            )
        )
        labels = changed.select("identifier", "label")
        if changed.filter("changed").isEmpty():
            break
    reached = (
        free.join(labels, "identifier")
        .join(marked.filter("cves IS NOT NULL").select("token", F.col("cves").alias("touched")).distinct(), "token")
        .groupBy("label")
        .agg(F.min("touched").alias("touched"))
    )
    free_keys = labels.join(reached, "label", "left").select(
        "identifier", F.coalesce(F.concat(F.lit("S:"), "touched"), F.concat(F.lit("I:"), "label")).alias("key")
    )
    set_keys = marked.filter("cves IS NOT NULL").select("identifier", F.concat(F.lit("S:"), "cves").alias("key"))
    keys = set_keys.distinct().unionByName(free_keys)
    names = keys.groupBy("key").agg(F.min("identifier").alias("group_id"))
    return keys.join(names, "key").select("identifier", "group_id")


def _primary_order() -> Column:
    """GHSA before CVE before others, scored first, oldest first, then by identifier."""
    far = F.coalesce(F.col("published_at").cast("timestamp"), F.lit("9999-12-31").cast("timestamp"))
    return F.struct(
        S.identifier_tier(F.col("identifier")).alias("tier"),
        F.col("cvss_score").isNull().alias("unscored"),
        far.alias("published"),
        F.col("identifier").alias("identifier"),
    )


def merge_group(records: DataFrame, groups: DataFrame) -> DataFrame:
    """E5: one canonical record per group.

    Everything but the united names and ``references`` is a ``min_by`` over the preference order, so partial aggregation
    reduces each input partition to one row per group before the shuffle. ``source`` is the primary record's, ``references``
    are those of all members in preference order, each once.
    """
    rows = records.join(groups, "identifier").withColumn("_o", _primary_order())
    rank = S.severity_rank(F.col("severity"))

    def first(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("_o"))).alias(column)

    scored = F.when(
        F.col("cvss_score").isNotNull(), F.struct((-F.col("cvss_score")).alias("s"), F.col("_o").alias("o"))
    )
    canonical = rows.groupBy("group_id").agg(
        F.min_by("identifier", "_o").alias("identifier"),
        F.min_by("severity", "_o").alias("_primary_severity"),
        F.min_by("severity", F.struct((-rank).alias("r"), F.col("_o").alias("o"))).alias("_worst_severity"),
        F.min_by(F.struct("cvss_score", "cvss_vector", "severity"), scored).alias("_scored"),
        F.min_by("cvss_vector", F.when(F.col("cvss_vector").isNotNull(), F.col("_o"))).alias("_vector"),
        *[first(c) for c in ("summary", "description", "published_at", "modified_at", "reference_url") if c in records.columns],
        *([F.min_by("source", "_o").alias("source")] if "source" in records.columns else []),
        *([F.array_sort(F.collect_list(F.struct("_o", "references"))).alias("_references")] if "references" in records.columns else []),
        F.count("*").alias("members"),
    )
    if "references" in records.columns:
        lists = F.transform("_references", lambda r: F.coalesce(r["references"], F.array().cast("array<string>")))
        canonical = canonical.withColumn("references", F.array_distinct(F.flatten(lists))).drop("_references")
    severity = F.when(F.col("_primary_severity") == "UNKNOWN", F.col("_worst_severity")).otherwise(
        F.col("_primary_severity")
    )
    severity = F.when(
        S.severity_rank(F.col("_scored.severity")) > S.severity_rank(severity), F.col("_scored.severity")
    ).otherwise(severity)
    canonical = canonical.withColumns(
        {
            "severity": severity,
            "cvss_score": F.col("_scored.cvss_score"),
            "cvss_vector": F.when(F.col("_scored").isNotNull(), F.col("_scored.cvss_vector")).otherwise(F.col("_vector")),
        }
    ).drop("_primary_severity", "_worst_severity", "_scored", "_vector")
    names = (
        _tokens(records)
        .join(groups, "identifier")
        .select("group_id", "token")
        .distinct()
        .join(canonical.select("group_id", F.col("identifier").alias("_primary")), "group_id")
        .filter("token <> _primary")
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list("token")).alias("aliases"))
    )
    return canonical.join(names, "group_id", "left").withColumn(
        "aliases", F.coalesce("aliases", F.array().cast("array<string>"))
    )


def drop_unsafe_fixes(fixes: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Fixes (keys…, fixed) that do not lie inside another interval of the same merged package.

    Left-anti range join: equality on the package first, the interval as residual. An interval without a lower
    bound, the one the fix itself closes and unparsable bounds never remove a fix; a missing ``fixed`` is open.
    """
    eco = F.col("ecosystem")
    left = fixes.withColumn("_fk", V.version_key(F.col("fixed"), eco)).alias("f")
    right = (
        ranges.filter("introduced IS NOT NULL AND introduced <> '' AND introduced_key IS NOT NULL")
        .filter("fixed IS NULL OR fixed_key IS NOT NULL")
        .select(*keys, F.col("fixed").alias("_closes"), "introduced_key", "fixed_key")
        .alias("r")
    )
    inside = (
        (F.col("f._fk") >= F.col("r.introduced_key"))
        & (F.col("r._closes").isNull() | (F.col("f._fk") < F.col("r.fixed_key")))
        & ~F.col("r._closes").eqNullSafe(F.col("f.fixed"))
    )
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"f.{key}") == F.col(f"r.{key}"))
    return left.join(right, same & inside, "left_anti").drop("_fk")


def merge_affected(affected: DataFrame, groups: DataFrame) -> DataFrame:
    """E6 with E7: per (group, package) the union of intervals, listed versions and safe fixes."""
    keys = ["group_id", "ecosystem", "norm_name"]
    rows = affected.join(groups, "identifier")
    named = rows.groupBy(*keys).agg(F.min("package_name").alias("package_name"))
    ranges = rows.select(*keys, F.explode("ranges").alias("r")).select(*keys, "r.*").distinct()
    listed = rows.select(*keys, F.explode("versions").alias("v")).distinct()
    fixes = rows.select(*keys, F.explode("fixed_versions").alias("fixed")).distinct()
    safe = drop_unsafe_fixes(fixes, with_range_keys(ranges), keys)
    key = V.version_key(F.col("fixed"), F.col("ecosystem"))
    safe = (
        safe.withColumn("_k", F.struct(key.isNull().alias("bad"), key.alias("key"), F.col("fixed").alias("v")))
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list("_k")), lambda s: s["v"]).alias("fixed_versions"))
    )
    ranges = ranges.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("range_type", "introduced", "fixed", "last_affected"))).alias("ranges")
    )
    listed = listed.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("versions"))
    merged = named.join(ranges, keys, "left").join(listed, keys, "left").join(safe, keys, "left")
    none = F.array().cast("array<string>")
    return merged.withColumns(
        {
            "ranges": F.coalesce("ranges", F.array().cast(RANGE_TYPE)),
            "versions": F.coalesce("versions", none),
            "fixed_versions": F.coalesce("fixed_versions", none),
        }
    )


def canonical_map(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Identifier -> canonical identifier."""
    rows = records.join(groups, "identifier").withColumn("_o", _primary_order())
    canonical = rows.groupBy("group_id").agg(F.min_by("identifier", "_o").alias("canonical"))
    return groups.join(canonical, "group_id").select("identifier", "canonical").distinct()


def dedupe_records(records: DataFrame, groups: DataFrame, order: str) -> DataFrame:
    """One canonical identifier per group with its first-seen position, ready to sort by it."""
    seen = records.join(groups, "identifier").groupBy("group_id").agg(F.min(order).alias("first_seen"))
    canonical = canonical_map(records, groups).join(groups, "identifier").select("group_id", "canonical").distinct()
    return canonical.join(seen, "group_id").select("canonical", "first_seen")


# ---------------------------------------------------------------- upserts


def upsert_advisories(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge by identifier; only concrete values overwrite, aliases are united, UNKNOWN never hides a severity.

    ``affected`` is not touched here (A9). Both sides hold one row per identifier.
    """
    old, new = stored.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.identifier") == F.col("n.identifier"), "full_outer")
    empty = F.array().cast("array<string>")
    identifier = F.coalesce("n.identifier", "o.identifier")
    aliases = F.array_union(F.coalesce("o.aliases", empty), F.coalesce("n.aliases", empty))
    severity = F.when(
        F.col("n.severity").isNotNull() & ((F.col("n.severity") != "UNKNOWN") | (F.coalesce("o.severity", F.lit("")) == "")),
        F.col("n.severity"),
    ).otherwise(F.col("o.severity"))
    special = {
        "identifier": identifier,
        "aliases": F.filter(aliases, lambda a: a != identifier),
        "severity": F.coalesce(severity, F.lit("UNKNOWN")),
        "source": F.coalesce("o.source", "n.source"),
    }
    return joined.select(
        *[special.get(c, F.coalesce(f"n.{c}", f"o.{c}")).alias(c) for c in stored.columns if c != "affected"]
    )


def refresh_affected(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Package entries of stored advisories; an incoming entry replaces those of the same package."""
    keys = ["identifier", "ecosystem", "norm_name"]
    columns = [*keys, "package_name", "ranges", "versions", "fixed_versions"]
    kept = stored.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*columns).unionByName(incoming.select(*columns))
