"""Vulnerability matching, status and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import scores as S
from fleetlens.functions import versions as V
from fleetlens.operators import ranks
from fleetlens.session import cut_lineage
from fleetlens.skew import hot_keys, salted_join

UNPINNED = "Version not pinned; add a lock file or pin the version"
UNAVAILABLE = "Vulnerability check unavailable"
LOOKUP = ["ecosystem", "norm_name", "version"]


def with_lookup_key(deps: DataFrame) -> DataFrame:
    """Dependencies with the normalised name and the stripped version the lookups use."""
    return deps.withColumns(
        {
            "norm_name": V.normalize_package_name(F.col("package_name"), F.col("ecosystem")),
            "version": V.strip(F.col("version")),
        }
    )


def count_lookups(deps: DataFrame) -> DataFrame:
    """Each (ecosystem, name, version) once, valid or not, with the number of dependency rows behind it.

    The aggregate combines on the map side, so a package used by a third of the fleet shuffles one row per input partition.
    """
    return deps.groupBy(*LOOKUP).agg(F.count("*").alias("n_dependencies"))


def distinct_lookups(deps: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """each checkable (ecosystem, name, version) once, with the number of dependency rows behind it.

    ``index`` holds the parsed versions of a run; without one they are parsed here, on the distinct versions only.
    """
    counted = count_lookups(deps)
    if index is not None:
        return ranked_lookups(counted, index)
    key = V.version_key(F.col("version"), F.col("ecosystem"))
    # explode of null-or-one element: computes the key once and drops the invalid versions with it
    return counted.select("*", F.explode(F.array_compact(F.array(key))).alias("version_key"))


def ranked_lookups(counted: DataFrame, index: DataFrame) -> DataFrame:
    """The checkable ones of counted lookups, with the rank that ``index`` gives their version."""
    return counted.join(index.select(*LOOKUP, "version_key", "rank", "n_ranks"), LOOKUP)


def canonical_names(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """``rows`` under the canonical identifier of their issue (identifier -> canonical); unknown identifiers stay."""
    named = rows.join(canonical, "identifier", "left").withColumn("identifier", F.coalesce("canonical", "identifier"))
    return named.select(*rows.columns)


def canonical_hits(hits: DataFrame, canonical: DataFrame) -> DataFrame:
    """E8 on hits: aliases of one issue count once per lookup."""
    return canonical_names(hits, canonical).select(*LOOKUP, "identifier").distinct()


def advisory_match(
    lookups: DataFrame,
    ranges: DataFrame,
    listed: DataFrame | None = None,
    canonical: DataFrame | None = None,
    index: DataFrame | None = None,
    once: bool = True,
) -> DataFrame:
    """(lookup, identifier) for every advisory interval or explicit version list that covers the version.

    Versions and bounds are ranked per package (``index`` holds the ranks of a run, else they are built here) and meet by
    the nodes of their ranks, see ``operators.ranks``: a package with 10^5 versions and 10^3 intervals is spread over its
    nodes, and only hits are formed. A version list (ecosystem, norm_name, identifier, versions) joins the same union by the
    spelling of the version. With ``canonical`` (rows of ``canonical_map``) the aliases of one issue are one hit: intervals and
    lists are renamed, which are few, instead of the hits. Lookups that carry their ranks of ``index`` are taken as they are.
    Without ``once`` a hit may come again, for readers that take sets of them, as ``lookup_status`` does.
    """
    if canonical is not None:
        ranges = canonical_names(ranges, canonical)
        listed = listed if listed is None else canonical_names(listed, canonical)
    ranked = index is not None and {"rank", "n_ranks"} <= set(lookups.columns)
    if index is None:
        index = cut_lineage(ranks.version_index(lookups, ranks.bound_versions(ranges)))
    asked = lookups if ranked else lookups.select(*LOOKUP).join(index.select(*LOOKUP, "rank", "n_ranks"), LOOKUP)
    hits = ranks.covering(asked.select(*LOOKUP, "rank", "n_ranks"), ranks.rank_spans(ranges, index), ["identifier"]).select(*LOOKUP, "identifier")
    if listed is not None:
        exact = listed.select("ecosystem", "norm_name", "identifier", F.explode("versions").alias("version"))
        hits = hits.unionByName(lookups.select(*LOOKUP).join(exact, LOOKUP).select(*LOOKUP, "identifier"))
    return hits.distinct() if once else hits


def status_reason(count: Column, identifiers: Column) -> Column:
    """how many advisories and which."""
    word = F.when(count == 1, F.lit(" known vulnerability (")).otherwise(F.lit(" known vulnerabilities ("))
    return F.concat(count.cast("string"), word, F.array_join(identifiers, ", "), F.lit(")"))


def lookup_status(lookups: DataFrame, hits: DataFrame, unanswered: DataFrame | None = None) -> DataFrame:
    """Status and reason of each lookup; an unanswered one is UNKNOWN, never SAFE."""
    found = hits.groupBy(*LOOKUP).agg(F.array_sort(F.collect_set("identifier")).alias("identifiers"))
    rows = lookups.join(found, LOOKUP, "left")
    if unanswered is None:
        rows = rows.withColumn("_missing", F.lit(False))
    else:
        missing = unanswered.select(*LOOKUP).distinct().withColumn("_missing", F.lit(True))
        rows = rows.join(missing, LOOKUP, "left").withColumn("_missing", F.coalesce("_missing", F.lit(False)))
    is_hit = F.col("identifiers").isNotNull()
    return rows.select(
        *LOOKUP,
        "n_dependencies",
        F.when(is_hit, "VULNERABLE").when(F.col("_missing"), "UNKNOWN").otherwise("SAFE").alias("vulnerability_status"),
        F.when(is_hit, status_reason(F.size("identifiers"), F.col("identifiers")))
        .when(F.col("_missing"), UNAVAILABLE)
        .alias("status_reason"),
        F.coalesce(F.size("identifiers"), F.lit(0)).alias("n_advisories"),
    )


def classify_dependencies(deps: DataFrame, statuses: DataFrame, salt_hot: bool = True, hot: DataFrame | None = None) -> DataFrame:
    """SAFE, VULNERABLE or UNKNOWN with the reason, on every dependency row.

    ``statuses`` is one row per lookup. A package version that occurs all over the fleet is a hot join key; ``hot`` names
    those few keys, else the lookup counts say which, without another pass over the dependencies.
    """
    verdicts = statuses.drop("n_dependencies")
    if hot is None and salt_hot:
        hot = hot_keys(statuses.select(*LOOKUP, "n_dependencies"), "n_dependencies")
    rows = deps.join(verdicts, LOOKUP, "left") if hot is None else salted_join(deps, verdicts, LOOKUP, hot, "left")
    unpinned = F.coalesce(F.col("version"), F.lit("")) == ""
    invalid = F.concat(
        F.lit('Version "'), F.col("version"), F.lit('" is not a valid '), F.col("ecosystem"),
        F.lit(" version; it cannot be checked"),
    )
    checked = F.col("vulnerability_status").isNotNull()
    return rows.withColumns(
        {
            "vulnerability_status": F.coalesce("vulnerability_status", F.lit("UNKNOWN")),
            "status_reason": F.when(unpinned, UNPINNED).when(~checked, invalid).otherwise(F.col("status_reason")),
        }
    )


def check_summary(classified: DataFrame, hits: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """counters per analysis; distinct advisories from the classified rows' lookups when ``hits`` is given.

    The vulnerable lookups of an analysis are distinct before they meet their hits, and ``hot`` lookups are salted.
    """
    unpinned = F.coalesce(F.col("version"), F.lit("")) == ""
    status = F.col("vulnerability_status")
    counters = classified.groupBy("analysis_id").agg(
        F.count("*").alias("checked"),
        F.count_if(~unpinned).alias("queried"),
        F.count_if(status == "SAFE").alias("safe"),
        F.count_if(status == "VULNERABLE").alias("vulnerable"),
        F.count_if(status == "UNKNOWN").alias("unknown"),
        F.count_if(unpinned).alias("unpinned"),
    )
    if hits is None:
        return counters
    asked = classified.filter(status == "VULNERABLE").select("analysis_id", *LOOKUP).distinct()
    named = hits.select(*LOOKUP, "identifier")
    met = asked.join(named, LOOKUP) if hot is None else salted_join(asked, named, LOOKUP, hot)
    touched = met.groupBy("analysis_id").agg(F.countDistinct("identifier").alias("vulnerabilities_total"))
    return counters.join(touched, "analysis_id", "left").fillna(0, ["vulnerabilities_total"])


def stage_status(errors: Column, total: Column) -> Column:
    """OK without unanswered lookups, UNAVAILABLE when none was answered, PARTIAL between."""
    return F.when(errors == 0, "OK").when(errors == total, "UNAVAILABLE").otherwise("PARTIAL")


def create_findings(deps: DataFrame, hits: DataFrame, existing: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """one finding per (analysis, dependency, advisory); existing ones are kept as they are.

    ``hits`` carries the canonical identifier and its severity, once per lookup. Equal dependency identities are reduced to
    the smallest scope before they meet their hits, so no shuffle carries findings; ``hot`` lookups are salted.
    """
    identity = ["analysis_id", "ecosystem", "norm_name", "version", "source_file", "identifier"]
    bad = hits.select(*LOOKUP).distinct()
    asked = deps.select("analysis_id", *LOOKUP, "source_file", "scope").join(bad, LOOKUP, "left_semi")
    asked = asked.groupBy("analysis_id", *LOOKUP, "source_file").agg(F.min("scope").alias("scope"))
    rows = asked.join(hits, LOOKUP) if hot is None else salted_join(asked, hits, LOOKUP, hot)
    columns = ["analysis_id", *LOOKUP, "source_file", "scope", *[c for c in hits.columns if c not in LOOKUP]]
    fresh = rows.select(*columns).withColumn("risk_level", provisional_risk(F.col("severity")))
    if existing is None:
        return fresh
    new = fresh.join(existing.select(*identity), identity, "left_anti")
    return existing.unionByName(new, allowMissingColumns=True)


def check_package(packages: DataFrame, ranges: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """F8: status of a list of (ecosystem, package_name, version), aliases merged; never SAFE with records."""
    asked = with_lookup_key(packages)
    lookups = distinct_lookups(asked)
    hits = advisory_match(lookups, ranges, canonical=canonical)
    return classify_dependencies(asked, lookup_status(lookups, hits), salt_hot=False)


def provisional_risk(severity: Column) -> Column:
    """severity as risk one to one; no severity is UNKNOWN, never NONE."""
    return S.normalise_severity(severity)


def recheck_statuses(old: DataFrame, new: DataFrame, keys: list[str], checked_at: Column | None = None) -> DataFrame:
    """a new run replaces status and reason, also where it clears a stale VULNERABLE; others keep theirs.

    With ``checked_at`` the rows of the new run carry that time, the others the one they had. ``operators.state`` does the
    same for deltas, without reading the packages that they do not name.
    """
    latest = new.select(
        *keys,
        F.col("vulnerability_status").alias("_status"),
        F.col("status_reason").alias("_reason"),
        F.lit(True).alias("_seen"),
    )
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    rows = old.alias("o").join(latest.alias("n"), same, "left").select("o.*", "_status", "_reason", "_seen")
    changes = {
        "vulnerability_status": F.when(F.col("_seen"), F.col("_status")).otherwise(F.col("vulnerability_status")),
        "status_reason": F.when(F.col("_seen"), F.col("_reason")).otherwise(F.col("status_reason")),
    }
    if checked_at is not None:
        before = F.col("checked_at") if "checked_at" in old.columns else F.lit(None)
        changes["checked_at"] = F.when(F.col("_seen"), checked_at.cast("timestamp")).otherwise(before.cast("timestamp"))
    return rows.withColumns(changes).drop("_status", "_reason", "_seen")
