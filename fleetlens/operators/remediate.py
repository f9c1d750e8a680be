"""Upgrade selection and manifest rewriting for every vulnerable dependency at once.

Selection works on distinct (ecosystem, norm_name, version) lookups, not on dependency rows: a package version used
by a third of the fleet is decided once and joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as T
from fleetlens.functions import versions as V
from fleetlens.functions.versions import strip
from fleetlens.operators import matching as M
from fleetlens.operators import ranks
from fleetlens.session import cut_lineage

# The confidence of an automatic choice, and the npm range styles kept on rewriting.
CONFIDENCE = 0.5
SIMPLE_SPEC = (
    r"^(\^|~|>=|=v|=|v)?\s*((?:0|[1-9]\d*)\.(?:0|[1-9]\d*)\.(?:0|[1-9]\d*)(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)$"
)
PACKAGE = ["ecosystem", "norm_name"]


def vulnerabilities_of_dependency(findings: DataFrame, dependency: list[str]) -> DataFrame:
    """K1: advisories of each finding's dependency in its analysis, the finding's own one first.

    The advisories of a dependency are collected once (as many as one package version has) and joined back to its
    findings; no pairs of findings are formed.
    """
    groups = findings.groupBy(*dependency).agg(F.array_sort(F.collect_set("identifier")).alias("_all"))
    rows = findings.join(groups, dependency)
    own = F.array(F.col("identifier"))
    return rows.withColumn("identifiers", F.concat(own, F.array_except("_all", own))).drop("_all")


def safe_fixes(ranges: DataFrame, index: DataFrame) -> DataFrame:
    """(package, identifier, fixed, fix_rank) of every fix of a merged advisory that ends the issue there.

    A fix inside another interval of the same issue is none: an interval without ``fixed`` is open to the end, one without
    a lower bound or with unparsable bounds removes nothing, nor does the one that the fix itself closes. An issue has few
    intervals in a package, and they meet by issue and package.
    """
    known = index.select(*PACKAGE, "version", "rank")
    keys = [*PACKAGE, "identifier"]
    fixes = ranges.filter("range_type <> 'GIT' AND fixed IS NOT NULL").select(*keys, "fixed").distinct()
    fixes = fixes.join(known.withColumnsRenamed({"version": "fixed", "rank": "fix_rank"}), [*PACKAGE, "fixed"])
    others = ranges.filter("introduced <> ''").select(*keys, "introduced", F.col("fixed").alias("_closes")).distinct()
    others = others.join(known.withColumnsRenamed({"version": "introduced", "rank": "_lo"}), [*PACKAGE, "introduced"])
    others = others.join(known.withColumnsRenamed({"version": "_closes", "rank": "_hi"}), [*PACKAGE, "_closes"], "left")
    others = others.filter("_closes IS NULL OR _hi IS NOT NULL").drop("introduced")
    inside = (F.col("fix_rank") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("fix_rank") < F.col("_hi"))) & ~F.col("_closes").eqNullSafe(F.col("fixed"))
    same = [F.col(f"f.{k}") == F.col(f"o.{k}") for k in keys]
    return fixes.alias("f").join(others.alias("o"), [*same, inside], "left_anti").select(*keys, "fixed", "fix_rank")


def _floor(candidates: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Max over the issues of the smallest fix above ``rank``: two aggregates, both partial before the shuffle."""
    above = candidates.join(fixes, [*PACKAGE, "identifier"]).filter(F.col("fix_rank") > F.col("rank"))
    per = above.groupBy(*keys, "identifier").agg(F.min(F.struct("fix_rank", "fixed")).alias("f"))
    return per.groupBy(*keys).agg(F.max("f").alias("f"), F.count("*").alias("fixable")).select(
        *keys, F.col("f.fixed").alias("floor"), F.col("f.fix_rank").alias("floor_rank"), "fixable"
    )


def minimum_fixed_version(hits: DataFrame, fixes: DataFrame) -> DataFrame:
    """K2: smallest version that fixes every fixable issue of a lookup; ``hits`` (lookup, rank, identifier) of merged advisories."""
    return _floor(hits, fixes, M.LOOKUP)


def installable_releases(releases: DataFrame, index: DataFrame) -> DataFrame:
    """K3: parsable, not withdrawn releases with their rank, stability and major; one row per spelling."""
    rows = releases.filter("installable").select(*PACKAGE, "version").distinct().join(index, M.LOOKUP)
    return rows.select(*PACKAGE, "version", "rank", "n_ranks", (~F.col("is_prerelease")).alias("is_stable"), "major")


def latest_releases(installable: DataFrame) -> DataFrame:
    """K3: newest stable release of each package."""
    return installable.filter("is_stable").groupBy(*PACKAGE).agg(F.max_by("version", F.struct("rank", "version")).alias("latest"))


def latest_in_same_major(lookups: DataFrame, installable: DataFrame, index: DataFrame) -> DataFrame:
    """K4: newest stable release with the major of the current version; aggregated before the join."""
    per = installable.filter("is_stable").groupBy(*PACKAGE, "major").agg(
        F.max_by("version", F.struct("rank", "version")).alias("latest_same_major")
    )
    rows = lookups.select(*M.LOOKUP).join(index.select(*M.LOOKUP, "major"), M.LOOKUP, "left")
    return rows.join(per, [*PACKAGE, "major"], "left").select(*M.LOOKUP, "latest_same_major")


def next_releases(installable: DataFrame, index: DataFrame) -> DataFrame:
    """(package, rank, release, release_rank): the smallest stable release not below each rank of the index.

    One window over the ranks of a package turns every as-of search of a run into an equi-join.
    """
    stable = installable.filter("is_stable").groupBy(*PACKAGE, "rank").agg(F.min("version").alias("release"))
    known = index.select(*PACKAGE, "rank").distinct().join(stable, [*PACKAGE, "rank"], "left")
    upwards = Window.partitionBy(*PACKAGE).orderBy(F.col("rank").desc())
    here = F.when(F.col("release").isNotNull(), F.struct(F.col("rank").alias("release_rank"), "release"))
    rows = known.withColumn("_next", F.last(here, ignorenulls=True).over(upwards)).filter("_next IS NOT NULL")
    return rows.select(*PACKAGE, "rank", "_next.release", "_next.release_rank")


def _snapped(rows: DataFrame, upcoming: DataFrame, version: str, rank: str) -> DataFrame:
    """``rows`` with snapped and snapped_rank: the next release, or the version itself where there is none."""
    met = rows.join(upcoming.withColumnRenamed("rank", rank), [*PACKAGE, rank], "left")
    return met.withColumns({"snapped": F.coalesce("release", version), "snapped_rank": F.coalesce("release_rank", rank)}).drop("release", "release_rank")


def snap_to_release(floors: DataFrame, upcoming: DataFrame) -> DataFrame:
    """K5: (package, floor, floor_rank, snapped, snapped_rank): smallest stable release not below each distinct floor.

    ``upcoming`` are ``next_releases``. Without such a release the floor stays.
    """
    return _snapped(floors.select(*PACKAGE, "floor", "floor_rank").distinct(), upcoming, "floor", "floor_rank")


def next_fixed_version(hits: DataFrame, fixes: DataFrame) -> DataFrame:
    """K7: max over the remaining issues of the smallest fix above the candidate; ``hits`` (package, candidate, rank, identifier)."""
    return _floor(hits, fixes, [*PACKAGE, "candidate"])


def verify_candidates(
    starts: DataFrame, spans: DataFrame, fixes: DataFrame, upcoming: DataFrame, unanswered: DataFrame | None = None
) -> DataFrame:
    """K6: (package, start, candidate, candidate_rank, verified, remaining[]) of distinct (package, snapped, snapped_rank).

    A vulnerable candidate moves to its next fix, snapped to a release. All places that any start can ever come to are the
    starts and the snapped fixes, so every place is checked once, in one join, and gets its next one; the way of a start is
    then followed with doubling steps over that small table. true = no advisory left, false = still affected without a
    further fix, null = no advisory known, but the lookup of the candidate is among the ``unanswered`` (lookup). A move
    strictly rises, so every way ends.
    """
    own = starts.select(*PACKAGE, F.col("snapped").alias("candidate"), F.col("snapped_rank").alias("rank")).distinct()
    fixed = _snapped(fixes.select(*PACKAGE, "fixed", "fix_rank").distinct(), upcoming, "fixed", "fix_rank")
    places = own.unionByName(fixed.select(*PACKAGE, F.col("snapped").alias("candidate"), F.col("snapped_rank").alias("rank"))).distinct()
    places = cut_lineage(places.join(spans.select(*PACKAGE, "n_ranks").distinct(), PACKAGE, "left"))
    keys = [*PACKAGE, "candidate"]
    hits = cut_lineage(ranks.covering(places.filter("n_ranks IS NOT NULL"), spans, ["identifier"]).distinct())
    moves = _snapped(next_fixed_version(hits, fixes), upcoming, "floor", "floor_rank").select(*keys, F.col("snapped").alias("to"))
    ways = cut_lineage(places.select(*keys, "rank").join(moves, keys, "left").select(*keys, F.coalesce("to", "candidate").alias("to")))
    while True:
        ahead = ways.select(*PACKAGE, F.col("candidate").alias("to"), F.col("to").alias("_further"))
        farther = cut_lineage(ways.join(ahead, [*PACKAGE, "to"]).select(*keys, F.col("_further").alias("to"), (F.col("_further") != F.col("to")).alias("_moved")))
        ways = farther.drop("_moved")
        if farther.filter("_moved").isEmpty():
            break
    left = hits.groupBy(*keys).agg(F.array_sort(F.collect_set("identifier")).alias("remaining"))
    ends = own.select(*PACKAGE, F.col("candidate").alias("start")).join(ways.withColumnsRenamed({"candidate": "start", "to": "candidate"}), [*PACKAGE, "start"])
    rows = ends.join(places.select(*keys, F.col("rank").alias("candidate_rank")), keys).join(left, keys, "left")
    verdict = F.when(F.col("remaining").isNotNull(), F.lit(False))
    if unanswered is None:
        verdict = verdict.otherwise(F.lit(True))
    else:
        missing = unanswered.select(*PACKAGE, F.col("version").alias("candidate")).distinct().withColumn("_missing", F.lit(True))
        rows = rows.join(missing, keys, "left")
        verdict = verdict.when(F.col("_missing").isNull(), F.lit(True))
    return rows.select(
        *PACKAGE, "start", "candidate", "candidate_rank", verdict.alias("verified"), F.coalesce("remaining", F.array().cast("array<string>")).alias("remaining")
    )


def select_candidates(
    hits: DataFrame, spans: DataFrame, fixes: DataFrame, installable: DataFrame, index: DataFrame, unanswered: DataFrame | None = None
) -> DataFrame:
    """K2-K9 for every vulnerable lookup: minimum, verified candidate, allowed versions and the preferred one."""
    upcoming = cut_lineage(next_releases(installable, index))
    floors = cut_lineage(_snapped(minimum_fixed_version(hits, fixes), upcoming, "floor", "floor_rank"))
    verified = verify_candidates(floors, spans, fixes, upcoming, unanswered)
    rows = floors.select(*M.LOOKUP, "floor", F.col("snapped").alias("start"), "fixable").join(verified, [*PACKAGE, "start"])
    rows = rows.withColumnRenamed("start", "minimum_fixed_version")
    rows = with_latest(rows, installable, index)
    return choose_version(rows, safe_versions(rows, spans, index), index)


def with_latest(candidates: DataFrame, installable: DataFrame, index: DataFrame) -> DataFrame:
    """K3, K4 on candidates: the newest releases of the package and of the current major."""
    rows = candidates.join(latest_in_same_major(candidates, installable, index), M.LOOKUP, "left")
    return rows.join(latest_releases(installable), PACKAGE, "left")


def safe_versions(candidates: DataFrame, spans: DataFrame, index: DataFrame) -> DataFrame:
    """K8: (lookup, option, option_rank) among candidate, newest of the major and newest that may be proposed.

    The candidate counts when it is verified, or unverified because lookups were down (null). The others must be above it
    and in a gap of the package's vulnerable ranges (``union_spans``); with lookups down they count unverified.
    """
    base = candidates.select(*M.LOOKUP, "candidate", "candidate_rank", "verified", "latest_same_major", "latest")
    own = base.filter("verified OR verified IS NULL").select(*M.LOOKUP, F.col("candidate").alias("option"), F.col("candidate_rank").alias("option_rank"))
    extra = base.select(*M.LOOKUP, "candidate_rank", "verified", F.explode(F.array_compact(F.array_distinct(F.array("latest_same_major", "latest")))).alias("option"))
    ranked = index.select(*PACKAGE, F.col("version").alias("option"), F.col("rank").alias("option_rank"), "n_ranks")
    extra = extra.join(ranked, [*PACKAGE, "option"]).filter(F.col("option_rank") > F.col("candidate_rank"))
    asked = extra.select(*PACKAGE, F.col("option_rank").alias("rank"), "n_ranks").distinct()
    bad = ranks.covering(asked, ranks.union_spans(spans), []).select(*PACKAGE, F.col("rank").alias("option_rank"), F.lit(True).alias("_bad"))
    extra = extra.join(bad, [*PACKAGE, "option_rank"], "left").filter("verified IS NULL OR _bad IS NULL")
    return own.unionByName(extra.select(*M.LOOKUP, "option", "option_rank"))


def choose_version(candidates: DataFrame, safe: DataFrame, index: DataFrame) -> DataFrame:
    """K9: lowest safe version of the current major, else lowest safe one, else the unsafe candidate."""
    major = index.select(*M.LOOKUP, "major")

    def with_major(rows: DataFrame, version: str, name: str) -> DataFrame:
        return rows.join(major.withColumnsRenamed({"version": version, "major": name}), [*PACKAGE, version], "left")

    options = with_major(with_major(safe, "version", "_major"), "option", "_option_major")
    same = F.coalesce(F.col("_option_major") == F.col("_major"), F.lit(False))
    picked = options.groupBy(*M.LOOKUP).agg(
        F.min_by("option", F.struct((~same).alias("other"), F.col("option_rank"), F.col("option"))).alias("_preferred"),
        F.transform(F.array_sort(F.collect_set(F.struct("option_rank", "option"))), lambda s: s["option"]).alias("_allowed"),
    )
    rows = candidates.join(picked, M.LOOKUP, "left").withColumn("preferred_version", F.coalesce("_preferred", "candidate"))
    rows = with_major(with_major(rows, "version", "_major"), "preferred_version", "_preferred_major")
    return rows.withColumns(
        {
            "allowed_versions": F.coalesce("_allowed", F.array().cast("array<string>")),
            "verified_safe": F.when(F.col("_preferred").isNull(), F.lit(False)).when(F.col("verified").isNotNull(), F.lit(True)),
            "same_major": F.col("_preferred_major") == F.col("_major"),
        }
    ).drop("_preferred", "_allowed", "_major", "_preferred_major")


def deterministic_recommendation(candidates: DataFrame) -> DataFrame:
    """The preferred version with its reason and a fixed confidence."""
    version = F.col("preferred_version")
    tail = F.when(F.col("verified_safe"), F.lit(" and that was verified as clean")).otherwise("")
    reason = F.when(version.isNull(), F.lit("No fixed version is available.")).otherwise(
        F.concat(version, F.lit(" is the lowest version that is listed as fixing every known vulnerability of this dependency"), tail, F.lit("."))
    )
    return candidates.withColumns(
        {"recommended_version": version, "reasoning": reason, "confidence": F.when(version.isNull(), 0.0).otherwise(CONFIDENCE)}
    )


def version_guardrail(proposals: DataFrame) -> DataFrame:
    """A proposed version must be an allowed candidate, else the preferred one with a note.

    ``proposals`` carries proposed, allowed_versions and preferred_version.
    """
    matched = V.match_allowed_version(F.col("proposed"), F.col("allowed_versions"))
    fallback = F.coalesce("preferred_version", F.get("allowed_versions", F.lit(0)))
    rows = proposals.withColumns({"_matched": matched, "_fallback": fallback})
    none = F.when(F.col("_fallback").isNull(), "; no safe candidate version is known, so no version is recommended").otherwise("")
    note = (
        F.when(
            F.col("proposed").isNull() & F.col("_fallback").isNotNull(),
            F.concat(F.lit("(no version proposed; using the preferred candidate "), F.col("_fallback"), F.lit(")")),
        )
        .when(F.col("proposed").isNotNull() & F.col("_matched").isNull(), F.concat(F.lit("(adjusted: proposed "), F.col("proposed"), F.lit(" which is not an allowed candidate)"), none))
    )
    return rows.withColumns({"final_version": F.coalesce("_matched", "_fallback"), "note": note}).drop("_matched", "_fallback")


def normalise_component(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(strip(name), F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "/+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("."))


def component_guardrail(proposals: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, kept[], dropped[]) of proposed component names (keys…, position, name).

    A name is kept when the evidence (keys…, component) has it, exactly or else ignoring case; the evidence
    spelling wins and the order of the proposal stays.
    """
    known = evidence.select(*keys, F.col("component"), normalise_component(F.col("component")).alias("norm"))
    exact = known.groupBy(*keys, "norm").agg(F.max("component").alias("exact"))
    folded = known.groupBy(*keys, F.lower("norm").alias("low")).agg(F.max_by("component", "norm").alias("folded"))
    rows = proposals.withColumn("norm", normalise_component(F.col("name"))).withColumn("low", F.lower("norm"))
    rows = rows.join(exact, [*keys, "norm"], "left").join(folded, [*keys, "low"], "left")
    rows = rows.withColumn("match", F.coalesce("exact", "folded"))
    kept = rows.filter("match IS NOT NULL").groupBy(*keys, "match").agg(F.min("position").alias("position"))
    kept = kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "match"))), lambda s: s["match"]).alias("kept"))
    dropped = rows.filter("match IS NULL").groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda s: s["name"]).alias("dropped")
    )
    none = F.array().cast("array<string>")
    both = kept.join(dropped, keys, "full")
    return both.select(*keys, F.coalesce("kept", none).alias("kept"), F.coalesce("dropped", none).alias("dropped"))


def remediable_gate(version: Column, source_file: Column, package: Column) -> Column:
    """Null when a finding can be remediated, else the reason why not."""
    path = F.replace(source_file, F.lit("\\"), F.lit("/"))
    name = F.lower(T.base_name(path))
    supported = (name == "package.json") | T.is_requirements_file(path)
    return (
        F.when(F.coalesce(version, F.lit("")) == "", F.concat(package, F.lit(" has no concrete version in "), source_file, F.lit("; pin it before remediating")))
        .when(name == "package-lock.json", F.lit("lock file entries are transitive dependencies; upgrade the parent package"))
        .when(~supported, F.concat(F.lit("dependency file '"), source_file, F.lit("' is not supported for remediation")))
    )


# name[extras], specifier, marker, options and comment of one physical requirement line
_PIN_LINE = (
    r"^(\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\s*\[[^\]]*\])?)([^;#]*?)(\s*;.*?)?"
    r"((?:\s--[a-zA-Z][\w-]*(?:=\S*|\s+[^#\s]\S*)?)*)(\s*|(?:\s+|^)#.*)$"
)


def rewrite_requirement_pins(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Lines (repository_id, path, line_no, text) with the planned packages set to ``==new``.

    Extras, spacing, markers, options and comments stay. ``plan`` is (repository_id, path, package_name,
    current_version, new_version). A line that is unpinned, pinned to something else or locked by hashes keeps its
    text and gets a ``refusal``; lines of other packages pass through.
    """
    from fleetlens.operators.extract_python import pinned_version

    name = F.regexp_extract("text", _PIN_LINE, 2)
    candidate = ~F.col("text").rlike(r"^\s*(#|-|$)") & F.col("text").rlike(_PIN_LINE)
    rows = lines.withColumn("norm_name", F.when(candidate, V.normalize_package_name(name, F.lit(V.PYPI))))
    wanted = plan.select(
        "repository_id", "path", V.normalize_package_name(F.col("package_name"), F.lit(V.PYPI)).alias("norm_name"), "current_version", "new_version"
    )
    rows = rows.join(wanted, ["repository_id", "path", "norm_name"], "left")
    spec, options = F.regexp_extract("text", _PIN_LINE, 3), F.regexp_extract("text", _PIN_LINE, 5)
    pinned = pinned_version(spec)
    planned = F.col("new_version").isNotNull()
    refusal = (
        F.when(~planned, F.lit(None).cast("string"))
        .when(pinned.isNull() | F.trim(spec).startswith("@"), F.lit("not pinned with '=='; pin the version before remediation"))
        .when(F.col("current_version").isNotNull() & (pinned != F.col("current_version")), F.concat(F.lit("pinned to "), pinned, F.lit("; re-run the analysis before remediation")))
        .when(options.contains("--hash"), F.lit("uses --hash pins; hashes of the new version are not known"))
    )
    lead, gap = F.regexp_extract(spec, r"^(\s*)", 1), F.regexp_extract(spec, r"^\s*===?(\s*)[^\s,]+\s*$", 1)
    tail = F.regexp_extract(spec, r"(\s*)$", 1)
    new_spec = F.concat(lead, F.lit("=="), gap, F.col("new_version"), tail)
    text = F.concat(
        F.regexp_extract("text", _PIN_LINE, 1), new_spec, F.regexp_extract("text", _PIN_LINE, 4), options, F.regexp_extract("text", _PIN_LINE, 6)
    )
    rows = rows.withColumns({"refusal": refusal, "_new": text})
    changed = planned & F.col("refusal").isNull()
    return rows.select(
        "repository_id", "path", "line_no", F.when(changed, F.col("_new")).otherwise(F.col("text")).alias("text"), changed.alias("rewritten"), "refusal"
    )


def rewrite_manifest_specs(specs: DataFrame) -> DataFrame:
    """Npm specifiers (spec, current_version, new_version) set to the new version, operator kept.

    Complex ranges become ``^new`` with a note; an exact pin of another version than recorded is refused.
    """
    text = strip(F.coalesce("spec", F.lit("")))
    simple = text.rlike(SIMPLE_SPEC)
    operator, declared = F.regexp_extract(text, SIMPLE_SPEC, 1), F.regexp_extract(text, SIMPLE_SPEC, 2)
    exact = simple & operator.isin("", "=", "v", "=v")
    stale = exact & F.col("current_version").isNotNull() & (declared != F.col("current_version"))
    return specs.withColumns(
        {
            "new_spec": F.when(stale, F.lit(None).cast("string")).when(simple, F.concat(operator, "new_version")).otherwise(F.concat(F.lit("^"), "new_version")),
            "note": F.when(~simple, F.concat(F.lit("complex range '"), text, F.lit("' replaced with ^"), "new_version")),
            "refusal": F.when(stale, F.concat(F.lit("pinned to "), declared, F.lit("; re-run the analysis before remediation"))),
        }
    )
