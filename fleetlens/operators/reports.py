"""Validation results and evidence reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as T
from fleetlens.functions import versions as V
from fleetlens.functions.scores import normalise_severity
from fleetlens.operators import matching as M
from fleetlens.operators.remediate import PACKAGE
from fleetlens.operators.risk import risk_origin
from fleetlens.operators.usage import usage_verdict

# Lock file names, decisions and the ten section titles of a report.
LOCK_NAMES = ["package-lock.json", "npm-shrinkwrap.json"]
APPLY, MANUAL = "Apply", "Apply with manual testing"
NOT_YET, ANALYSIS_ONLY = "Do not apply yet", "Analysis only — not validated"
SECTIONS = [
    "Repository", "Analysis", "Dependency", "Vulnerability", "Evidence", "Application Impact", "Risk Assessment",
    "Recommended Remediation", "Validation", "Final Recommendation",
]


def prefer_manifest_entry(deps: DataFrame, keys: list[str], changed_file: str = "changed_file") -> DataFrame:
    """L2: one row per key: from the changed file, else from any manifest, else from a lock file."""
    is_lock = T.base_name(F.col("source_file")).isin(*LOCK_NAMES)
    rank = F.when(F.col("source_file") == F.col(changed_file), 0).when(~is_lock, 1).otherwise(2)
    rest = [c for c in deps.columns if c not in keys]
    picked = deps.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank.alias("rank"), F.col("source_file"), F.col("version"))).alias("d"))
    return picked.select(*keys, "d.*")


def security_recheck(plan: DataFrame, deps: DataFrame, ranges: DataFrame, unanswered: DataFrame | None = None) -> DataFrame:
    """L1: PASS, FAIL or UNKNOWN for each planned change.

    ``plan`` is (change_id, repository_id, ecosystem, package_name, new_version, changed_file), ``deps`` the
    re-extracted (repository_id, ecosystem, package_name, version, version_spec, source_file). The manifest must
    show the new version (or a range that starts at it) and that version must have no advisory; an unanswered
    lookup is UNKNOWN.
    """
    eco = F.col("ecosystem")
    norm = V.normalize_package_name(F.col("package_name"), eco)
    asked = plan.withColumn("norm_name", norm)
    found = deps.withColumn("norm_name", norm).select("repository_id", *PACKAGE, "version", "version_spec", "source_file")
    entries = asked.select("change_id", "repository_id", *PACKAGE, "changed_file").join(found, ["repository_id", *PACKAGE])
    entries = prefer_manifest_entry(entries.select("change_id", "changed_file", "version", "version_spec", "source_file"), ["change_id"])
    rows = asked.join(entries.drop("changed_file").withColumn("_declared", F.lit(True)), "change_id", "left")
    shown = F.coalesce("version", V.range_base(F.col("version_spec")))
    agrees = V.same_version(shown, F.col("new_version"), eco)
    checked = rows.withColumn("agrees", F.coalesce(agrees, F.lit(False)))
    new = checked.select(*PACKAGE, F.col("new_version").alias("version")).distinct()
    lookups = M.distinct_lookups(new)
    bad = M.advisory_match(lookups, ranges).groupBy(*M.LOOKUP).agg(F.array_sort(F.collect_set("identifier")).alias("remaining"))
    bad = bad.withColumnRenamed("version", "new_version")
    checked = checked.join(bad, [*PACKAGE, "new_version"], "left")
    if unanswered is None:
        checked = checked.withColumn("_missing", F.lit(False))
    else:
        missing = unanswered.select(*PACKAGE, F.col("version").alias("new_version")).distinct().withColumn("_missing", F.lit(True))
        checked = checked.join(missing, [*PACKAGE, "new_version"], "left").withColumn("_missing", F.coalesce("_missing", F.lit(False)))
    status = (
        F.when(F.col("_declared").isNull() | ~F.col("agrees"), "FAIL")
        .when(F.col("remaining").isNotNull(), "FAIL")
        .when(F.col("_missing"), "UNKNOWN")
        .otherwise("PASS")
    )
    note = (
        F.when(F.col("_declared").isNull(), F.lit("manifest does not contain the expected version: not declared"))
        .when(~F.col("agrees"), F.concat(F.lit("manifest does not contain the expected version: found "), F.coalesce("version", "version_spec", F.lit("no version"))))
        .when(F.col("remaining").isNotNull(), F.concat(F.lit("still affected by "), F.array_join("remaining", ", ")))
        .when(F.col("_missing"), F.lit(M.UNAVAILABLE))
        .otherwise("no known vulnerabilities")
    )
    return checked.select("change_id", status.alias("security_scan_status"), note.alias("note"))


def overall_result(build: Column, tests: Column, security: Column) -> Column:
    """L3: FAIL if any check failed, PASS if all passed, UNKNOWN otherwise; a skipped test never passes."""
    parts = F.array(build, tests, security)
    return F.when(F.array_contains(parts, "FAIL"), "FAIL").when(F.forall(parts, lambda s: s == "PASS"), "PASS").otherwise("UNKNOWN")


def is_partial_pass(build: Column, tests: Column, security: Column) -> Column:
    """L4: installs and is clean, but no test ran."""
    return (build == "PASS") & (security == "PASS") & (tests == "SKIPPED")


def remediation_status(build: Column, tests: Column, security: Column) -> Column:
    """L4: status a finished validation gives its remediation."""
    return (
        F.when(overall_result(build, tests, security) == "PASS", "VALIDATED")
        .when(is_partial_pass(build, tests, security), "PARTIALLY_VALIDATED")
        .otherwise("VALIDATION_FAILED")
    )


def latest_per_parent(rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Newest child of each parent as one ``max_by`` (partial before the shuffle, ties by the last order column)."""
    rest = [c for c in rows.columns if c != parent]
    picked = rows.groupBy(parent).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return picked.select(parent, "r.*")


def sibling_findings(findings: DataFrame, dependency: list[str]) -> DataFrame:
    """The other advisories of each finding's dependency; the group's list is joined, no pairs are built."""
    groups = findings.groupBy(*dependency).agg(F.array_sort(F.collect_set("identifier")).alias("_all"))
    rows = findings.join(groups, dependency)
    return rows.withColumn("siblings", F.array_except("_all", F.array("identifier"))).drop("_all")


def final_recommendation(rows: DataFrame) -> DataFrame:
    """Decision and reason from the stored remediation and validation of each finding.

    Expects remediation_id, remediation_status, remediation_error, validation_id, validation_status, build_status,
    test_status and security_scan_status (null when absent).
    """
    build, tests, security = F.col("build_status"), F.col("test_status"), F.col("security_scan_status")
    overall = overall_result(build, tests, security)
    summary = F.concat(F.lit("build "), build, F.lit(", tests "), tests, F.lit(", security scan "), security)
    partial = is_partial_pass(build, tests, security)
    none, unvalidated = F.col("remediation_id").isNull(), F.col("validation_id").isNull()
    unfinished = F.col("validation_status") != "COMPLETED"
    decision = (
        F.when(none | unvalidated, ANALYSIS_ONLY).when(unfinished, NOT_YET).when(overall == "PASS", APPLY).when(partial, MANUAL).otherwise(NOT_YET)
    )
    reason = (
        F.when(none, F.lit("No remediation has been generated for this finding, so nothing has been validated."))
        .when(
            unvalidated & (F.col("remediation_status") == "FAILED"),
            F.concat(F.lit("Remediation failed ("), F.coalesce("remediation_error", F.lit("no details recorded")), F.lit("); nothing has been validated.")),
        )
        .when(unvalidated, F.concat(F.lit("Remediation "), F.col("remediation_id").cast("string"), F.lit(" has not been validated yet.")))
        .when(unfinished, F.concat(F.lit("Validation "), F.col("validation_id").cast("string"), F.lit(" did not complete (status "), F.col("validation_status"), F.lit(").")))
        .when(overall == "PASS", F.concat(F.lit("Validation passed with tests executed and passing ("), summary, F.lit(").")))
        .when(partial, F.concat(F.lit("Partially validated: installs and is clean, but no automated tests were run ("), summary, F.lit("); test the change manually.")))
        .otherwise(F.concat(F.lit("Validation overall result is "), overall, F.lit(" ("), summary, F.lit(").")))
    )
    return rows.withColumns({"overall_result": overall, "decision": decision, "reason": reason})


def relation_lists(deps: DataFrame, edges: DataFrame) -> DataFrame:
    """Sorted labels of the parents and children of each dependency (dependency_id, package_name, version)."""
    label = T.dependency_label(F.col("package_name"), F.col("version"))
    labels = deps.groupBy("dependency_id").agg(F.min(label).alias("label"))

    def side(own: str, other: str, name: str) -> DataFrame:
        named = edges.join(labels.withColumnsRenamed({"dependency_id": other, "label": "_l"}), other, "left")
        shown = F.coalesce("_l", F.concat(F.lit("dependency #"), F.col(other).cast("string")))
        return named.groupBy(F.col(own).alias("dependency_id")).agg(F.array_sort(F.collect_list(shown)).alias(name))

    none = F.array().cast("array<string>")
    rows = labels.join(side("parent_id", "child_id", "depends_on"), "dependency_id", "left")
    rows = rows.join(side("child_id", "parent_id", "depended_on_by"), "dependency_id", "left")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("depends_on", "depended_on_by")})


def finding_context(findings: DataFrame, repositories: DataFrame, advisories: DataFrame, evidence: DataFrame) -> DataFrame:
    """One denormalised struct row per finding: repository, dependency, vulnerability and usage facts.

    ``findings`` carries repository_id, ecosystem, norm_name, package_name, version, scope, source_file and
    identifier; ``evidence`` the rows of ``usage_evidence`` with norm_name. What repository and package add is put together
    once per package of a repository, so findings are shuffled for it once.
    """
    repo = repositories.select("repository_id", F.struct("name", "source_url", "source_type").alias("repository"))
    vuln = advisories.select(
        "identifier",
        F.struct("identifier", "severity", "cvss_score", "description").alias("vulnerability"),
    )
    usage = evidence.select("repository_id", *PACKAGE, F.struct("import_names", "files", "components", "total_files", "n_config", "truncated", "skipped_files_total", "analysed").alias("usage"))
    subject = ["repository_id", *PACKAGE]
    facts = findings.select(*subject).distinct().join(repo, "repository_id", "left").join(usage, subject, "left")
    facts = facts.withColumnsRenamed({c: f"_{c}" for c in subject})
    # null-safe: the repository of a finding without a package is known all the same
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in subject]
    rows = findings.join(vuln, "identifier", "left").join(facts, same, "left").drop(*facts.columns[: len(subject)])
    verdict = usage_verdict(
        F.col("usage.total_files"), F.col("usage.truncated"), F.col("usage.skipped_files_total"), F.col("scope"), F.col("usage.analysed")
    )
    dependency = F.struct("package_name", "ecosystem", "version", "scope", "source_file")
    keys = [c for c in ("finding_id", "analysis_id", "repository_id") if c in findings.columns]
    return rows.select(
        *keys, "identifier", "repository", dependency.alias("dependency"), "vulnerability", "usage", verdict.alias("usage_verdict"),
        *[c for c in ("risk_level", "severity", "judged_risk") if c in findings.columns],
    )


def evidence_report(contexts: DataFrame, decisions: DataFrame, siblings: DataFrame) -> DataFrame:
    """The ten-section document of each finding; facts, reasoning, recommendations and validation stay apart.

    ``contexts`` comes from ``finding_context``; ``decisions`` is ``final_recommendation`` with finding_id and the
    remediation columns; ``siblings`` is (finding_id, siblings[]). Diff text is redacted.
    """
    kept = [
        "finding_id", "remediation_id", "remediation_status", "current_version", "recommended_version", "diff", "validation_id",
        "validation_status", "build_status", "test_status", "security_scan_status", "overall_result", "decision", "reason",
    ]
    rows = contexts.join(siblings.select("finding_id", "siblings"), "finding_id", "left").join(
        decisions.select(*[c for c in kept if c in decisions.columns]), "finding_id", "left"
    )
    provisional = normalise_severity(F.col("severity"))
    judged = F.col("judged_risk") if "judged_risk" in contexts.columns else F.lit(None).cast("string")
    level = F.coalesce("risk_level", provisional)
    diff = T.redact_secrets(F.col("diff")) if "diff" in decisions.columns else F.lit(None).cast("string")
    no_fix = F.when(F.col("remediation_id").isNull(), F.lit("No remediation generated yet"))
    facts = {
        "Repository": F.to_json("repository"),
        "Analysis": F.to_json(F.struct("analysis_id", "repository_id")),
        "Dependency": F.to_json(F.struct(F.col("dependency"), F.col("siblings").alias("other_vulnerabilities_in_this_analysis"))),
        "Vulnerability": F.to_json("vulnerability"),
        "Evidence": F.to_json(F.struct(F.col("usage"), F.col("usage_verdict"))),
        "Application Impact": F.to_json(F.struct(F.col("usage.components").alias("components"), F.col("usage.files").alias("files"))),
        "Risk Assessment": F.to_json(
            F.struct(F.col("severity"), level.alias("risk_level"), provisional.alias("provisional_risk_from_severity"), risk_origin(judged, level).alias("risk_origin"))
        ),
        "Recommended Remediation": F.to_json(F.struct("remediation_id", F.col("remediation_status").alias("status"))),
    }
    recommendations = {
        "Recommended Remediation": F.to_json(
            F.struct(*[F.col(c) for c in ("current_version", "recommended_version") if c in decisions.columns], diff.alias("diff"))
        ),
        "Final Recommendation": F.to_json(F.struct("decision", "reason")),
    }
    results = {
        "Validation": F.to_json(F.struct("validation_id", F.col("validation_status").alias("status"), "build_status", "test_status", "security_scan_status", "overall_result"))
    }
    notes = {
        "Dependency": F.when(F.col("dependency.version").isNull(), F.lit("The dependency version is not pinned")),
        "Evidence": F.when(F.coalesce(F.col("usage.total_files"), F.lit(0)) == 0, F.col("usage_verdict.message")),
        "Risk Assessment": F.when(risk_origin(judged, level) != "AI", F.concat(F.lit("The risk level is "), risk_origin(judged, level))),
        "Recommended Remediation": no_fix,
        "Validation": F.coalesce(
            no_fix,
            F.when(F.col("validation_id").isNull(), F.lit("No validation run yet")),
            F.when(F.col("test_status") == "SKIPPED", F.lit("Tests were skipped; a skipped test is never reported as PASS")),
        ),
    }
    null = F.lit(None).cast("string")

    def section(number: int, title: str) -> Column:
        return F.struct(
            F.lit(number).alias("number"),
            F.lit(title).alias("title"),
            facts.get(title, null).alias("observed_facts"),
            recommendations.get(title, null).alias("recommendations"),
            results.get(title, null).alias("validation_results"),
            F.array_compact(F.array(notes.get(title, null))).alias("notes"),
        )

    title = F.concat(
        F.lit("Evidence report: "), F.col("dependency.package_name"), F.coalesce(F.concat(F.lit(" "), F.col("dependency.version")), F.lit("")),
        F.lit(" / "), F.col("identifier"), F.lit(" ("), F.coalesce("repository.name", F.lit("?")), F.lit(")"),
    )
    return rows.select(
        "finding_id", "analysis_id", "repository_id", title.alias("title"), "decision", "reason",
        F.array(*[section(i + 1, t) for i, t in enumerate(SECTIONS)]).alias("sections"),
    )


def publish_gate(remediations: DataFrame, validations: DataFrame, force: bool = False) -> DataFrame:
    """May a remediation be published: its newest completed validation passed, at least in part, or is forced."""
    done = latest_per_parent(validations.filter("status = 'COMPLETED'"), "remediation_id", ["validation_id"])
    rows = remediations.join(done.drop("status"), "remediation_id", "left")
    build, tests, security = F.col("build_status"), F.col("test_status"), F.col("security_scan_status")
    missing = F.col("validation_id").isNull()
    good = (overall_result(build, tests, security) == "PASS") | is_partial_pass(build, tests, security) | F.lit(force)
    return rows.withColumns(
        {
            "publishable": ~missing & good,
            "gate_reason": F.when(missing, "not validated").when(~good, F.concat(F.lit("validation result is "), overall_result(build, tests, security))),
        }
    )
