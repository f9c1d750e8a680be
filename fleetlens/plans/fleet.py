"""The end-to-end fleet jobs: dependencies and advisories to findings and overall risk."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens.functions import scores as S
from fleetlens.operators import matching as M
from fleetlens.operators import risk as R
from fleetlens.operators import advisories as A
from fleetlens.operators import ranks
from fleetlens.operators import remediate as K
from fleetlens.functions import versions as V
from fleetlens.plans.bindings import fixture
from fleetlens.session import shared_dir, shuffles_removed
from fleetlens.skew import hot_keys, salted_join


class MatchRun:
    """The stored tables of one matching run over a snapshot: each is computed once, whichever query asks first.

    ``dependencies`` with normalised names, ``counted`` lookups, the version ``index``, the ``names`` and ``merged`` records
    of alias groups, ``spans`` and ``fixes`` of merged advisories, canonical ``hits`` and ``statuses``. They are Parquet
    tables below the shared folder, so a lost executor costs a read and no query plans the matching again.
    """

    def __init__(self, spark: SparkSession, d: str) -> None:
        self.spark, self.d = spark, d
        self.folder = f"{shared_dir(spark)}/match-{uuid.uuid4().hex}"
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str, build: Callable[[], DataFrame] | None = None) -> DataFrame:
        """The stored table of this name; ``build`` says how to make one that is not of the run itself."""
        if name not in self.tables:
            rows = build() if build else getattr(self, f"_{name}")()
            with shuffles_removed(self.spark):
                rows.write.parquet(f"{self.folder}/{name}")
            self.tables[name] = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")
        return self.tables[name]

    def _dependencies(self) -> DataFrame:
        return M.with_lookup_key(fixture(self.spark, self.d, "fx_dependencies"))

    def _counted(self) -> DataFrame:
        return M.count_lookups(self.table("dependencies"))

    def _ranges(self) -> DataFrame:
        return fixture(self.spark, self.d, "fx_advisories").select(
            "identifier",
            "ecosystem",
            V.normalize_package_name(F.col("package_name"), F.col("ecosystem")).alias("norm_name"),
            F.lit("ECOSYSTEM").alias("range_type"),
            "introduced",
            "fixed",
            F.lit(None).cast("string").alias("last_affected"),
        )

    def _releases(self) -> DataFrame:
        name = V.normalize_package_name(F.col("package_name"), F.col("ecosystem")).alias("norm_name")
        return fixture(self.spark, self.d, "fx_releases").select("ecosystem", name, "version", (~F.col("withdrawn")).alias("installable"))

    def _index(self) -> DataFrame:
        return ranks.version_index(self.table("counted"), self.table("releases"), ranks.bound_versions(self.table("ranges")))

    def _lookups(self) -> DataFrame:
        return self.table("counted").join(self.table("index").select(*M.LOOKUP, "version_key", "rank", "n_ranks"), M.LOOKUP)

    def _records(self) -> DataFrame:
        return scored_advisories(self.spark, self.d).select(
            "identifier",
            F.array_compact(F.array("alias")).alias("aliases"),
            "severity",
            "cvss_score",
            "cvss_vector",
            F.lit(None).cast("timestamp").alias("published_at"),
        )

    def _groups(self) -> DataFrame:
        return A.alias_groups(self.table("records").select("identifier", "aliases"))

    def _names(self) -> DataFrame:
        return A.canonical_map(self.table("records"), self.table("groups"))

    def _merged(self) -> DataFrame:
        return A.merge_group(self.table("records"), self.table("groups")).select("identifier", "severity", "cvss_score")

    def _issue_ranges(self) -> DataFrame:
        """Intervals under the canonical name of their issue."""
        named = self.table("ranges").join(self.table("names"), "identifier", "left")
        return named.withColumn("identifier", F.coalesce("canonical", "identifier")).drop("canonical").distinct()

    def _spans(self) -> DataFrame:
        return ranks.rank_spans(self.table("issue_ranges"), self.table("index"))

    def _fixes(self) -> DataFrame:
        return K.safe_fixes(self.table("issue_ranges"), self.table("index"))

    def _installable(self) -> DataFrame:
        return K.installable_releases(self.table("releases"), self.table("index"))

    def _upcoming(self) -> DataFrame:
        return K.next_releases(self.table("installable"), self.table("index"))

    def _hits(self) -> DataFrame:
        """Spans of an issue are made disjoint and take their severity before they meet the lookups: no shuffle carries hits."""
        rated = ranks.union_spans(self.table("spans"), ("identifier",)).join(self.table("merged"), "identifier")
        kept = ["identifier", "severity", "cvss_score"]
        found = ranks.covering(self.table("lookups").select(*M.LOOKUP, "rank", "n_ranks"), rated, kept)
        return found.select("identifier", *M.LOOKUP, "rank", "severity", "cvss_score")

    def _floors(self) -> DataFrame:
        return K.minimum_fixed_version(self.table("hits"), self.table("fixes"))

    def _candidates(self) -> DataFrame:
        """The first candidate of every lookup that has a fix: its floor, moved to the next release."""
        floors = self.table("floors")
        rows = floors.join(K.snap_to_release(floors, self.table("upcoming")).drop("floor_rank"), [*K.PACKAGE, "floor"])
        return rows.withColumnsRenamed({"snapped": "candidate", "snapped_rank": "candidate_rank"})

    def _candidate_hits(self) -> DataFrame:
        """The issues that the first candidates still have."""
        sizes = self.table("index").select(*K.PACKAGE, "n_ranks").distinct()
        asked = self.table("candidates").select(*K.PACKAGE, "candidate", F.col("candidate_rank").alias("rank")).distinct()
        return ranks.covering(asked.join(sizes, K.PACKAGE), self.table("spans"), ["identifier"]).distinct()

    def _statuses(self) -> DataFrame:
        return M.lookup_status(self.table("lookups"), self.table("hits"))

    def _hot(self) -> DataFrame:
        return hot_keys(self.table("counted"), "n_dependencies").select(*M.LOOKUP)


_RUNS: dict[tuple, MatchRun] = {}


def run(spark: SparkSession, d: str) -> MatchRun:
    """The run of this session over the snapshot in ``d``; changed files are another snapshot."""
    files = []
    for name in ("lineitem", "part", "orders", "customer"):
        # a row per file: nothing of the table itself is read
        seen = F.struct("path", "length", F.col("modificationTime").cast("string"))
        try:
            listed = spark.read.format("binaryFile").load(f"{d}/{name}.parquet")
        except AnalysisException:  # a snapshot without analyses
            continue
        files += listed.agg(F.count("*"), F.min(seen), F.max(seen)).first()
    key = (spark.sparkContext.applicationId, d, *files)
    if key not in _RUNS:
        _RUNS[key] = MatchRun(spark, d)
    return _RUNS[key]


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d).table("dependencies")


def scored_advisories(spark: SparkSession, d: str) -> DataFrame:
    return S.score_advisories(fixture(spark, d, "fx_advisories").withColumn("label", F.lit(None).cast("string")))


def ranges(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d).table("ranges")


def lookups(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, d).table("lookups")


def raw_hits(spark: SparkSession, d: str) -> DataFrame:
    """(ecosystem, norm_name, version, identifier): every advisory record that matches, aliases apart."""
    own = run(spark, d)
    return M.advisory_match(own.table("lookups"), own.table("ranges"), index=own.table("index"))


def canonical(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(identifier -> canonical, canonical identifier with merged severity and score): aliases merged once, E4-E8."""
    own = run(spark, d)
    return own.table("names"), own.table("merged")


def hits(spark: SparkSession, d: str) -> DataFrame:
    """(ecosystem, norm_name, version, identifier, severity, cvss_score), one row per issue whatever its names."""
    return run(spark, d).table("hits").drop("rank")


def classified(spark: SparkSession, d: str) -> DataFrame:
    own = run(spark, d)
    return M.classify_dependencies(own.table("dependencies"), own.table("statuses"), hot=own.table("hot"))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return M.create_findings(dependencies(spark, d), hits(spark, d), hot=run(spark, d).table("hot"))


def fleet_risk(deps: DataFrame, analyses: DataFrame, hit_rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Overall risk of every analysis with how much of it is vulnerable.

    Findings are counted per (analysis, lookup) without being written out: the hits of a lookup are first reduced
    to (number, worst level), so the join back to the dependencies emits one row per dependency, not per finding.
    """
    per_lookup = hit_rows.groupBy(*M.LOOKUP).agg(
        F.count("*").alias("n_hits"), F.max(S.risk_rank(M.provisional_risk(F.col("severity")))).alias("worst")
    )
    met = deps.join(per_lookup, M.LOOKUP, "left") if hot is None else salted_join(deps, per_lookup, M.LOOKUP, hot, "left")
    per_analysis = (
        met.groupBy("analysis_id")
        .agg(
            F.count("*").alias("dependencies"),
            F.count("n_hits").alias("vulnerable"),
            F.coalesce(F.sum("n_hits"), F.lit(0)).alias("findings"),
            F.max("worst").alias("worst"),
        )
    )
    level = R.level_of_rank(F.col("worst"))
    return (
        analyses.select("analysis_id", "repository_id")
        .join(per_analysis, "analysis_id", "left")
        .select(
            "analysis_id",
            "repository_id",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("dependencies", "vulnerable", "findings")],
            F.coalesce(level, F.lit("NONE")).alias("overall_risk"),
        )
    )
