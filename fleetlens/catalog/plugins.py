"""Queries of the SQL functions and the plug-in registries (O)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.base import Group
from fleetlens.catalog.extraction import _REQ
from fleetlens.catalog.sqlparts import band, cvss, major, norm
from fleetlens.functions import sqlfuncs
from fleetlens.plans.bindings import ctes, fixture
from fleetlens.sources import plugins

GROUP = Group()
query = GROUP.query


@query(
    "register_functions",
    ctes("fx_dependencies", "fx_advisories")
    + f""", d AS (SELECT ecosystem, {norm()} AS norm_name, max({major()}) AS newest_major FROM fx_dependencies GROUP BY 1, 2)
 SELECT a.identifier, d.norm_name, d.newest_major, {cvss()} AS score, {band(cvss())} AS severity FROM fx_advisories a JOIN d ON d.ecosystem = a.ecosystem AND d.norm_name = {norm('a.package_name', 'a.ecosystem')}""",
)
def _functions(spark, d):
    sqlfuncs.register(spark)
    return spark.sql(
        """WITH d AS (SELECT ecosystem, fl_normalize_package_name(package_name, ecosystem) AS norm_name, CAST(max(fl_major_of(version, ecosystem)) AS BIGINT) AS newest_major FROM {deps} GROUP BY 1, 2),
 a AS (SELECT identifier, ecosystem, fl_normalize_package_name(package_name, ecosystem) AS norm_name, fl_cvss_v3_base_score(cvss_vector) AS score FROM {advisories})
 SELECT a.identifier, a.norm_name, d.newest_major, a.score, fl_severity_from_score(a.score) AS severity FROM a JOIN d ON d.ecosystem = a.ecosystem AND d.norm_name = a.norm_name""",
        deps=fixture(spark, d, "fx_dependencies"),
        advisories=fixture(spark, d, "fx_advisories"),
    )


@query(
    "extractor_plugin",
    _REQ
    + """ SELECT extractor, count(*) AS n FROM (SELECT 'python' AS extractor FROM fx_requirement_files WHERE version IS NULL OR version <> 'not-a-version' UNION ALL SELECT 'python' FROM fx_requirement_files UNION ALL SELECT 'python' FROM fx_requirement_files UNION ALL SELECT 'wheels' FROM fx_requirement_files) u GROUP BY 1""",
)
def _extractor(spark, d):
    def wheels(files):
        """A new ecosystem: one dependency per wheel link."""
        found = files.select("repository_id", "path", F.explode(F.regexp_extract_all("content", F.lit(r"([A-Za-z0-9_]+)\.whl"), 1)).alias("name"))
        null = F.lit(None).cast("string")
        return found.select(
            "repository_id", F.col("name").alias("package_name"), F.lit("wheel").alias("ecosystem"), F.col("path").alias("source_file"),
            null.alias("version"), null.alias("version_spec"), F.lit("unknown").alias("scope"), F.lit(False).alias("dev"), F.lit(0).alias("line_no"),
        )

    plugins.register_extractor("wheels", wheels)
    plugins.register_extractor("broken", lambda files: files.select("no_such_column"))
    files = fixture(spark, d, "fx_requirement_files").select("repository_id", "path", "content")
    rows, _ = plugins.run_extractors(files, ["python", "wheels", "broken"])
    return rows.groupBy("extractor").agg(F.count("*").alias("n"))


@query(
    "advisory_source_plugin",
    ctes("fx_advisories")
    + """, r AS (SELECT 'osv' AS source, identifier, CASE WHEN identifier LIKE 'CVE-%' THEN identifier ELSE alias END AS key FROM fx_advisories UNION ALL SELECT 'mirror', 'MIR-' || identifier, alias FROM fx_advisories)
 SELECT source, identifier, min(identifier) OVER (PARTITION BY key) AS group_id FROM r""",
)
def _feed(spark, d):
    advisories = fixture(spark, d, "fx_advisories")
    plugins.register_feed("osv", lambda: advisories.select("identifier", F.array("alias").alias("aliases")))
    plugins.register_feed("mirror", lambda: advisories.select(F.concat(F.lit("MIR-"), "identifier").alias("identifier"), F.array("alias").alias("aliases")))
    return plugins.run_feeds(["osv", "mirror"]).select("source", "identifier", "group_id")
