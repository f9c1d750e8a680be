"""Advisory and registry feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import scores as S
from fleetlens.functions import versions as V
from fleetlens.operators.advisories import derive_fixed_versions, flatten_range_events

_STR = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_EVENT = _struct(introduced=_STR, fixed=_STR, last_affected=_STR)
_RANGE = _struct(type=_STR, events=T.ArrayType(_EVENT))
_AFFECTED = _struct(
    package=_struct(ecosystem=_STR, name=_STR), ranges=T.ArrayType(_RANGE), versions=T.ArrayType(_STR)
)
OSV = T.StructType(
    _struct(
        id=_STR,
        summary=_STR,
        details=_STR,
        aliases=T.ArrayType(_STR),
        published=_STR,
        modified=_STR,
        database_specific=_struct(severity=_STR),
        severity=T.ArrayType(_struct(type=_STR, score=_STR)),
        references=T.ArrayType(_struct(type=_STR, url=_STR)),
        affected=T.ArrayType(_AFFECTED),
    ).fields
    + [T.StructField("_corrupt_record", _STR)]
)


def _texts(values: Column) -> Column:
    return F.coalesce(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def parse_advisories(raw: DataFrame, text: str = "value", source: str = "osv") -> DataFrame:
    """Advisory rows from one JSON document per row; unreadable ones keep their text in ``_corrupt_record``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    doc = raw.select(F.col(text).alias("_text"), F.from_json(F.col(text), OSV, options).alias("r"))
    scored = doc.withColumn("_cvss", S.pick_cvss_entry(F.col("r.severity"))).withColumn(
        "_ref", S.pick_reference_url(F.col("r.references"))
    )
    identifier = V.strip(F.col("r.id"))
    empty = F.lit("")

    def package(a: Column) -> Column:
        ranges = flatten_range_events(a["ranges"])
        return F.struct(
            a["package"]["ecosystem"].alias("ecosystem"),
            a["package"]["name"].alias("package_name"),
            ranges.alias("ranges"),
            _texts(a["versions"]).alias("versions"),
            derive_fixed_versions(ranges, a["package"]["ecosystem"]).alias("fixed_versions"),
        )

    named = F.filter(
        F.col("r.affected"),
        lambda a: a["package"]["ecosystem"].isNotNull() & (F.coalesce(a["package"]["name"], empty) != ""),
    )
    bad = F.col("r._corrupt_record").isNotNull() | (F.coalesce(identifier, empty) == "")
    return scored.select(
        F.when(identifier != "", identifier).alias("identifier"),
        F.lit(source).alias("source"),
        _texts(F.col("r.aliases")).alias("aliases"),
        F.nullif(F.col("r.summary"), empty).alias("summary"),
        F.nullif(F.col("r.details"), empty).alias("description"),
        S.pick_severity(F.col("r.database_specific.severity"), F.col("_cvss.score")).alias("severity"),
        F.col("_cvss.score").alias("cvss_score"),
        F.col("_cvss.vector").alias("cvss_vector"),
        S.parse_osv_timestamp(F.col("r.published")).alias("published_at"),
        S.parse_osv_timestamp(F.col("r.modified")).alias("modified_at"),
        F.col("_ref.url").alias("reference_url"),
        F.col("_ref.urls").alias("references"),
        F.coalesce(F.transform(named, package), F.expr("array()")).alias("affected"),
        F.when(bad, F.col("_text")).alias("_corrupt_record"),
        F.when(F.col("r._corrupt_record").isNotNull(), "malformed record").when(bad, "record without an id").alias("_reason"),
    )


def scan_advisories(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """A4: a bulk export, one JSON advisory per line or per file, as advisory rows."""
    return parse_advisories(spark.read.text(path, wholetext=one_per_file))


def split_malformed(advisories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A5: (usable advisories, rejected documents); one bad record never costs another one."""
    good = advisories.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record", "_reason")
    bad = advisories.filter(F.col("_corrupt_record").isNotNull()).select(
        "identifier",
        F.col("_reason").alias("reason"),
        F.col("_corrupt_record").alias("document"),
    )
    return good, bad


def unanswered_lookups(answers: DataFrame, bad: DataFrame, key: list[str]) -> DataFrame:
    """A5: lookups whose answer names a rejected advisory; F3 reports them UNKNOWN, never SAFE."""
    rejected = bad.filter("identifier IS NOT NULL").select("identifier").distinct()
    return answers.join(rejected, "identifier", "left_semi").select(*key).distinct()


_FILES = T.ArrayType(_struct(yanked=T.BooleanType()))
_PYPI_DOC = _struct(releases=T.MapType(_STR, _FILES))
_NPM_DOC = _struct(versions=T.MapType(_STR, _struct(deprecated=_STR)))


def parse_registry(raw: DataFrame, text: str = "value") -> DataFrame:
    """(ecosystem, package_name, version, installable, withdrawn_reason) from registry documents.

    ``raw`` carries ecosystem and package_name next to the JSON text. PyPI releases without files do not exist;
    those with only yanked files and npm versions with a deprecation message are withdrawn.
    """
    pypi = (
        raw.filter(F.col("ecosystem") == V.PYPI)
        .select("ecosystem", "package_name", F.explode(F.from_json(F.col(text), _PYPI_DOC)["releases"]).alias("version", "files"))
        .filter(F.size("files") > 0)
        .withColumn("withdrawn_reason", F.when(F.forall("files", lambda f: F.coalesce(f["yanked"], F.lit(False))), "yanked"))
    )
    npm = raw.filter(F.col("ecosystem") == V.NPM).select(
        "ecosystem", "package_name", F.explode(F.from_json(F.col(text), _NPM_DOC)["versions"]).alias("version", "meta")
    )
    npm = npm.withColumn("withdrawn_reason", F.nullif(F.col("meta.deprecated"), F.lit("")))
    columns = ["ecosystem", "package_name", "version", "withdrawn_reason"]
    return (
        pypi.select(*columns)
        .unionByName(npm.select(*columns))
        .withColumn("installable", F.col("withdrawn_reason").isNull())
    )


def scan_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry documents stored as ``<path>/<ecosystem>/<package>.json``."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_file", F.input_file_name())
    parts = F.split(F.url_decode("_file"), "/")  # Spark escapes file names once more
    return parse_registry(
        raw.select(
            F.element_at(parts, -2).alias("ecosystem"),
            F.regexp_replace(F.url_decode(F.element_at(parts, -1)), r"\.json$", "").alias("package_name"),
            "value",
        )
    )
