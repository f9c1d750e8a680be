"""A1: the fleet's file table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.text import EXTRACTOR_IGNORED, decode_text, parent_dir, prune_paths


def scan_files(
    spark: SparkSession,
    root: str,
    max_depth: int | None = None,
    max_bytes: int | None = None,
    ignored: list[str] = EXTRACTOR_IGNORED,
    glob: str | None = None,
    keep_hidden: list[str] | None = None,
    repository_level: bool = False,
) -> DataFrame:
    """A1: files below ``root`` as (path, length, is_too_large, content), ignored directories and deep paths removed.

    Without ``max_bytes`` every file is read; with it ``content`` is null for larger ones, which ``is_too_large`` marks and
    ``operators.dependencies.unread_warnings`` reports, so none is left out in silence. A job that does not select it never reads file bodies, and
    the name pattern is applied while listing. With ``repository_level`` the first directory below ``root`` is the
    repository id and ``path`` starts below it. Hidden and symbolic files follow the file system's listing rules.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    relative = F.substring_index(F.col("path"), base + "/", -1)
    files = reader.load(root).select(relative.alias("path"), "length", "content")
    if repository_level:
        files = files.select(
            F.substring_index("path", "/", 1).alias("repository_id"),
            F.regexp_replace("path", "^[^/]*/", "").alias("path"),
            "length",
            "content",
        )
    if max_depth is not None:
        directory = parent_dir(F.col("path"))
        files = files.filter(F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/"))) <= max_depth)
    files = prune_paths(files, ignored, keep_hidden=keep_hidden)
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    return files.withColumn("is_too_large", too_large).withColumn("content", F.when(~too_large, F.col("content")))


def read_text_files(files: DataFrame) -> DataFrame:
    """The scanned files with their bytes decoded (A2); too large ones keep a null content.

    Spark fails a job on a malformed UTF-16 unit unless the session's coding-error setting says "replace". The
    setting is read when the expression is analysed, so it only has to hold while this projection is built.
    """
    spark, setting = files.sparkSession, "spark.sql.legacy.codingErrorAction"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        return files.withColumn("content", decode_text(F.col("content")))
    finally:
        spark.conf.set(setting, before)
