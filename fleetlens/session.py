"""Session set-up and the reliable-checkpoint helper every iterative operator uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "fleetlens", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("fleetlens.spread", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def join_by_measured_size(spark: SparkSession) -> None:
    """Broadcasts are chosen from the bytes that a shuffle has measured, no longer from the size of files.

    A Parquet file of repetitive rows is a tenth to a hundredth of what its rows take in memory, so the limit for file sizes
    would send tables of millions of rows through the driver. The limit itself stays and is now adaptive execution's; what
    a session has set there, or switched off, stays too.
    """
    conf = spark.conf
    limit = conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit != "-1" and conf.get("spark.sql.adaptive.enabled") == "true":
        if conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    """One temporary folder per local application, only for runs on a single machine."""
    return tempfile.mkdtemp(prefix=f"fleetlens-{application}-")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in here remove their shuffle files when they end, as later steps read what was written.

    Otherwise they lie on the executors' disks until the driver happens to collect its garbage, so a job of many stored
    steps holds the shuffles of all of them.
    """
    conf, setting = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(setting)
    conf.set(setting, "true")
    try:
        yield
    finally:
        conf.set(setting, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: survives the loss of executors, and its size is known to later joins.

    A checkpoint would compute the last stage twice, once to count and once to write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
