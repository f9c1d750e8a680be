"""O2, O3: registries of further ecosystems and advisory feeds. A plug-in is a function between DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from fleetlens.operators import advisories as A
from fleetlens.operators.extract_npm import extract_npm
from fleetlens.operators.extract_python import DEPENDENCY_COLUMNS, extract_python
from fleetlens.session import cut_lineage

EXTRACTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"python": lambda files: extract_python(files)[0], "npm": lambda files: extract_npm(files)[0]}
FEEDS: dict[str, Callable[[], DataFrame]] = {}


def register_extractor(name: str, extract: Callable[[DataFrame], DataFrame]) -> None:
    """O2: ``extract`` turns the file table (repository_id, path, content) into dependency rows."""
    EXTRACTORS[name] = extract


def register_feed(name: str, read: Callable[[], DataFrame]) -> None:
    """O3: ``read`` returns advisory records (identifier, aliases[], …)."""
    FEEDS[name] = read


def run_extractors(files: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """O2: united dependency rows of the extractors; one that cannot be planned becomes a warning."""
    rows, warnings = None, []
    for name in names or list(EXTRACTORS):
        try:
            part = EXTRACTORS[name](files).select(*DEPENDENCY_COLUMNS).withColumn("extractor", F.lit(name))
        except (AnalysisException, ValueError, KeyError, TypeError) as error:
            warnings.append(f"{name}: extraction failed ({type(error).__name__})")
            continue
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no extractor could run: " + "; ".join(warnings))
    return rows, warnings


def run_isolated(files: DataFrame, folder: str, names: list[str] | None = None, parts: int = 16) -> tuple[DataFrame, DataFrame]:
    """O2 with quarantine: (dependency rows, rejected (extractor, repository_id, path, reason)); no plug-in ends the job.

    Every extractor writes its rows apart. One that fails at run time is tried again on ``parts`` shares of the files, and
    so on, until a failing share is one file, which goes to the rejected files: as many rounds as a search tree over the files
    has levels, and only failing shares are read again. What is written is a whole table per share, so no row of a failed
    attempt is read. An extractor that cannot even be planned rejects all its files at once.
    """
    spark = files.sparkSession
    keys = ["repository_id", "path"]
    files = cut_lineage(files)
    written, rejected = [], []

    def attempt(name: str, share: DataFrame, place: str, level: int) -> None:
        path = f"{folder}/{name}/{place}"
        try:
            EXTRACTORS[name](share).select(*DEPENDENCY_COLUMNS).withColumn("extractor", F.lit(name)).write.mode("overwrite").parquet(path)
            written.append(path)
            return
        except (AnalysisException, ValueError, KeyError, TypeError) as error:
            planned, reason = False, type(error).__name__
        except Exception as error:  # a plug-in may fail in any way, and the job goes on
            planned, reason = True, type(error).__name__
        if not planned or share.select(*keys).distinct().limit(2).count() < 2:
            rejected.append(share.select(F.lit(name).alias("extractor"), *keys, F.lit(reason).alias("reason")).distinct())
            return
        deal = F.pmod(F.xxhash64(*keys, F.lit(level)), F.lit(parts))
        for k in sorted(r[0] for r in share.select(deal).distinct().collect()):  # at most ``parts`` numbers
            attempt(name, share.filter(deal == k), f"{place}-{k}", level + 1)

    for name in names or list(EXTRACTORS):
        attempt(name, files, "all", 0)
    none = files.select(F.lit("").alias("extractor"), *keys, F.lit("").alias("reason")).limit(0)
    if not written:
        raise ValueError("no extractor could run")
    rows = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in written])
    return rows, reduce(DataFrame.unionByName, rejected, none)


def run_feeds(names: list[str] | None = None) -> DataFrame:
    """O3: records of all feeds with the group that merges their aliases."""
    records = None
    for name in names or list(FEEDS):
        part = FEEDS[name]().withColumn("source", F.lit(name))
        records = part if records is None else records.unionByName(part, allowMissingColumns=True)
    return records.join(A.alias_groups(records.select("identifier", "aliases")), "identifier")
