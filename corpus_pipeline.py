"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, langid, mixing, simhash, suffix
from fleetlens.llm.common import crc_fold, free, read, shared_folder, stored

#: A language counts as recognised from this score on.
MIN_LANGUAGE_SCORE = 0.5


def _aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names under others, and the way back, so that no operator replaces them."""
    taken = [c for c in docs.columns if c.lower() in names]
    back = dict(zip(free(docs, *(f"_own_{c}" for c in taken)), taken))
    return docs.withColumnsRenamed({c: own for own, c in back.items()}), back


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network recognises; texts without a letter or of no clear language go, nulls too.

    All stages return an empty table for one, treat repeated rows alike, and take columns of any name.
    """
    named, back = _aside(docs, ["lang_pred", "score"])
    said = langid.identify(named, crc_fold(F.col("doc_id"), 4) != 2)
    kept = said.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate class: SimHashes that link at three differing bits or fewer.

    Classes of five-word shingle sets 0.8 alike or more follow, which three bits miss; the smallest id of both always stays.
    Rows without an id stay, and so do repeated rows of the id that is kept; null texts are empty ones.
    """
    left = simhash.keep_one_per_class(docs, simhash.near_duplicate_classes(docs))
    return simhash.keep_one_per_class(left, simhash.like_classes(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document has in a string of 50; documents of which nothing is left go."""
    named, back = _aside(docs, ["n_bytes", "n_removed", "n_spans", "kept_sha256"])
    cut = suffix.remove_repeats(named)
    left = cut.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", n_chars).select(*[f"`{c}`" for c in named.columns]).withColumnsRenamed(back)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a test item; each row, with an id or none, by its own text."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, in the order of their virtual finish times; the mix's columns replace others of their names."""
    return mixing.training_order(mixing.mix_words(docs)).drop("queue_key", "queue_start")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mix),
]

#: A trained network, byte-level matching and alignment have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents`` after all stages; intermediate tables lie in the folder of ``spark.checkpoint.dir``."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/stage-{k}")
    return docs
