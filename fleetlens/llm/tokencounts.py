"""Token-count rollups kept up to date by signed deltas in idempotent batch commits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import shared_folder, stored, words

KEYS = ("source", "lang", "version")
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
#: A word of tokenizer version words-2: a run of letters and digits, or any other single code point but white space.
PIECES = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"


def inserts(docs: DataFrame, tokens: Column, version: str) -> DataFrame:
    """Signed rows of documents that arrive: (source, lang, version, n_docs, n_tokens). Null counts are 0."""
    return docs.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("n_docs"), F.coalesce(tokens.cast("long"), F.lit(0)).alias("n_tokens"))


def deletes(docs: DataFrame, tokens: Column, version: str) -> DataFrame:
    """Signed rows of documents that leave, with the count they had."""
    return inserts(docs, tokens, version).withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})


def revisions(docs: DataFrame, old: Column, old_version: str, new: Column, new_version: str) -> DataFrame:
    """Signed rows of documents whose count changes, also from one tokenizer version to another."""
    return deletes(docs, old, old_version).unionByName(inserts(docs, new, new_version))


def _committed(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch string").parquet(f"{store}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Adds one batch of signed rows to the rollup in ``store``; False if the batch was committed before.

    Rows are added up per key before they are written, so a batch costs one row per source, language and version, and a
    hot source is combined inside every input partition. The delta folder of a batch is overwritten until its commit
    row exists: a batch that failed half way, or comes twice, counts once. One writer per batch id at a time.
    """
    if not batch or any(c in batch for c in "/='"):
        raise ValueError("a batch id is not empty and has none of / = '")
    done = _committed(spark, store)
    if done is not None and not done.filter(F.col("batch") == batch).isEmpty():
        return False
    sums = changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")
    sums.withColumn("batch", F.lit(batch)).coalesce(1).write.mode("overwrite").parquet(f"{store}/deltas/part={batch}")
    spark.range(1).select(F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{store}/commits")
    return True


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens) over all committed batches; keys whose totals came back to zero are left out."""
    done = _committed(spark, store)
    if done is None:
        return spark.createDataFrame([], _SCHEMA)
    deltas = spark.read.schema(f"{_SCHEMA}, batch string").option("recursiveFileLookup", "true").parquet(f"{store}/deltas")
    live = deltas.join(done.distinct(), "batch", "left_semi")
    return live.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs != 0 or n_tokens != 0")


def tokenizer_counts(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """All columns of ``docs`` with n_tokens by a public tokenizer given as the text of its ``tokenizer.json``; null text: 0."""
    from pyspark.sql import types as T

    docs = docs.drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        for batch in batches:
            n = [len(tokenizer.encode(t, add_special_tokens=False).ids) if t else 0 for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_tokens"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def corpus_totals(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rollup of a corpus after three commits: all documents arrive (words-1); the later copies of a text leave;
    documents of other languages than English, null included, are recounted from words-1 to words-2.

    The second batch is delivered twice and counts once. Null texts have no words; a copy is a row of an equal non-null
    text whose doc_id is larger than the smallest one; rows with a null id are no copies and repeated rows count each.
    """
    folder = shared_folder(spark)
    pieces = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PIECES), F.lit(0)))
    counted = docs.select("doc_id", "source", "lang", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("_sha"), F.size(words(F.col("text"))).alias("_one"), pieces.alias("_two"))
    counted = stored(counted, f"{folder}/counted")
    first = counted.filter("_sha is not null").groupBy("_sha").agg(F.min("doc_id").alias("_first"))
    marked = counted.join(first, "_sha", "left").withColumn("_copy", F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)))
    store = f"{folder}/rollup"
    commit(spark, store, "arrivals", inserts(counted, F.col("_one"), "words-1"))
    copies = deletes(marked.filter("_copy"), F.col("_one"), "words-1")
    for _ in range(2):
        commit(spark, store, "copies", copies)
    moved = marked.filter(~F.col("_copy") & F.coalesce(F.col("lang") != "en", F.lit(True)))
    commit(spark, store, "recount", revisions(moved, F.col("_one"), "words-1", F.col("_two"), "words-2"))
    return totals(spark, store)


#: DuckDB SQL for ``corpus_totals`` over ``documents``.
TOTALS_SQL = r"""
WITH c AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS one,
                  len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS two FROM documents),
k AS (SELECT source, lang, one, two FROM c WHERE NOT coalesce(text IS NOT NULL AND doc_id > first_id, false))
SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'words-2' END AS version, count(*) AS n_docs,
       CAST(sum(CASE WHEN lang = 'en' THEN one ELSE two END) AS BIGINT) AS n_tokens
FROM k GROUP BY ALL
"""
