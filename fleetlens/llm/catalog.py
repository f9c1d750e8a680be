"""The registered queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, imatch, langid, merkle, mixing, pages, quality, simhash, spelling, suffix, tokencounts, toxicity, vectors
from fleetlens.llm.common import crc_fold, read

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_fold(F.col("doc_id"), 3) == 1
    scored = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_fold(F.col("doc_id"), 4) == 2
    said = langid.identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ~held)
    return said.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.corpus_totals(spark, read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_fold(F.col("doc_id"), 4) == 2
    scored = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_manifest(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_simhash, op2_decontaminate, op3_suffix_dedup, op4_html_extraction, op5_toxicity, op6_language_id, op7_token_counts, op8_quality, op9_mixing, op10_imatch, op11_spelling, op12_embedding_dedup, op13_merkle, pipeline]
    return {q.__name__: q for q in own}


def oracles() -> dict[str, str]:
    return {"op7_token_counts": tokencounts.TOTALS_SQL, "op9_mixing": mixing.MIX_SQL, "op11_spelling": spelling.VARIANTS_SQL, "op12_embedding_dedup": vectors.NEAR_SQL, "op13_merkle": merkle.MANIFEST_SQL}
