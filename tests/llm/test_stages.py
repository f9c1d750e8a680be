"""The near-duplicate stage of the pipeline goes by SimHash; shingle sets that are alike follow."""

from __future__ import annotations

import corpus_pipeline


def test_near_duplicates_are_those_of_simhash(spark):
    from test_dedup import plain_simhash
    from tests_llm_text import prose

    # one passage many times over decides the SimHash, the sets of shingles have little in common
    rows = [(k, "a b c " * 300 + prose(k, 30)) for k in (1, 2)] + [(3, prose(3, 90))]
    assert (plain_simhash(rows[0][1]) ^ plain_simhash(rows[1][1])).bit_count() <= 3
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
