import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import imatch, mixing, simhash, suffix, tokencounts
from fleetlens.llm.catalog import oracles, queries

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def sorted_rows(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def sql_rows(sql, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def test_mixing_is_the_sql(odd_docs, no_docs, tmp_path):
    columns, want = sql_rows(mixing.MIX_SQL, odd_docs, tmp_path)
    got = mixing.mix_words(odd_docs).select(*columns).collect()
    assert sorted_rows(got) == sorted_rows(want)
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r.size for r in got), abs=4)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    order = mixing.training_order(mixing.mix_words(odd_docs)).collect()
    assert sum(r.copy_taken for r in order) == sum(r.taken for r in got) and [r.finish for r in order] == sorted(r.finish for r in order)
    assert mixing.mix_words(no_docs).count() == 0 and mixing.training_order(mixing.mix_words(no_docs)).count() == 0


def test_targets_by_repeated_sharing(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 40), (None, 300), ("d", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    left, budget, want = {s: [3, 1, 2, 3, 1][k] for k, s in enumerate(["a", "b", "c", "d", None])}, 1.5 * 1350, {}
    while True:
        share = {s: budget * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * dict(sizes)[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * dict(sizes)[s]
            budget -= want[s]
            del left[s]
    assert got == pytest.approx(want | share)


def test_token_totals_are_the_sql(spark, odd_docs, no_docs, tmp_path):
    columns, want = sql_rows(tokencounts.TOTALS_SQL, odd_docs, tmp_path)
    assert sorted_rows(tokencounts.corpus_totals(spark, odd_docs).select(*columns).collect()) == sorted_rows(want)
    assert tokencounts.corpus_totals(spark, no_docs).count() == 0


def test_batches_count_once(spark, tmp_path):
    store = str(tmp_path / "rollup")
    docs = spark.createDataFrame([("a", "en", 3), ("a", None, None), (None, "en", 7)], "source string, lang string, n long")
    assert tokencounts.totals(spark, store).count() == 0
    assert tokencounts.commit(spark, store, "b1", tokencounts.inserts(docs, F.col("n"), "v1"))
    assert not tokencounts.commit(spark, store, "b1", tokencounts.inserts(docs, F.col("n"), "v1"))
    # a batch that failed before its commit row: its delta is there, but does not count until it is delivered again
    tokencounts.inserts(docs, F.col("n"), "v9").withColumn("batch", F.lit("b2")).write.parquet(f"{store}/deltas/part=b2")
    assert {r.version for r in tokencounts.totals(spark, store).collect()} == {"v1"}
    gone = docs.filter("source is null")
    assert tokencounts.commit(spark, store, "b2", tokencounts.revisions(gone, F.col("n"), "v1", F.col("n") + 1, "v2"))
    got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in tokencounts.totals(spark, store).collect()}
    assert got == {("a", "en", "v1"): (1, 3), ("a", None, "v1"): (1, 0), (None, "en", "v2"): (1, 8)}


def test_a_public_tokenizer(spark, odd_docs):
    path = os.environ.get("FLEETLENS_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    with open(path) as f:
        rows = tokencounts.tokenizer_counts(odd_docs, f.read()).collect()
    assert all((r.n_tokens > 0) == bool(r.text) for r in rows)


def test_edited_texts(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    got = imatch.edited_likeness(odd_docs).collect()
    assert len(got) == len(rows)
    by_id = sorted({r.doc_id: r.text or "" for r in rows if r.doc_id is not None and r.doc_id != 18}.items(), reverse=True)
    texts = {r.doc_id: r for r in got if r.doc_id is not None}
    for (i, text), (_, after) in zip(by_id, by_id[1:]):
        if i != 19:  # what follows 19 is one of the rows of 18
            m = len(text) // 3
            assert texts[i].edited_sha256 == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest() and texts[i].n_chars == len(text)
    prints = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 18:
            prints.setdefault(dict(by_id)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert imatch.edited_likeness(no_docs).count() == 0


def test_equal_rows_follow_one_another(spark):
    rows = [(5, "five five words stand right here")] * 40 + [(7, "seven other words that stand over there")] + [(None, None)] * 5_000 + [(None, "without an id")] * 3 + [(3, f"copy {k} of three") for k in range(50)]
    got = imatch.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "g": F.lit(1), "times": F.lit(1)})).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 5_003 and sum(r.doc_id == 3 for r in got) == 50
    five = [r for r in got if r.doc_id == 5]
    assert sum(r.near_next == 1.0 for r in five) == 39 and len({r.fingerprint for r in five}) == 1 and len({r.edited_sha256 for r in five}) == 2
    text = rows[0][1]
    inner = text[: len(text) - len(text) // 3] + text[: len(text) // 3]
    assert sum(r.edited_sha256 == hashlib.sha256(inner.encode()).hexdigest() for r in five) == 39
    seven = next(r for r in got if r.doc_id == 7)
    first = rows[40][1]
    assert seven.edited_sha256 == hashlib.sha256((first[: len(first) - len(first) // 3] + text[: len(first) // 3]).encode()).hexdigest()


def test_texts_are_shuffled_once_for_edits(spark):
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(20)], "doc_id long, text string")
    asked = spark.createDataFrame([], "h long, g long, for_h long, for_g long, need int, times long, last boolean")
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plan = imatch.edited_texts(docs, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("ReusedExchange") == 1


def test_likeness_tells_edits_from_others(spark):
    from tests_llm_text import prose

    docs = spark.createDataFrame([(k, prose(k, 40 + 60 * k)) for k in range(30)] + [(100, prose(3, 220)), (101, prose(3, 220))], "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.edited_likeness(docs).collect()}
    assert got[101].near_next == 1.0 and got[100].fingerprint == got[101].fingerprint == got[3].fingerprint
    assert sum(got[k].near_edited > got[k].near_next for k in range(1, 30)) >= 27


@tables
@pytest.mark.parametrize("name", [*queries()])
def test_registered_queries_run(spark, name):
    df = queries()[name](spark, SF)
    assert df.count() > 0
    if name in oracles():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        cursor = con.execute(oracles()[name])
        assert sorted_rows(df.select(*[c[0] for c in cursor.description]).collect()) == sorted_rows(cursor.fetchall())


#: Columns named like those that operators add or use inside.
INSIDE = ["_gone", "_GONE_", "_leak", "_id", "_lang", "_y", "_s", "_r", "_t", "_before", "_in_range", "_range", "_source", "_place", "_ahead", "_within", "_batch", "_Batch_", "_own_score", "_own_n_bytes", "_own__batch", "score", "lang_pred", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
INSIDE += ["h", "g", "c", "k", "n", "fp", "row", "node", "set", "root", "second", "part", "place", "anchor", "bucket", "batch", "word", "component_id", "item_id", "_sha", "_first", "_copy", "_one", "_two", "_part", "_n", "_next", "least", "_other", "_side", "at", "cuts", "times", "last", "start", "rows"]


@pytest.fixture(scope="module")
def clashing(spark):
    from tests_llm_text import prose

    rows = [(k, prose(k % 30, 60), "en" if k % 2 else "de", f"s{k % 3}", 1) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in INSIDE})


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_columns_of_any_name(spark, clashing, tmp_path, stage):
    spark.createDataFrame([(1, clashing.filter("doc_id = 5").first().text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, clashing, str(tmp_path))
    bare = run(spark, clashing.drop(*INSIDE), str(tmp_path))
    own = [c for c in INSIDE if c in got.columns]
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in bare.select("doc_id").collect())
    assert got.filter(" or ".join(f"`{c}` <> 'own' or `{c}` is null" for c in own)).count() == 0
    assert stage == 4 or got.columns == clashing.columns
    assert stage < 4 or set(INSIDE) <= set(got.columns)


@pytest.mark.parametrize("operator", ["classes", "repeats", "leaks", "mix", "order", "toxicity", "quality", "language", "totals", "imatch"])
def test_operators_take_columns_of_any_name(spark, clashing, operator):
    from fleetlens.llm import decontaminate, langid, quality, toxicity

    items = spark.createDataFrame([(1, clashing.filter("doc_id = 5").first().text)], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").withColumns({c: F.lit("own") for c in INSIDE})
    run = {
        "classes": simhash.near_duplicate_classes, "repeats": suffix.remove_repeats, "leaks": lambda d: decontaminate.contaminated(d, items), "mix": mixing.mix_words,
        "order": lambda d: mixing.training_order(mixing.mix_words(d)), "toxicity": lambda d: toxicity.score_toxicity(d, labels, F.col("doc_id") % 3 != 1),
        "quality": lambda d: quality.score_quality(d, labels, F.col("doc_id") % 3 != 1), "language": lambda d: langid.identify(d, F.col("doc_id") % 3 != 1),
        "totals": lambda d: tokencounts.corpus_totals(spark, d), "imatch": imatch.edited_likeness,
    }[operator]
    bare = run(clashing.drop(*INSIDE))
    assert sorted_rows(run(clashing).select(*bare.columns).collect()) == sorted_rows(bare.collect())


def test_hot_ids_of_a_mix_are_spread(spark):
    from tests_llm_text import prose

    docs = spark.createDataFrame([(None, prose(k, 5), "s") for k in range(3000)] + [(7, prose(k, 6), "s") for k in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix_words(docs)
    assert got.groupBy(F.substring("queue_key", 1, mixing.RANGE_DIGITS)).count().agg(F.max("count")).first()[0] < 30
    first, again = (sorted_rows(d.select("text", "taken").collect()) for d in (got, mixing.mix_words(docs.repartition(5))))
    assert first == again


def test_pipeline_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, odd_docs.filter("doc_id = 5").first().text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, columns = docs, docs.columns
            path = str(tmp_path / f"{docs is no_docs}-{k}-{len(docs.columns)}-{docs.count()}")
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if k < 4:
                assert docs.columns == columns and docs.count() <= before.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids == set()


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    """After language ID, the stages are held against their plain forms on one small corpus."""
    from test_dedup import classes, plain_removal, plain_simhash
    from tests_llm_text import prose

    rows = [(k, prose(k, 90), "en", f"s{k % 2}", 1) for k in range(20)] + [(30, prose(4, 90), "en", "s0", 1), (31, prose(5, 90)[:300] + " " + prose(77, 60), "en", "s1", 1), (32, "%%% 123", "en", "s1", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, prose(9, 90)[:200])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    left = [(i, t) for i, t, *_ in rows if i != 32]
    kept = {i for i, _, c in classes([(i, plain_simhash(t)) for i, t in left]) if i == c}
    left = [(i, t) for i, t in left if i in kept and i != 9]
    removed = {r[0]: r[2] for r in plain_removal(left)}
    assert 30 not in kept and removed[31] > 200
    assert {r.doc_id for r in got} <= {i for i, _ in left} and {r.doc_id: r.n_chars for r in got}.get(31, 0) in (0, len(dict(left)[31]) - removed[31])
    assert {r.source for r in got} == {"s0", "s1"} and simhash and suffix
