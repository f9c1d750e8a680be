import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_text import prose

from fleetlens.llm import decontaminate, langid, pages, quality, toxicity
from fleetlens.llm.common import crc_fold

DE = ["der", "und", "schön", "heit", "keit", "über", "nicht", "eine", "größe", "zu"]
EN = ["the", "and", "with", "thing", "from", "would", "which", "this", "of", "to"]


def say(words, k, n=40):
    return " ".join(words[(k * 7 + j * j + j * k) % len(words)] for j in range(n)) + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for k in range(240):
        bad, toxic = k % 4 == 0, k % 3 == 0
        text = prose(k, 50)
        if toxic:
            text = text[:60] + " idiot you moron " + text[60:]
        if bad:
            text = " ".join(w + "%%%" for w in text.upper().split())
        rows.append((k, text, "en" if k % 2 else "de", "s", None))
        labels.append((k, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (5000, 1, 0), (7, 9, 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(df, labels, name, fold, n):
    rows = df.join(labels, "doc_id").filter((crc_fold(F.col("doc_id"), n) == fold) & F.col(name).isin(0, 1)).collect()
    return np.mean([r.predicted == r[name] for r in rows])


def test_toxicity(labelled, odd_docs, no_docs):
    docs, labels = labelled
    learn = crc_fold(F.col("doc_id"), 3) != 1
    assert held_out(toxicity.score_toxicity(docs, labels, learn), labels, "toxic", 1, 3) > 0.95
    scored = toxicity.score_toxicity(odd_docs, labels, learn).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert toxicity.score_toxicity(no_docs, labels, learn).count() == 0
    assert {r.score for r in toxicity.score_toxicity(odd_docs, labels.limit(0), learn).collect()} == {0.0}


def test_toxicity_paths():
    lexicon = toxicity.Lexicon({"=idiot": 2.0, "^stup": 1.0})

    def paths(text, quoted=False):
        return toxicity.clause_paths([toxicity.symbol_of(w, lexicon) for w in text.split()], quoted)

    assert paths("an idiot") == [(0, 2.0)]
    assert paths("you idiot") == [(1, 2.0)]
    assert paths("you are not an idiot") == [(2, 2.0)]
    assert paths("not one of the many stupids") == [(0, 1.0)]
    assert paths("he said idiot") == [(3, 2.0)] and paths("an idiot", True) == [(3, 2.0)]
    assert paths("kill you") == [(4, 1.0)] and paths("not kill you") == [(5, 1.0)] and paths("kill time") == []
    assert toxicity.features(None, lexicon, {}) == toxicity.features("", lexicon, {})


def test_quality(labelled, odd_docs, no_docs):
    docs, labels = labelled
    learn = crc_fold(F.col("doc_id"), 4) != 2
    assert held_out(quality.score_quality(docs, labels, learn), labels, "quality", 2, 4) > 0.95
    scored = quality.score_quality(odd_docs, labels, learn).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality.score_quality(no_docs, labels, learn).count() == 0
    assert {r.score for r in quality.score_quality(odd_docs, labels.limit(0), learn).collect()} == {0.5}


def test_language(spark, odd_docs, no_docs):
    rows = [(k, say(DE if k % 2 else EN, k), "de" if k % 2 else "en") for k in range(120)] + [(200, None, "en"), (201, "12 34 ?!", "de"), (202, "", None), (None, "the thing", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, crc_fold(F.col("doc_id"), 4) != 2).collect()}
    assert np.mean([got[k].lang_pred == ("de" if k % 2 else "en") for k in range(120)]) > 0.95
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (200, 201, 202)) and got[None].lang_pred == "en"
    assert langid.identify(odd_docs, F.lit(True)).count() == odd_docs.count()
    assert langid.identify(no_docs, F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_pair_tables_equal_the_convolution():
    x = np.random.default_rng(1).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    net = langid.train(x, np.array([0, 1, 0, 1, 0]), ["a", "b"], epochs=2)
    p = net._patches(x)
    hid = np.maximum((p @ net.filters).max(axis=1) + net.bias, 0)
    assert np.allclose(hid @ net.out + net.out_bias, net.scorer()(x), atol=1e-4)


PAGE = """<html><head><title>T</title><script>var x="</p>";</script></head><body><nav><a href=/>Home</a></nav>
<div class="cookie-notice">Accept, please.</div><div class="ad">Buy, now!</div><article><h1>Head &amp; line</h1><p>First, <b>bold<br>text &lt;here. <p>Ok.</p><ul><li>One<li>Two</ul>
<div class="comments"><p>Nice, really.</p></div><form><label>Mail</label></form></article><aside>More, text.</aside><footer>&copy; x</footer></body></html>"""


def test_extraction(spark):
    assert pages.content_blocks(PAGE) == ["Head & line", "First, bold text <here.", "Ok.", "One", "Two"]
    plain = "<body><div id=menu><a href=a>A</a> <a href=b>B</a></div><div><h2>Title</h2>" + "<p>A long, plain paragraph; it has words, and stops. It goes on.</p>" * 3 + "</div><ul><li><a href=x>Link</a></ul>"
    assert pages.content_blocks(plain) == ["Title", *["A long, plain paragraph; it has words, and stops. It goes on."] * 3]
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "just text"), (4, "u", "<p>" + "word, " * 50_000 + "<sc")]
    got = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[2].text == "" and by[3].n_chars == 0 and by[None].text == "just text" and by[4].n_chars == 6 * 50_000 - 1
    assert by[1].text == "Head & line\n\nFirst, bold text <here.\n\nOk.\n\nOne\n\nTwo"
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_align(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(5)
    for _ in range(30):
        a, b = r.integers(1, 6, r.integers(1, 25)), r.integers(0, 6, r.integers(0, 40))
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64)) == plain_align(a.tolist(), b.tolist())


@pytest.mark.parametrize("block_words", [10, 10**6])
def test_decontamination(spark, odd_docs, no_docs, block_words):
    items = [(k, prose(1000 + k, 30)) for k in range(8)] + [(8, None), (9, ""), (None, "x y z"), (10, prose(1000, 30)), (11, "tiny item"), (1, prose(1020, 25)), (3, prose(1003, 30)), (12, "Solitary")]
    edited = prose(1002, 30).split()
    edited[4], edited[15] = "changed", "words"
    del edited[22]
    rows = [(k, prose(k, 80)) for k in range(40)]
    rows += [(100, prose(50, 40) + " " + prose(1001, 30) + " " + prose(51, 40)), (101, " ".join(edited).upper()), (102, prose(1003, 30)), (102, prose(1003, 30)), (103, None), (None, prose(1004, 30)), (104, prose(1000, 30))]
    rows += [(105, " ".join(prose(1005, 30).split()[:8]) + " " + prose(60, 60)), (106, prose(1020, 25)), (107, "a\u00a0solitary, word"), (108, prose(61, 500) + " " + prose(1006, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, round(r.score, 6)) for r in decontaminate.contaminated(docs, bench, block_words=block_words).collect()), key=repr)
    want, leaks = set(), set()
    for i, t in rows:
        for j, x in items:
            a, b = decontaminate.item_words(x), decontaminate.item_words(t)
            if j is not None and a and plain_align(a, b) / (2 * len(a)) >= 0.6:
                want.add((i, j, round(plain_align(a, b) / (2 * len(a)), 6)))
                leaks.add((i, t))
    assert got == sorted(want, key=repr)
    left = decontaminate.decontaminate(docs, bench, block_words=block_words)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left.collect()))) == sorted(repr(r) for r in rows if r not in leaks) and left.columns == docs.columns
    assert decontaminate.contaminated(no_docs, bench, block_words=block_words).count() == 0
    assert decontaminate.decontaminate(no_docs, bench, block_words=block_words).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.limit(0), block_words=block_words).count() == odd_docs.count()


def edits(words, kind, every):
    out = []
    for k, w in enumerate(words):
        hit = k % every == every - 1
        out += [f"new{k}"] if hit and kind == "replace" else [] if hit and kind == "delete" else [w, f"new{k}"] if hit else [w]
    return " ".join(out)


def test_recall_of_edited_copies(spark):
    """Copies with every fourth word replaced or deleted, or a word put in after every two or three, between other words."""
    items = [(k, prose(3000 + k, 12 + k)) for k in range(40)]
    kinds = [("replace", 4), ("delete", 4), ("insert", 3), ("insert", 2)]
    rows = [(k, prose(k, 80)) for k in range(60)]
    rows += [(1000 * (e + 1) + k, prose(9000 + k, 60) + " " + edits(t.split(), *kind) + " " + prose(8000 + k, 60)) for e, kind in enumerate(kinds) for k, t in items]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    words = {j: decontaminate.item_words(x) for j, x in items}
    for e, kind in enumerate(kinds):
        reach = [(1000 * (e + 1) + j, j) for j in words if plain_align(words[j], decontaminate.item_words(edits(dict(items)[j].split(), *kind))) / (2 * len(words[j])) >= 0.6]
        assert len(reach) >= 30 and sum(p in got for p in reach) >= 0.95 * len(reach), kind
    assert all(d >= 1000 and d % 1000 == j for d, j in got)


def test_rare_grams():
    logs = np.log(np.array([0.1, 0.1, 1e-4, 0.1, 0.1, 0.1]))
    assert decontaminate.rare_grams(logs, 1.0, 2e-4, 4) == [(1, 2), (2, 2)]
    assert decontaminate.rare_grams(np.log(np.full(6, 0.1)), 1.0, 2e-4, 4) == [(0, 4), (1, 4), (2, 4)]
    assert decontaminate.rare_grams(logs[:1], 1.0, 1e-4, 4) == [(0, 1)] and decontaminate.rare_grams(logs[:0], 1.0, 1e-4, 4) == []
    assert decontaminate.rare_grams(np.log(np.array([0.5, 0.5, 0.4])), 100.0, 1e-9, 4) == [(0, 3)]


def test_word_helpers():
    assert decontaminate.item_words(" It's, (a) Test! ") == ["it's", "a", "test"] and not re.search("[A-Z]", "".join(decontaminate.item_words("ABC")))
    assert math.isclose(decontaminate._score(np.array([1, 2, 3], np.uint64), np.array([9, 1, 2, 3], np.uint64), [1]), 1.0)


@pytest.mark.parametrize("page", [
    "<article>" + "<b>" * 40_000 + "<p>One line, of text.</p>" * 20_000, "<div>" * 100_000 + "<p>One line, of text.", "<nav>" * 60_000 + "<p>One line, of text.</p>" + "</nav>" * 60_000 + "<p>Out.</p>",
    "<div><p>One line, of text.</p>" * 30_000, "<svg>" * 100_000 + "<p>One line, of text.</p>", "<ul>" + "<li><i>One line, of text." * 30_000, "<b><p>" * 50_000 + "One line, of text." + "</b>" * 50_000,
])
def test_deep_pages_take_time_by_their_length(page):
    import time

    start = time.process_time()
    got = pages.content_blocks(page)
    assert time.process_time() - start < 10 and set(got) <= {"One line, of text.", "Out."} and got


def test_stray_quotes_end_no_page():
    rest = "<p>two, it goes on.</p><p>three, and stops.</p>"
    want = ["one, a first line.", "two, it goes on.", "three, and stops."]
    for stray in ('<img alt=5" src=x>', "<a title=Bob's href=x></a>", '<b class="x"">  </b>', "<img alt='5>", "<img alt= \"5>"):
        assert [b.text for b in pages.blocks_of(f"<p>one, a first line.</p>{stray}{rest}")] == want
    assert [b.text for b in pages.blocks_of('<p>one, a first line.</p><img alt=5" src=x>' + rest + '<p>say "so"</p>')] == [*want, 'say "so"']
    assert [b.text for b in pages.blocks_of('<p>one<a href="x>y" title="a > b">two</a></p><p ' + 'a="b" ' * 60)] == ["onetwo"]


@pytest.mark.parametrize("open_, close", [("<div class='content has-sidebar'>", "</div>"), ("<div class=no-header><div id=with-sidebar>", "</div></div>"), ("<form id=aspnetForm>", "</form>"), ("<div id='search-results-article' class='share-enabled'>", "</div>")])
def test_wrappers_that_look_like_furniture(open_, close):
    text = "A long, plain paragraph; it has words, and stops. It goes on."
    side = "<nav><a href=/>Home</a></nav>", "<div class=sidebar><p>More, of this.</p></div><footer>" + "All rights, reserved. " * 2 + "</footer>"
    for body, want in ((f"<article><h1>Head</h1><p>{text}</p></article>", ["Head", text]), (f"<main><p>{text}</p></main>", [text]), (f"<p>{text}</p>" * 3, [text] * 3)):
        assert pages.content_blocks(f"<html><body>{side[0]}{open_}{body}{side[1]}{close}</body></html>") == want
        assert pages.content_blocks(f"<html><body>{side[0]}{open_}{body}{close}{side[1]}</body></html>") == want
    plain = f"<div><p>{text}</p><p>{text}</p><p>{text}</p></div><div class=comments><article><p>Nice, really.</p></article></div>"
    assert pages.content_blocks(plain) == [text] * 3


def test_language_sample_of_repeated_rows(spark):
    rows = [(1, prose(900 + k), "en") for k in range(50)] + [(2 + k, prose(k, 200), "en") for k in range(6)] + [(100 + k, prose(k), "de") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(docs, F.lit(True), per_class=7)
    assert sum(lang == "en" for lang, _ in got) <= 7 * langid.WINDOWS_PER_DOC and sum(lang == "en" for lang, _ in got) > 6 * 2 and sum(lang == "de" for lang, _ in got) >= 3
    assert len([p for lang, p in got if lang == "en" and any(p in t.encode() for i, t, _ in rows if i == 1)]) <= langid.WINDOWS_PER_DOC
