import hashlib

import numpy as np
import pytest
import xxhash
from tests_llm_text import prose

from fleetlens.llm import simhash, suffix
from fleetlens.llm.components import components


def plain_simhash(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows):
    """Smallest id reachable, over all pairs."""
    prints = {p for _, p in rows}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, p in rows:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, p, least.get(find(p))) for i, p in rows), key=repr)


def test_classes_are_those_of_all_pairs(odd_docs):
    rows = [(r.doc_id, plain_simhash(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicate_classes(odd_docs).collect()]
    assert sorted(got, key=repr) == classes(rows)
    kept = simhash.keep_one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {13, 16} & {r.doc_id for r in kept.collect()} == set()


@pytest.mark.parametrize("cell", [4, 2048])
def test_links_connect_what_all_pairs_connect(spark, cell):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    prints = [int(b) for b in base]
    for b in base:  # chains and dense clusters
        x = int(b)
        for _ in range(25):
            for bit in r.choice(64, r.integers(1, 5), replace=False).tolist():
                x ^= 1 << bit
            prints.append(x)
    rows = [(k, p) for k, p in enumerate(prints)]
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    links = simhash.block_links(df, cell=cell)
    assert links.filter("bit_count(u ^ v) > 3").count() == 0
    roots = {r.node % 2**64: r.root for r in components(links).collect()}
    group = {}
    for k, p in rows:
        group.setdefault(roots.get(p, ("alone", p)), []).append(k)
    want = {}
    for k, _, c in classes(rows):
        want.setdefault(c, []).append(k)
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, want.values()))


def plain_likeness(a, b):
    x, y = ({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def planted_copies():
    """Texts of 30 to 400 words, each with copies that have some words replaced: likeness 0.8 to 0.95, and lower."""
    r, rows = np.random.default_rng(5), []
    for k in range(40):
        words = prose(700 + k, 30 + 370 * k // 39).split()
        rows.append((100 * k, " ".join(words)))
        for c, at in enumerate((0.04, 0.01, 0.02, 0.1)):
            new = list(words)
            for x in r.choice(len(words), max(1, int(at * len(words))), replace=False).tolist():
                new[x] = f"new{k}x{c}x{x}"
            rows.append((100 * k + 1 + c, " ".join(new)))
    return rows


@pytest.mark.parametrize("cell_bytes", [600, 1 << 22])
def test_edited_copies_of_likeness_08_meet(spark, cell_bytes, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(simhash.likeness_links, "__defaults__", (*simhash.likeness_links.__defaults__[:3], cell_bytes))
    rows = planted_copies()
    pairs = [(i, j) for i, a in rows for j, b in rows if i < j < i + 100 and i // 100 == j // 100 and plain_likeness(a, b) >= 0.8]
    assert len(pairs) >= 40
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.like_classes(df).collect()} == {i: find(i) for i in root}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {i for i in root if find(i) == i}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (100, 100)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def plain_removal(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(first.get(s, 2**63), 2**63 - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (2**63 - 1 if i is None else i):
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batch_bytes", [200, 1 << 20])
def test_removal_is_that_of_all_windows(spark, odd_docs, batch_bytes):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert digest(suffix.remove_repeats(odd_docs.select("doc_id", "text", "_batch", "n_removed"), batch_bytes=batch_bytes)) == plain_removal(rows)


def test_edited_copies_shared_passages_and_short_periods(spark):
    passage = prose(500, 30)
    rows = [(k, prose(k, 20) + passage[k % 7 :] + prose(k + 900, 15)) for k in range(30)]
    rows += [(100 + k, rows[k][1][: 40 + 3 * k] + "#" + rows[k][1][40 + 3 * k :]) for k in range(20)]
    rows += [(200, "a" * 300), (201, "a" * 120 + "b" * 120), (202, "ab" * 100), (203, "ba" * 60), (204, "ß" * 60), (205, "xß" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(suffix.remove_repeats(df, batch_bytes=3000)) == plain_removal(rows)


@pytest.mark.parametrize("batch_bytes", [2500, 12000])
def test_a_passage_in_all_documents_is_no_group_of_all(spark, batch_bytes):
    import pyarrow as pa

    passage = prose(501, 40)[:300]
    rows = [(k, prose(k, 12) + passage + prose(k + 2000, 12)) for k in range(150)]
    rows += [(300 + k, rows[k][1][:100] + "#" + passage + rows[k][1][-90:]) for k in range(20)] + [(None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(suffix.remove_repeats(df, batch_bytes=batch_bytes)) == plain_removal(rows)
    batch = suffix._Batch(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}), 5, 50, 28)
    most = np.unique(np.stack([batch.bucket, batch.anchor.astype(np.int64)]), axis=1, return_counts=True)[1].max()
    sent = np.unique(np.stack([batch.bucket[batch.sent], batch.anchor[batch.sent].astype(np.int64)]), axis=1, return_counts=True)[1].max()
    assert most >= 100 and sent < suffix.HOT
    windows, _, cuts, *_ = batch.hot_windows(np.full(len(batch.head), 3, np.uint8))
    assert len(np.unique(windows)) == len(windows) and np.diff(cuts).max() < 0.3 * len(windows)


def test_empty_tables(no_docs):
    assert simhash.near_duplicate_classes(no_docs).count() == 0
    assert simhash.keep_one_per_class(no_docs).count() == 0
    assert suffix.remove_repeats(no_docs).count() == 0


def test_previous_factors():
    assert suffix.previous_factors(np.array([5, 5, 7, 5, 7]), np.array([3, 1, 4, 3, 4])).tolist() == [True, False, False, True, False]
