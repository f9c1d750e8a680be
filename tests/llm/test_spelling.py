import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from fleetlens.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def plain_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, n[w], form[w], root(w), len(near[w]), n.get(form[w])) for w in n), key=repr)


def texts(seed, n_docs, n_base):
    r = random.Random(seed)
    base = ["".join(r.choice("abé") for _ in range(r.randint(7, 10))) for _ in range(n_base)]
    base += ["common" + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(n_base)]
    out = []
    for k in range(n_docs):
        words = [base[min(int(r.expovariate(0.15)), len(base) - 1)] for _ in range(60)]
        for at in range(0, 60, 17):
            w = words[at]
            p = r.randrange(len(w))
            words[at] = r.choice([w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + "Y" + w[p + 1 :], w[:p] + w[p] + w[p:]])
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("group", [3, 20000])
def test_variants_are_those_of_all_pairs(spark, group, tmp_path):
    rows = texts(4, 400, 40) + [(None, None), (None, "aaaaaaab " * 40), (7, ""), (8, "baaaaaaÀ ×÷aaaaaaa baaaaaaÀ 12 x"), (8, "aaaaaaaa")] * 2 + [(501, "chainaaa " * 400), (502, "chainaab " * 30), (503, "chainabb " * 3)]
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "doc_id long, text string, word string, n long, g string")
    want = plain_variants(plain_words(rows))
    assert any(w[2] for w in want) and any(w[3] != w[2] for w in want if w[2])
    got = sorted((tuple(r) for r in spelling.variants(docs, group=group).collect()), key=repr)
    assert got == want
    assert spelling.variants(docs.limit(0)).count() == 0
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(spelling.VARIANTS_SQL).fetchall(), key=repr) == want


@pytest.mark.parametrize("seed", range(3))
def test_composition_accepts_the_pairs_one_edit_apart(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("ab") for _ in range(r.choice([7, 8]))) for _ in range(150)})
    got = Counter()
    for path, lo, hi in (("", 0, 0), ("<", 3, 0), (">", 0, 3)):
        parts = {}
        for w in words:
            parts.setdefault((w[:lo], w[len(w) - hi :]), []).append(w)
        pairs = Counter(frozenset((p[i], p[j])) for p in parts.values() for i, j in spelling.near_pairs(p, 7, lo, hi, path))
        if path:
            got += pairs
        else:
            assert set(pairs.values()) == {1}
            want = pairs
    assert got == want == Counter(frozenset((a, b)) for a in words for b in words if a < b and min(len(a), len(b)) == 7 and one_edit(a, b))


def test_acceptor_is_minimal_and_numbers_its_words():
    words = sorted(a + b for a in ("un", "re", "pre") for b in ("load", "read", "loads", "reads"))
    a = spelling.Acceptor(words)
    assert a.count[a.start] == 12 and len(a.arcs) < 16
    for k, w in enumerate(words):
        state, n = a.start, 0
        for c in w:
            state, n = next((t, n + at) for d, t, at in a.steps(state) if d == c)
        assert a.final[state] and n == k


def test_very_long_words(spark):
    long = "ab" * 20000
    rows = [(1, long), (2, long), (3, long[:9000] + "x" + long[9000:]), (3, long[:9000] + "x" + long[9000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {len(r.word): r.n_near for r in spelling.variants(docs, delete_mod=None).collect()}
    assert got == {40000: 1, 40001: 1}
