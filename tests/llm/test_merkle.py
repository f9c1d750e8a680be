import hashlib
import zlib

import pytest
from test_tables import sorted_rows, sql_rows

from fleetlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    """The levels of a 16-ary tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def proof(levels, at):
    """(left, right) of every level."""
    out = []
    for level in levels[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def plain_manifest(rows):
    def tampered(r):
        hit = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text) if hit and r.text is not None else r.text

    full = [(r.source, r.doc_id, leaf(r, r.text), leaf(r, tampered(r))) for r in rows]
    full.sort(key=lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2], x[3]))
    sources = list(dict.fromkeys(x[0] for x in full))
    trees = [tree([x[2] for x in full if x[0] == s]) for s in sources]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for at, (_, doc_id, own, offered) in enumerate(x for x in full if x[0] == s):
            path = proof(trees[k], at) + proof(top, k)
            node = offered
            for left, right in path:
                node = h(left, node, right)
            out.append((doc_id, own, trees[k][-1][0], top[-1][0], h(*(x for p in path for x in p)), node, node == top[-1][0]))
    return out


def test_manifest_is_the_plain_one_and_the_sql(odd_docs, no_docs, tmp_path):
    got = [tuple(r) for r in merkle.tampered_manifest(odd_docs).collect()]
    assert sorted_rows(got) == sorted_rows(plain_manifest(odd_docs.collect()))
    columns, want = sql_rows(merkle.MANIFEST_SQL, odd_docs, tmp_path)
    assert columns == merkle.tampered_manifest(odd_docs).columns and sorted_rows(got) == sorted_rows(want)
    assert merkle.tampered_manifest(no_docs).count() == 0


@pytest.mark.parametrize("sources", [1, 20, 300])
def test_shapes_of_trees(spark, monkeypatch, sources):
    """One source; lone leaves; a source of four levels under a tree of three; ancestors dealt to copies; many ranges."""
    monkeypatch.setattr(merkle, "MEET", 4)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 500)
    n = 4200 if sources < 300 else 900
    rows = [(k, f"Text {k}", "en", f"s{k % sources}" if k < 2 * sources else "s0", k) for k in range(n)]
    rows += [(7, "Text 7", "en", "s0", 7)] * 40 + [(None, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in merkle.tampered_manifest(docs).collect()]
    assert sorted_rows(got) == sorted_rows(plain_manifest(docs.collect()))
    one = docs.limit(1)
    assert [tuple(r) for r in merkle.tampered_manifest(one).collect()] == plain_manifest(one.collect())


def test_a_changed_row_fails_alone(spark):
    rows = [(k, f"Text {k}", "en", "a" if k % 3 else None, k) for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    out = merkle.manifest(docs, F.when(F.col("doc_id") == 17, F.lit("other")).otherwise(F.col("text"))).collect()
    assert [r.doc_id for r in out if not r.verified] == [17]
    assert all(r.verified for r in merkle.manifest(docs).collect())
