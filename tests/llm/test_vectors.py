import duckdb
import numpy as np
import pytest

from fleetlens.llm import vectors

SCHEMA = "vec_id long, embedding array<{}>, label int, cell string, key string, n string, vec int"


def clusters(seed, n, dim, tight):
    """Random directions, chains whose neighbours alone are near, and dense groups."""
    r = np.random.default_rng(seed)
    out = list(r.normal(size=(n, dim)))
    for _ in range(3):
        x = r.normal(size=dim)
        for _ in range(25):
            x = x / np.linalg.norm(x) + r.normal(size=dim) * 0.12 / np.sqrt(dim)
            out.append(x)
    x = r.normal(size=dim)
    out += [x / np.linalg.norm(x) + r.normal(size=dim) * 0.1 / np.sqrt(dim) for _ in range(tight)]
    return [v.astype(np.float32).astype(float).tolist() for v in out]


def plain(rows, cosine=0.98):
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault((label, len(v)), []).append(k)
    links = {k: set() for k in range(len(rows))}
    for places in ok.values():
        m = np.array([rows[k][1] for k in places], float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        for x, y in np.argwhere(m @ m.T >= cosine):
            if x != y:
                links[places[x]].add(places[y])
    out, root = [], {}
    for k in links:
        if k in root:
            continue
        seen, queue = {k}, [k]
        while queue:
            new = links[queue.pop()] - seen
            seen |= new
            queue += new
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        root |= dict.fromkeys(seen, min(ids) if ids else None)
    for k, (i, _, _) in enumerate(rows):
        out.append((i, len(links[k]), root[k], i is not None and i == root[k]))
    return sorted(out, key=repr)


def odd_rows():
    v = clusters(1, 30, 16, 20)
    rows = [(k, x, k % 2) for k, x in enumerate(v)]
    rows += [(200, v[0], 0), (201, v[0], 0), (201, v[0], 0), (None, v[0], 0), (None, None, None), (202, v[0], None), (203, None, 0), (204, [], 0), (205, [0.0] * 16, 0)]
    rows += [(206, [None] + v[1][1:], 0), (207, [float("nan")] + v[1][1:], 0), (208, [float("inf")] * 16, 0), (209, [2 * x for x in v[4]], 0), (210, [-x for x in v[4]], 0)]
    return rows + [(211, v[6][:8], 0), (212, v[6][:8], 0), (0, v[2], 0), (213, [1e-30] * 16, 1), (214, [3e-30] * 16, 1)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_odd_rows_are_those_of_all_pairs(spark, kind):
    rows = odd_rows()
    asked = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA.format(kind))
    got = sorted((tuple(r) for r in vectors.near_vectors(asked).collect()), key=repr)
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in asked.collect()])
    assert vectors.near_vectors(asked.limit(0)).count() == 0


@pytest.mark.parametrize(("cell", "pivots"), [(20, 3), (12, 16), (60, 4)])
def test_cells_lose_no_link(spark, monkeypatch, cell, pivots):
    """Cells partitioned again and again, guests in several parts, a dense group cut into squares."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "PIVOTS", pivots)
    rows = [(k, x, 1) for k, x in enumerate(clusters(5, 150, 8, 150))]
    asked = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA.format("double"))
    got = sorted((tuple(r) for r in vectors.near_vectors(asked).collect()), key=repr)
    assert got == plain(rows)


def test_reach_of_cells():
    r = np.random.default_rng(0)
    own = r.normal(size=(400, 3))
    own /= np.linalg.norm(own, axis=1)[:, None]
    home, near = vectors.near_cells(own, own[:9], 0.2)
    close = vectors._distances(own, own) <= 0.2
    assert all(near[x, home[y]] for x, y in np.argwhere(close))
    assert near.mean() < 0.5


def test_sql_is_all_pairs(spark, tmp_path):
    rows = [r for r in odd_rows() if r[0] is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted(con.execute(vectors.NEAR_SQL).fetchall(), key=repr) == plain(rows)
