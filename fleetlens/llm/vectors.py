"""Embedding near-duplicates: an exact metric range join over cells of pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import shared_folder, stored
from fleetlens.llm.components import components

COSINE = 0.98
#: Distinct vectors that a cell has at home before it is partitioned by pivots.
CELL = 2048
#: Most pivots of one partitioning; what is still too large is partitioned again.
PIVOTS = 16
#: Copies of a cell's pivots, so that the rows of a hot label meet them in several tasks.
SALTS = 32
#: Added to every bound of a distance, far above the rounding of a double.
SLACK = 1e-9


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, cell, key, vec) of every row: the bytes of the vector, their hash with the label, and the label's first cell.

    Rows of no label and vectors that are null, empty, zero or hold null or non-finite components have a null ``key``.
    Vectors of unlike length have no cosine, so the length is part of the cell. Vectors of floats keep four bytes each.
    """
    floats = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if floats else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            cells, keys, vecs = [], [], []
            for label, vec in zip(batch.column(1).to_pylist(), batch.column(2)):
                cell = key = raw = None
                if label is not None and vec.is_valid and len(vec) and not vec.values.null_count:
                    own = vec.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(own).all() and own.any():
                        cell, raw = f"{len(own)}:{len(label)}:{label}", own.tobytes()
                        key = blake2b(cell.encode() + b"\0" + raw, digest_size=16).hexdigest()
                cells.append(cell)
                keys.append(key)
                vecs.append(raw)
            arrays = [pa.array(x, t) for x, t in ((cells, pa.string()), (keys, pa.string()), (vecs, pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["vec_id", "cell", "key", "vec"])

    asked = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<float>" if floats else "array<double>"))
    return asked.mapInArrow(run, "vec_id long, cell string, key string, vec binary")


def _matrix(column: pa.Array, cell: str) -> np.ndarray:
    """The vectors of a cell as rows of doubles of length one."""
    n, raw = int(cell.split(":", 1)[0]), column.to_pylist()
    own = np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * n else np.float64).reshape(len(raw), n).astype(np.float64)
    own /= np.abs(own).max(axis=1, keepdims=True)
    return own / np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def near_cells(own: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every vector, and a mask of the cells that may hold a vector within ``radius`` of it.

    ``y`` in the cell of ``q`` is no further from ``q`` than from any pivot ``p``, so by the triangle inequality a vector
    ``x`` within the radius has d(x, q) <= d(x, p) + 2 radius, and its distance to the plane between p and q,
    (d(x, q)^2 - d(x, p)^2) / 2 d(p, q), is at most the radius.
    """
    far = _distances(own, pivots)
    between = _distances(pivots, pivots)
    near = np.ones(far.shape, bool)
    for p in range(len(pivots)):
        near &= far <= far[:, [p]] + 2 * radius + SLACK
        near &= far**2 - far[:, [p]] ** 2 <= 2 * radius * between[p] + SLACK
    return far.argmin(axis=1), near


def _split(rows: DataFrame, large: DataFrame, radius: float, folder: str) -> DataFrame:
    """Rows of the large cells in the cells of their pivots: at home in the nearest, and in every other that is within reach.

    Two vectors at home in different cells meet in the cell of the lower number, so a vector at home goes to lower cells
    only; a vector that came into the large cell from outside goes to every cell within reach.
    """
    order = Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key")
    sized = rows.filter("home").join(large, "cell").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PIVOTS)
    few = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL) + 1)
    pivots = sized.filter(F.col("rank") <= few).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).getField("vec").alias("pivots"))
    dealt = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(dealt, ["cell", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                own = table.filter(pa.array(cells == cell)).combine_chunks()
                home, near = near_cells(_matrix(own.column("vec"), cell), _matrix(own.column("pivots")[0].values, cell), radius)
                inside = own.column("home").to_numpy()[:, None]
                place = np.arange(near.shape[1])[None, :]
                at, to = np.nonzero(np.where(inside, (place == home[:, None]) | (near & (place < home[:, None])), near))
                out = own.select(["key", "m", "vec"]).take(pa.array(at)).combine_chunks()
                names = [f"{cell}/{k}" for k in to.tolist()]
                stays = inside[at, 0] & (to == home[at])
                columns = [pa.array(names, pa.string()), pa.array(stays), *(c.combine_chunks() for c in out.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "home", "key", "m", "vec"])

    return stored(met.mapInArrow(run, "cell string, home boolean, key string, m long, vec binary"), folder)


def cells_of(distinct: DataFrame, radius: float, folder: str) -> DataFrame:
    """(cell, home, key, m, vec): every pair within the radius is in one cell, and one of the two is at home there.

    Cells with more than ``CELL`` vectors at home are partitioned again and again. A cell that keeps more than half of its
    parent (a dense group, where pivots part nothing) stays as it is; ``cell_links`` cuts it into squares.
    """
    now, done, turn = distinct.select("cell", F.lit(True).alias("home"), "key", "m", "vec"), None, 0
    sizes = now.groupBy("cell").agg(F.count("*").alias("n"))
    large = stored(sizes.filter(F.col("n") > CELL), f"{folder}/large-0")
    while not large.isEmpty():
        rest = now.join(large, "cell", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        now = _split(now.join(large, "cell", "left_semi"), large, radius, f"{folder}/cells-{turn}")
        parent = F.regexp_replace("cell", "/[^/]*$", "")
        sizes = now.filter("home").groupBy("cell").agg(F.count("*").alias("n")).withColumn("parent", parent)
        before = large.select(F.col("cell").alias("parent"), F.col("n").alias("of"))
        turn += 1
        large = stored(sizes.filter(F.col("n") > CELL).join(before, "parent").filter(F.col("n") * 2 <= F.col("of")).select("cell", "n"), f"{folder}/large-{turn}")
    return now if done is None else done.unionByName(now)


def _forest(own: np.ndarray, linked: np.ndarray, cosine: float) -> tuple[list[int], list[int]]:
    """Places of a spanning forest of the links among the rows ``linked`` of ``own``: at most one link per row."""
    left, us, vs = linked.copy(), [], []
    for first in np.flatnonzero(linked).tolist():
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            new = rest[own[rest] @ own[at] >= cosine]
            left[new] = False
            us += [at] * len(new)
            vs += new.tolist()
            queue += new.tolist()
    return us, vs


def _count(a: np.ndarray, b: np.ndarray, weight: np.ndarray, cosine: float) -> np.ndarray:
    """For every row of ``a`` the weight of the rows of ``b`` linked with it."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), 512):
        out[at : at + 512] = (a[at : at + 512] @ b.T >= cosine) @ weight
    return out


def cell_links(cells: DataFrame, cosine: float, folder: str) -> DataFrame:
    """(u, v, n): rows with null v say that ``u`` links with n vectors of a cell; the others are links that connect what all do.

    A cell is one task, or one for every two of its parts of at most ``CELL`` vectors, so none grows with the data; parts of
    vectors from outside are four times as large. No pair is emitted but those of a spanning forest.
    """
    sizes = cells.groupBy("cell").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_guest"))
    parts = sizes.select("cell", F.ceil(F.col("n_home") / CELL).cast("int").alias("homes"), F.ceil(F.col("n_guest") / (4 * CELL)).cast("int").alias("guests"))
    cut = stored(parts.filter("homes > 1 or guests > 1"), f"{folder}/cut")
    # role 0: home part a; 1: home part b, met by a < b; 2: guests
    own = F.col("own")
    homes_up = F.transform(F.filter(F.sequence(F.lit(0), F.col("homes") - 1), lambda b: b > own), lambda b: F.struct(own.alias("a"), b.alias("b"), F.lit(0).alias("role")))
    homes_down = F.transform(F.filter(F.sequence(F.lit(0), F.col("homes") - 1), lambda a: a < own), lambda a: F.struct(a.alias("a"), own.alias("b"), F.lit(1).alias("role")))
    with_guests = F.transform(F.filter(F.sequence(F.lit(0), F.col("guests")), lambda g: (g > 0) & (g < F.col("guests"))), lambda g: F.struct(own.alias("a"), (-g).alias("b"), F.lit(0).alias("role")))
    home = F.concat(F.array(F.struct(own.alias("a"), own.alias("b"), F.lit(0).alias("role"))), homes_up, homes_down, with_guests)
    guest = F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("homes"), F.lit(1)) - 1), lambda a: F.struct(a.alias("a"), F.when(own == 0, a).otherwise(-own).alias("b"), F.lit(2).alias("role"))
    )
    whole = cells.join(cut, "cell", "left_anti").select("cell", F.lit(0).alias("a"), F.lit(0).alias("b"), F.when(F.col("home"), 0).otherwise(2).alias("role"), "key", "m", "vec")
    count = F.greatest(F.lit(1), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    dealt = cells.join(cut, "cell").withColumn("own", F.pmod(F.xxhash64("key"), count).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("home"), home).otherwise(guest))).select("cell", "to.a", "to.b", "to.role", "key", "m", "vec")
    order = ["cell", "a", "b"]

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        role, keys, weight = rows.column("role").to_numpy(), rows.column("key").to_numpy(), rows.column("m").to_numpy()
        a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        own = _matrix(rows.column("vec"), rows.column("cell")[0].as_py())
        n = np.zeros(len(own), np.int64)
        first, second = np.flatnonzero(role == 0), np.flatnonzero(role != 0)
        if a == b:  # a row is linked with itself, which does not count
            n[first] += _count(own[first], own[first], weight[first], cosine) - weight[first]
        if len(second):
            n[first] += _count(own[first], own[second], weight[second], cosine)
            n[second] += _count(own[second], own[first], weight[first], cosine)
        us, vs = _forest(own, n > 0, cosine)
        some = np.flatnonzero(n)
        out = [(keys[some], np.full(len(some), None), n[some]), (keys[us], keys[vs], np.zeros(len(us), np.int64))]
        for u, v, count in out:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.string()), pa.array(v, pa.string()), pa.array(count)], names=["u", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = list(zip(*(batch.column(c).to_pylist() for c in order)))
            cut = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
            for s, e in zip([0, *cut], [*cut, len(names)]):
                if held and names[s] != name:
                    yield from links(pa.Table.from_batches(held))
                    held = []
                name = names[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from links(pa.Table.from_batches(held))

    return whole.unionByName(dealt).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "u string, v string, n long")


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: its links with a cosine of ``cosine`` or more inside its label.

    Exact: see ``near_cells``; cosines are taken in double precision. Equal vectors of a label are compared once and link
    with each other, also where their ids repeat: every row is a vector of its own. Rows that link with nothing (no label;
    a vector that is null, empty, zero or has null or non-finite components) are their own component. A null id never
    names a component unless all of it are null; ``kept`` is then false. Other columns are not read. Empty: empty.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the range join needs a cosine above 0")
    folder = shared_folder(rows.sparkSession)
    radius = float(np.sqrt(2.0 - 2.0 * cosine))
    named = stored(vectors(rows), f"{folder}/vectors")
    distinct = named.filter("key is not null").groupBy("cell", "key").agg(F.first("vec").alias("vec"), F.count("*").alias("m"), F.min("vec_id").alias("least"))
    distinct = stored(distinct, f"{folder}/distinct")
    found = stored(cell_links(cells_of(distinct, radius, folder), cosine, folder), f"{folder}/links")
    counts = found.filter("v is null").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v is not null").select("u", "v")).withColumnsRenamed({"node": "key"})
    marked = distinct.select("key", "m", "least").join(counts, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    marked = stored(marked, f"{folder}/marked")
    ids = marked.groupBy("root").agg(F.min("least").alias("component"))
    known = marked.join(ids, "root").select("key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), "component")
    out = named.select("vec_id", "key").join(known, "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


#: DuckDB SQL for ``near_vectors`` of ``embeddings``: all pairs of a label.
NEAR_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (
    SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                          AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
    SELECT a.r AS x, b.r AS y FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT r, r FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
least AS (SELECT reach.x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.y GROUP BY reach.x)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.x = v.r) AS n_links, least.component_id,
       coalesce(v.vec_id = least.component_id, false) AS kept
FROM v JOIN least ON least.x = v.r
"""
