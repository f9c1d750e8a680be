"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, connected classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import SPACE, free, shared_folder, stored
from fleetlens.llm.components import components

#: 64 bits in six blocks; with at most three differing bits at least three blocks agree.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
TABLES = tuple(combinations(range(6), 3))
#: Fingerprints compared in one go inside a block; larger blocks are split into square cells of this side.
CELL = 2048
#: Near duplicates by words: shingle width, least Jaccard likeness of the shingle sets, and how they meet. A pair of
#: likeness 0.8 shares one of 20 bands of six minima with 0.998; its SimHash differs in 9.7 bits on average, and a pair
#: further apart than 20 bits (3.6 standard deviations) is not compared.
WORDS, LIKENESS, BANDS, MINIMA, REACH = 5, 0.8, 20, 6, 20
#: Text bytes of a part of a group whose texts are compared word by word.
CELL_BYTES = 4 << 20
_MULTIPLIERS = np.random.default_rng(20240118).integers(0, 1 << 63, (2, BANDS * MINIMA), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BREAKS = bytes(32 if chr(c) in SPACE else c for c in range(256))


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words of the text, repeats included; A-Z in lower case."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).translate(_BREAKS)
    parts = [w for w in raw.split(b" ") if w]
    if not parts:
        return np.empty(0, np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(flat[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def simhash(text: str | None, width: int = 3) -> int:
    """A bit is set if it is set in over half of the shingle hashes; no words: zero."""
    return _simhash_of(shingle_hashes(text, width))


def _simhash_of(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * ones > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; whole texts, null like empty; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((simhash(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect what the links between (or within) two sets of fingerprints connect: a spanning forest.

    Breadth first over the not yet reached fingerprints, so at most ``len(a) + len(b)`` links come out.
    """
    same = b is a
    nodes = a if same else np.concatenate([a, b])
    side = np.zeros(len(nodes), bool)
    side[len(a) :] = True
    left, us, vs = np.ones(len(nodes), bool), [], []
    for first in range(len(nodes)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            at = queue.pop()
            rest = np.flatnonzero(left & (side != side[at])) if not same else np.flatnonzero(left)
            new = rest[np.bitwise_count(nodes[rest] ^ nodes[at]) <= distance]
            left[new] = False
            us += [int(nodes[at])] * len(new)
            vs += nodes[new].tolist()
            queue += new.tolist()
    return us, vs


def _runs(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by ``order``: what may go on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        ends = [[b.column(c)[at].as_py() for c in order] for b, at in ((held[0], 0), (batch, batch.num_rows - 1))]
        if ends[0] == ends[1]:  # one group so far
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, bool)
        for c in order:
            col = table.column(c).to_numpy()
            last &= col == col[-1]
        stop = int(np.argmax(last))
        yield table.slice(0, stop)
        held = table.slice(stop).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(rows: pa.Table, order: list[str]) -> Iterator[tuple[int, int]]:
    """First row and end of every group of two or more rows."""
    cut = np.flatnonzero(np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in order], axis=0)) + 1
    yield from ((s, e) for s, e in zip([0, *cut.tolist()], [*cut.tolist(), rows.num_rows]) if e - s > 1)


def _cells(rows: DataFrame, sizes: DataFrame, by: list[str], side: Column, node: Column) -> DataFrame:
    """``rows`` with the cells (i, j) of their groups: a group is cut into ``side`` parts, and every two parts meet."""
    own = F.pmod(F.xxhash64(node), F.col("_side")).cast("int")
    parts = rows.join(sizes.withColumn("_side", side), by).withColumn("_own", own)
    parts = parts.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_side") - 1)))
    return parts.select(*rows.columns, F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") > F.col("_other")).alias("second"))


def _links(us: list[int], vs: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], names=["u", "v"])


def block_links(prints: DataFrame, distance: int = 3, cell: int = CELL) -> DataFrame:
    """(u, v): links between *different* fingerprints (``fp``) that connect all pairs at most ``distance`` <= 3 bits apart.

    Every fingerprint goes to the 20 tables of three equal blocks out of six. Only blocks with two or more members are
    kept; a block of n members is cut into cells of at most ``cell`` x ``cell``, each verified exactly by one task that
    returns a spanning forest, so no block emits all its pairs and none is collected whole. Nothing is dropped.
    """
    if not 0 <= distance <= 3:
        raise ValueError("six blocks are exact for up to three differing bits")

    def block(k: int):
        at, wide = BLOCKS[k]
        return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << wide) - 1))

    keys = [
        F.struct(F.lit(t).alias("tab"), (block(x) * (1 << 22) + block(y) * (1 << 11) + block(z)).alias("key"))
        for t, (x, y, z) in enumerate(TABLES)
    ]
    rows = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("b")).select("fp", "b.tab", "b.key")
    return _bucket_links(rows, distance, cell)


def _bucket_links(rows: DataFrame, distance: int, cell: int = CELL) -> DataFrame:
    """(u, v): links that connect, inside each (tab, key) of ``rows``, the fingerprints ``fp`` at most ``distance`` bits apart."""
    sizes = rows.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1")
    cells = _cells(rows, sizes, ["tab", "key"], F.ceil(F.col("n") / cell).cast("int"), F.col("fp"))
    order = ["tab", "key", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, order):
            fp, second = rows.column("fp").to_numpy().view(np.uint64), rows.column("second").to_numpy(zero_copy_only=False)
            i, j = (rows.column(c).to_numpy() for c in "ij")
            us, vs = [], []
            for s, e in _groups(rows, order):
                own, two = fp[s:e], second[s:e]
                u, v = _forest(own, own, distance) if i[s] == j[s] else _forest(own[~two], own[two], distance)
                us += u
                vs += v
            yield _links(us, vs)

    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "u long, v long").distinct()


def near_duplicate_classes(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the class of every document under links of at most ``distance`` differing bits.

    ``component_id`` is the smallest doc_id of the class. Documents meet only as distinct fingerprints, so thousands of
    copies cost one node. Texts of no words share fingerprint zero and link like any other. Rows with a null doc_id keep
    a fingerprint and take the smallest id of their class (null if the class has none). Empty input: empty result.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    prints = stored(fingerprints(docs, width), f"{folder}/prints")
    roots = components(block_links(prints, distance))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    marked = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = marked.join(ids, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def _bands(own: np.ndarray) -> np.ndarray:
    """One hash per band of the minima of a set of shingle hashes under BANDS x MINIMA orders."""
    least = np.full(BANDS * MINIMA, ~np.uint64(0))
    for at in range(0, len(own), 1024):
        mixed = (own[None, at : at + 1024] ^ _MULTIPLIERS[0][:, None]) * _MULTIPLIERS[1][:, None]
        np.minimum(least, mixed.min(axis=1), out=least)
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, MINIMA).T:
        out = (out ^ row ^ (row >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _set_key(own: np.ndarray) -> int:
    """Name of a set of shingle hashes; no shingle: zero."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), 7) if len(own) else 0


def sketches(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, row, size, set, fp, bands) of every row: the row's own hash, bytes, shingle set, SimHash and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, prints, bands = [], [], []
            for text in batch.column(3):
                own = np.unique(shingle_hashes(text.as_py(), width))
                sets.append(_set_key(own))
                prints.append(_simhash_of(own))
                bands.append(_bands(own).view(np.int64) if len(own) else np.empty(0, np.int64))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sets, prints)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols, pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "row", "size", "set", "fp", "bands"])

    asked = docs.select(F.col("doc_id").cast("long"), _row(), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), "text")
    return asked.mapInArrow(run, "doc_id long, row long, size long, set long, fp long, bands array<long>")


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row")


def _likeness_forest(sets: list[np.ndarray], likeness: float) -> tuple[list[int], list[int]]:
    """Places in ``sets`` that a spanning forest of the pairs with a Jaccard likeness of ``likeness`` or more links."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), size)
    posts = owner[np.argsort(flat, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(flat))])
    at = np.concatenate([[0], np.cumsum(size)])
    left, us, vs = np.ones(len(sets), bool), [], []
    for k in range(len(sets)):
        if not left[k]:
            continue
        left[k] = False
        queue = [k]
        while queue and left.any():
            x = queue.pop()
            own = flat[at[x] : at[x + 1]]
            n = first[own + 1] - first[own]
            places = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(posts[places], minlength=len(sets))
            new = np.flatnonzero(left & (common >= likeness * (size + size[x] - common) - 1e-9))
            left[new] = False
            us += [x] * len(new)
            vs += new.tolist()
            queue += new.tolist()
    return us, vs


def likeness_links(docs: DataFrame, prints: DataFrame, width: int = WORDS, likeness: float = LIKENESS, distance: int = REACH, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(u, v): links between shingle sets of ``docs`` whose Jaccard likeness is at least ``likeness``, each one counted exactly.

    SimHashes that share a band and differ in at most ``distance`` bits are candidates. Whatever candidates connect is
    compared as a whole, word by word, so a candidate pair that is too different does not hide another that is not.
    A group is cut into parts of about ``cell_bytes``, of which every two meet in one task; no group is collected.
    """
    folder = shared_folder(docs.sparkSession)
    banded = prints.select("fp", F.posexplode("bands").alias("tab", "key")).distinct()
    roots = components(_bucket_links(banded, distance))
    # one row for each set, so that thousands of copies of a text count once
    own = prints.filter("size > 0").groupBy("set").agg(F.min(F.struct("row", "fp", "size")).alias("x")).select("set", "x.*")
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("row", "size", F.coalesce("root", "fp").alias("root"))
    groups = rooted.groupBy("root").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).filter("n > 1").drop("n")
    wanted = stored(rooted.join(groups.select("root"), "root", "left_semi"), f"{folder}/wanted")
    texts = docs.select(_row(), "text").join(wanted.select("row", "root"), "row").dropDuplicates(["row"])
    cells = _cells(texts, groups, ["root"], F.ceil(F.col("bytes") / cell_bytes).cast("int"), F.col("row")).drop("second", "row")
    order = ["root", "i", "j"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, order):
            us, vs, text = [], [], rows.column("text")
            for s, e in _groups(rows, order):
                sets = [np.unique(shingle_hashes(t.as_py(), width)) for t in text.slice(s, e - s)]
                keys = [_set_key(x) for x in sets]
                u, v = _likeness_forest(sets, likeness)
                us += [keys[k] for k in u]
                vs += [keys[k] for k in v]
            yield _links(us, vs)

    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(verify, "u long, v long").distinct()


def like_classes(docs: DataFrame, width: int = WORDS, likeness: float = LIKENESS) -> DataFrame:
    """(doc_id, set, component_id): the class of every document under links of shingle sets at least ``likeness`` alike.

    Ids, nulls, copies and empty tables as in ``near_duplicate_classes``; texts of no words are alike.
    """
    prints = stored(sketches(docs, width), f"{shared_folder(docs.sparkSession)}/sketches")
    roots = components(likeness_links(docs, prints, width, likeness))
    least = prints.groupBy("set").agg(F.min("doc_id").alias("least"))
    marked = least.join(roots, least.set == roots.node, "left").select("set", "least", F.coalesce("root", "set").alias("root"))
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.select("doc_id", "set").join(marked.join(ids, "root").select("set", "component_id"), "set").select("doc_id", "set", "component_id")


def keep_one_per_class(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The documents whose id is the smallest of their class (``near_duplicate_classes``), all their columns as they came.

    Rows without a doc_id cannot be told apart by id and stay; repeated rows of one kept id stay as they are.
    """
    classes = near_duplicate_classes(docs) if classes is None else classes
    (name,) = free(docs, "_gone")
    gone = classes.filter("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
