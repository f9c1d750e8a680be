"""Merkle manifest of a corpus: 16-ary hash trees per source under one root, proofs by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fleetlens.llm.common import crc32_sql, crc_fold, shared_folder, stored

FAN = 16
#: Rows of one range of the ranking.
RANGE_ROWS = 100_000
#: A round joins at most FAN**(2**round) nodes to one ancestor; more than this many are dealt to copies of the ancestor.
MEET = 1024
_CAPITALS = "".join(map(chr, range(65, 91)))

# A node is (tree, level, idx). Trees are numbered by their source; TOP is the tree over the subroots.
TOP = -1
NODE = "struct<tree:bigint,level:int,idx:bigint>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The digest of a document's five fields; another text may stand in for its own."""
    own = F.col("text") if text is None else text
    return digest(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), own)))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _CAPITALS.lower()))


def _ranged(rows: DataFrame, group: Sequence[str], order: Sequence[str], folder: str) -> DataFrame:
    """``rows`` range-sorted by group and order (nulls first), with their range ``_part`` and their place ``_inside`` it and the group.

    A group with a third of all rows lies in many ranges. A row number of the stored input parts equal rows, so they spread
    as well, and a range that is computed again has the same rows.
    """
    rows = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), f"{folder}/plain")
    ranges = max(rows.count() // RANGE_ROWS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "_tie")]
    places = [rows.columns.index(c) for c in group]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last, n, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for own in zip(*(batch.column(k).to_pylist() for k in places)) if places else [()] * batch.num_rows:
                n, last = (n + 1 if own == last else 0), own
                out.append(n)
            columns = [*batch.columns, pa.array([part] * len(out), pa.int64()), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_inside"])

    schema = StructType([*rows.schema.fields, StructField("_part", LongType()), StructField("_inside", LongType())])
    return stored(rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).mapInArrow(number, schema), f"{folder}/ranged")


def _offsets(ranged: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, _part, _before, n): the group's rows in earlier ranges and in all. One row per group and range."""
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_rows"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_rows").over(whole.orderBy("_part")) - F.col("_rows")
    return counts.select(*group, "_part", before.alias("_before"), F.sum("_rows").over(whole).alias("n"))


def numbered_leaves(rows: DataFrame, folder: str) -> DataFrame:
    """(tree, n, idx, doc_id, digest, offered): leaves with the number of their source, its size and their place in it.

    Rows take their place from the rows of their own source and range, so no join meets on a hot source alone.
    """
    ranged = _ranged(rows, ["source"], ["doc_id", "digest", "offered"], f"{folder}/order")
    offsets = stored(_offsets(ranged, ["source"]), f"{folder}/offsets")
    names = _ranged(offsets.select("source").distinct(), [], ["source"], f"{folder}/names")
    name_offsets = _offsets(names, []).select("_part", "_before")
    trees = names.join(name_offsets, "_part").select(F.col("source").alias("_name"), (F.col("_before") + F.col("_inside")).alias("tree"))
    placed = offsets.join(trees, F.col("source").eqNullSafe(F.col("_name"))).select(F.col("source").alias("_s"), F.col("_part").alias("_p"), "_before", "n", "tree")
    met = ranged.join(placed, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    return met.select("tree", "n", (F.col("_before") + F.col("_inside")).alias("idx"), "doc_id", "digest", "offered")


def grow(leaves: DataFrame, folder: str) -> DataFrame:
    """All runs above ``leaves`` (tree, n, idx, digest): (tree, n, level, idx, kids, digest); trees of one leaf have none."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    runs = leaves.sparkSession.createDataFrame([], "tree long, n long, level int, idx long, kids array<string>, digest string")
    nodes, below, level = leaves.select("tree", "n", "idx", "digest"), 1, 0
    while below < most:
        level += 1
        # a tree grows on while it has more than one node on the level below
        grown = nodes.filter(F.col("n") > below).groupBy("tree", "n", F.floor(F.col("idx") / FAN).alias("idx"))
        grown = grown.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).getField("digest").alias("kids"))
        whole = F.sha2(F.concat_ws("", "kids").cast("binary"), 256)
        nodes = stored(grown.select("tree", "n", F.lit(level).alias("level"), "idx", "kids", whole.alias("digest")), f"{folder}/level-{level}")
        runs, below = runs.unionByName(nodes), below * FAN
    return runs


def _siblings(kids: Column, at: Column) -> Column:
    """What stands left and right of a node in its run."""
    return F.struct(
        F.concat_ws("", F.slice(kids, F.lit(1), at)).alias("left"),
        F.concat_ws("", F.slice(kids, at + 2, F.greatest(F.lit(0), F.size(kids) - at - 1))).alias("right"),
    )


def _node(tree: Column, level: Column, idx: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))


def _no_path() -> Column:
    return F.lit([]).cast("array<struct<left:string,right:string>>")


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree, counted in whole numbers."""
    return sum((n > F.lit(FAN**k)).cast("int") for k in range(15))


def paths_to_root(runs: DataFrame, many: bool, folder: str) -> DataFrame:
    """(node, kids, path, subroot, root) of every run: the siblings of each level from the run up to the root.

    ``many`` says that a tree of subroots stands above the trees. A run first holds the segment to its parent; each round
    joins the table with itself on the ancestor reached, appends the ancestor's segment and doubles the distance. An
    ancestor meets at most FAN ** distance runs, so in later rounds its copies share them out.
    """
    to_top = _node(F.lit(TOP), F.lit(1), F.floor(F.col("tree") / FAN)) if many else F.lit(None).cast(NODE)
    last, top = F.col("level") == _height(F.col("n")), F.col("tree") == TOP
    up = F.when(last & top, F.lit(None)).when(last, to_top).otherwise(_node(F.col("tree"), F.col("level") + 1, F.floor(F.col("idx") / FAN)))
    held = runs.select(
        _node(F.col("tree"), F.col("level"), F.col("idx")).alias("node"),
        "kids",
        "digest",
        up.alias("up"),
        (F.when(last & ~top, F.col("tree")).otherwise(F.col("idx")) % FAN).cast("int").alias("place"),
        F.when(last & ~top, F.col("digest")).alias("subroot"),
    )
    parents = held.select(F.col("node").alias("up"), F.col("kids").alias("_kids"))
    first = F.when(F.col("up").isNotNull(), F.array(_siblings(F.col("_kids"), F.col("place")))).otherwise(_no_path())
    root = F.when(F.col("up").isNull(), F.col("digest"))
    now = stored(held.join(parents, "up", "left").select("node", "kids", "up", "subroot", first.alias("path"), root.alias("root")), f"{folder}/jump-0")
    turn = 0
    while not now.filter("up is not null").isEmpty():
        copies = max(1, FAN ** (2**turn) // MEET)
        going = now.filter("up is not null").withColumn("_deal", F.pmod(F.xxhash64("node"), F.lit(copies)))
        # below this distance no ancestor can be reached any more
        ahead = now.filter((F.col("node.tree") == TOP) | (F.col("node.level") > 2**turn))
        ahead = ahead.select(F.col("node").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "path", "subroot", "root")])
        ahead = ahead.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))
        jumped = going.join(ahead, ["up", "_deal"]).select(
            "node", "kids", F.col("_up").alias("up"), F.coalesce("subroot", "_subroot").alias("subroot"), F.concat("path", "_path").alias("path"), F.col("_root").alias("root")
        )
        turn += 1
        now = stored(jumped.unionByName(now.filter("up is null")), f"{folder}/jump-{turn}")
    return now


def manifest(docs: DataFrame, offered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Leaves of a source ascend by doc_id (null first, equal ids by their digest; equal rows are interchangeable), sources by
    their bytes (null is a source, the first). ``offered`` is a text that stands in for the manifest's own when a proof is
    folded again; without it every row verifies. Nulls are fields of their own: an empty text is not a null one. An empty
    table has no leaf and gives no row. Other columns than the five of the manifest are not read, so none can clash.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select("doc_id", "source", leaf().alias("digest"), leaf(offered).alias("offered"))
    leaves = stored(numbered_leaves(rows, folder), f"{folder}/leaves")
    runs = grow(leaves, folder)
    # a subroot is the only node of its tree's last level, or a lone leaf
    lone = leaves.filter("n = 1").select("tree", "digest")
    tops = stored(runs.filter(F.col("level") == _height(F.col("n"))).select("tree", "digest").unionByName(lone), f"{folder}/tops")
    n_trees = tops.count()
    above = grow(tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest"), f"{folder}/top")
    paths = paths_to_root(runs.unionByName(above), n_trees > 1, folder)
    # a lone leaf stands in the tree of subroots, or is the root
    alone = F.col("n") == 1
    to_top = _node(F.lit(TOP), F.lit(1), F.floor(F.col("tree") / FAN)) if n_trees > 1 else F.lit(None).cast(NODE)
    sent = leaves.select(
        "doc_id",
        "digest",
        "offered",
        alone.alias("alone"),
        F.when(alone, to_top).otherwise(_node(F.col("tree"), F.lit(1), F.floor(F.col("idx") / FAN))).alias("node"),
        (F.when(alone, F.col("tree")).otherwise(F.col("idx")) % FAN).cast("int").alias("place"),
    )
    met = sent.join(paths.select("node", "kids", "path", "subroot", "root"), "node", "left")
    proof = F.when(F.col("kids").isNull(), _no_path()).otherwise(F.concat(F.array(_siblings(F.col("kids"), F.col("place"))), F.col("path")))
    subroot = F.when(F.col("alone"), F.col("digest")).otherwise(F.col("subroot"))
    proved = met.select("doc_id", F.col("digest").alias("leaf"), subroot.alias("subroot"), F.coalesce("root", "digest").alias("root"), "offered", proof.alias("proof"))
    fold = F.aggregate("proof", F.col("offered"), lambda node, s: digest(s["left"], node, s["right"]))
    sides = F.flatten(F.transform("proof", lambda s: F.array(s["left"], s["right"])))
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", sides).cast("binary"), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """The text of the manifest's test: A-Z in lower case where 5 divides the crc32 of the decimal id (null: empty)."""
    return F.when(crc_fold(F.col("doc_id"), 5) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of ``docs``, with every proof folded again from the tampered texts."""
    return manifest(docs, tampered_text())


def _levels(of: str, upto: int) -> str:
    out = []
    for k in range(1, upto + 1):
        out.append(
            f"{of}{k} AS (SELECT tree, n, idx // 16 AS idx, list(digest ORDER BY idx) AS kids, sha256(string_agg(digest, '' ORDER BY idx)) AS digest "
            f"FROM {of}{k - 1} WHERE n > {16 ** (k - 1)} GROUP BY tree, n, idx // 16)"
        )
    return ",\n".join(out)


def _walk(prefix: str, of: str, tree: str, idx: str, n: str, upto: int) -> tuple[str, list[tuple[str, str]]]:
    """Joins of a leaf with its run on every level, and the text left and right of it there (null: no such level)."""
    joins, sides = [], []
    for k in range(1, upto + 1):
        at = f"({idx} // {16 ** (k - 1)}) % 16"
        alias = f"{prefix}{k}"
        joins.append(f"LEFT JOIN {of}{k} {alias} ON {alias}.tree = {tree} AND {alias}.idx = {idx} // {16**k} AND {n} > {16 ** (k - 1)}")
        sides.append((f"array_to_string({alias}.kids[1:{at}], '')", f"array_to_string({alias}.kids[{at} + 2:], '')"))
    return "\n".join(joins), sides


def _manifest_sql() -> str:
    deep, wide = 6, 3
    encode = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join([*map(encode, ("doc_id", "source", "lang", "n_chars")), encode(text)]) + ")"
    low, up = _walk("r", "l", "a.tree", "a.idx", "a.n", deep)
    high, over = _walk("t", "s", "0", "a.tree", "a.m", wide)
    sides = [*up, *over]
    folds, node = [], "offered"
    for k, _ in enumerate(sides):
        folds.append(f"f{k + 1} AS (SELECT *, CASE WHEN x{k} IS NULL THEN {node} ELSE sha256(x{k} || {node} || y{k}) END AS v{k + 1} FROM {f'f{k}' if k else 'p'})")
        node = f"v{k + 1}"
    columns = ", ".join(f"{x} AS x{k}, {y} AS y{k}" for k, (x, y) in enumerate(sides))
    proof = " || ".join(f"coalesce(x{k} || y{k}, '')" for k in range(len(sides)))
    return f"""
WITH d AS (SELECT doc_id, source, {h("text")} AS digest,
             {h(f"CASE WHEN {crc32_sql('coalesce(CAST(doc_id AS VARCHAR), repeat(chr(32), 0))')} % 5 = 0 THEN translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}') ELSE text END")} AS offered FROM documents),
a0 AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
              row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest, offered) - 1 AS idx FROM d),
a AS (SELECT *, max(tree) OVER () + 1 AS m FROM a0),
l0 AS (SELECT tree, n, idx, digest FROM a),
{_levels("l", deep)},
tops AS (SELECT tree, arg_max(digest, level) AS digest FROM ({" UNION ALL ".join(f"SELECT tree, digest, {k} AS level FROM l{k}" for k in range(deep + 1))}) GROUP BY tree),
s0 AS (SELECT 0 AS tree, (SELECT count(*) FROM tops) AS n, tree AS idx, digest FROM tops),
{_levels("s", wide)},
root AS (SELECT arg_max(digest, level) AS root FROM ({" UNION ALL ".join(f"SELECT digest, {k} AS level FROM s{k}" for k in range(wide + 1))})),
p AS (SELECT a.doc_id, a.digest AS leaf, tops.digest AS subroot, root.root, a.offered, {columns}
      FROM a JOIN tops ON tops.tree = a.tree CROSS JOIN root
{low}
{high}),
{", ".join(folds)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, {node} AS folded_root, {node} = root AS verified FROM f{len(sides)}
"""


#: DuckDB SQL for ``tampered_manifest`` of ``documents``: six levels per source, three above.
MANIFEST_SQL = _manifest_sql()
