"""Knowledge graph of the fleet as two tables.

nodes(repository_id, node_id, label, name, version, ecosystem, status) and edges(repository_id, src, dst, type). An
edge belongs to the repository it was observed in; advisory nodes are global and carry no repository. Node ids are
``Label:natural key``, so the label of an end is the text before the first colon.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from heapq import nlargest
from itertools import groupby, repeat, tee

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions import text as T
from fleetlens.session import cut_lineage
from fleetlens.skew import top_per_key
from fleetlens.sources.tables import BUCKETS, BucketTable

MAX_DEPTH = 8
EDGE_COLUMNS = ["repository_id", "src", "dst", "type"]
NODE_COLUMNS = ["repository_id", "node_id", "label", "name", "version", "ecosystem", "status"]


def label_of(node_id: Column) -> Column:
    return F.substring_index(node_id, ":", 1)


def dependency_node_id() -> Column:
    version = F.coalesce("version", F.lit(""))
    return T.graph_node_id(
        "Dependency", F.col("repository_id"), F.col("ecosystem"), T.dependency_label(F.col("package_name"), version)
    )


def component_node_id(path: str = "path") -> Column:
    return T.graph_node_id("Component", F.col("repository_id"), F.col(path))


def repository_node_id() -> Column:
    return T.graph_node_id("Repository", F.col("repository_id"))


def dependency_nodes(deps: DataFrame, order: str = "dependency_id") -> DataFrame:
    """Dependency nodes of (repository_id, ecosystem, package_name, version, vulnerability_status, <order>).

    The first row of a natural key wins; the aggregate keeps one row per key and input partition.
    """
    rows = deps.withColumn("node_id", dependency_node_id())
    first = rows.groupBy("repository_id", "node_id").agg(
        F.min_by(F.struct("package_name", "version", "ecosystem", "vulnerability_status"), order).alias("d")
    )
    return first.select(
        "repository_id",
        "node_id",
        F.lit("Dependency").alias("label"),
        F.col("d.package_name").alias("name"),
        F.coalesce("d.version", F.lit("")).alias("version"),
        F.col("d.ecosystem").alias("ecosystem"),
        F.coalesce("d.vulnerability_status", F.lit("UNCHECKED")).alias("status"),
    )


def build_nodes(repositories: DataFrame, components: DataFrame, deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """The four node sets, one row per natural key."""
    null = F.lit(None).cast("string")

    def plain(frame: DataFrame, node_id: Column, label: str, name: str, repository: Column) -> DataFrame:
        rows = frame.select(repository.alias("repository_id"), node_id.alias("node_id"), F.col(name).alias("name"))
        return rows.groupBy("repository_id", "node_id").agg(F.min("name").alias("name")).select(
            "repository_id", "node_id", F.lit(label).alias("label"), "name", null.alias("version"), null.alias("ecosystem"), null.alias("status")
        )

    owner = F.col("repository_id")
    return (
        plain(repositories, repository_node_id(), "Repository", "name", owner)
        .unionByName(plain(components, component_node_id(), "Component", "path", owner))
        .unionByName(dependency_nodes(deps))
        .unionByName(
            plain(advisories, T.graph_node_id("Vulnerability", F.col("identifier")), "Vulnerability", "identifier", F.lit(None).cast("bigint"))
        )
    )


def _resolved(frame: DataFrame, deps: DataFrame, *ends: str) -> DataFrame:
    """Rows with the node id of every named dependency id, null for unknown ones."""
    known = deps.select("dependency_id", dependency_node_id().alias("_node")).distinct()
    for end in ends:
        side = known.withColumnsRenamed({"dependency_id": end, "_node": end.replace("_id", "_node")})
        frame = frame.join(side, end, "left")
    return frame


def _edges(rows: DataFrame, src: Column, dst: Column, kind: str) -> DataFrame:
    return rows.select("repository_id", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))


def build_edges(
    components: DataFrame, deps: DataFrame, relations: DataFrame, affected: DataFrame, usage: DataFrame
) -> DataFrame:
    """CONTAINS, USES, DEPENDS_ON and AFFECTED_BY edges, each once, none to itself.

    ``relations`` is (repository_id, parent_id, child_id), ``affected`` (repository_id, dependency_id, identifier),
    ``usage`` (repository_id, dependency_id, path); ids refer to ``deps.dependency_id``.
    """
    related = _resolved(relations, deps, "parent_id", "child_id").filter("parent_node <> child_node")
    hit = _resolved(affected, deps, "dependency_id").filter("dependency_node IS NOT NULL AND identifier <> ''")
    paths = components.select("repository_id", "path").distinct()
    used = _resolved(usage.join(paths, ["repository_id", "path"], "left_semi"), deps, "dependency_id").filter("dependency_node IS NOT NULL")
    return (
        _edges(components, repository_node_id(), component_node_id(), "CONTAINS")
        .unionByName(_edges(deps, repository_node_id(), dependency_node_id(), "USES"))
        .unionByName(_edges(used, component_node_id(), F.col("dependency_node"), "USES"))
        .unionByName(_edges(related, F.col("parent_node"), F.col("child_node"), "DEPENDS_ON"))
        .unionByName(_edges(hit, F.col("dependency_node"), T.graph_node_id("Vulnerability", F.col("identifier")), "AFFECTED_BY"))
        .distinct()
    )


def skipped_counts(components: DataFrame, deps: DataFrame, relations: DataFrame, usage: DataFrame) -> DataFrame:
    """How many input rows gave no graph element, per repository and reason."""

    def count(rows: DataFrame, reason: Column) -> DataFrame:
        return rows.select("repository_id", reason.alias("reason")).filter("reason IS NOT NULL").groupBy("repository_id", "reason").agg(F.count("*").alias("n"))

    def repeated(rows: DataFrame, key: list[Column], reason: str) -> DataFrame:
        per = rows.groupBy("repository_id", *key).agg((F.count("*") - 1).alias("extra"))
        return per.groupBy("repository_id").agg(F.sum("extra").alias("n")).filter("n > 0").select("repository_id", F.lit(reason).alias("reason"), "n")

    related = _resolved(relations, deps, "parent_id", "child_id")
    unknown = F.col("parent_node").isNull() | F.col("child_node").isNull()
    reason = F.when(unknown, "relations_unknown_dependency").when(F.col("parent_node") == F.col("child_node"), "relations_self_reference")
    good = related.filter(~unknown & (F.col("parent_node") != F.col("child_node")))
    paths = components.select("repository_id", "path").distinct().withColumn("_known", F.lit(True))
    placed = usage.join(paths, ["repository_id", "path"], "left")
    return (
        repeated(components, [F.col("path")], "duplicate_components")
        .unionByName(repeated(deps, [dependency_node_id().alias("node")], "duplicate_dependencies"))
        .unionByName(count(related, reason))
        .unionByName(repeated(good, [F.col("parent_node"), F.col("child_node")], "duplicate_relations"))
        .unionByName(count(placed, F.when(F.col("_known").isNull(), "usage_unknown_component")))
    )


def signed_changes(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """(columns…, sign): -1 for a row that went, +1 for one that came; what both sides have cancels out."""
    both = old.select(*columns, F.lit(-1).alias("sign")).unionByName(new.select(*columns, F.lit(1).alias("sign")))
    return both.groupBy(*columns).agg(F.sum("sign").cast("int").alias("sign")).filter("sign <> 0")


class GraphLog:
    """The graph as signed changes per version, in buckets of the repository.

    A version appends the rows that it removes and adds, so an unchanged repository costs nothing; the state at any version
    is the sum of the signs up to it. A sync reads the buckets of the repositories it names, and of the advisories, which
    belong to none. A version that is delivered again changes nothing (see ``BucketTable``).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.nodes, self.edges = (BucketTable(spark, f"{path}/{t}", ["repository_id"], buckets) for t in ("nodes", "edges"))

    def _at(self, table: BucketTable, columns: list[str], like: DataFrame | None, version: int | None, buckets: list[int] | None = None) -> DataFrame | None:
        log = table.read(buckets, None if like is None else like.select(*columns).withColumns({"sign": F.lit(1), "graph_version": F.lit(1)}).schema)
        if log is None:
            return None
        if version is not None:
            log = log.filter(F.col("graph_version") <= version)
        return log.groupBy(*columns).agg(F.sum("sign").alias("_n")).filter("_n > 0").drop("_n")

    def nodes_at(self, version: int | None = None) -> DataFrame | None:
        return self._at(self.nodes, NODE_COLUMNS, None, version)

    def edges_at(self, version: int | None = None) -> DataFrame | None:
        return self._at(self.edges, EDGE_COLUMNS, None, version)

    def sync(self, new_nodes: DataFrame, new_edges: DataFrame, repositories: DataFrame, version: int, preserve: bool = False) -> DataFrame:
        """The named repositories become ``new_nodes`` and ``new_edges``; returns their four counts.

        Components and dependencies that are gone are pruned with their edges, advisories stay, new values winning. With
        ``preserve`` (J5, a run whose advisory lookups failed in part) the old advisory and component-use edges of
        dependencies whose new status is UNKNOWN are kept and count neither as deleted nor as written.
        """
        synced = cut_lineage(repositories.select("repository_id").distinct())
        none = synced.select(F.lit(None).cast(synced.schema["repository_id"].dataType).alias("repository_id")).limit(1)
        touched = self.nodes.touched(synced.unionByName(none))
        new_nodes, new_edges = cut_lineage(new_nodes.select(*NODE_COLUMNS)), cut_lineage(new_edges.select(*EDGE_COLUMNS).distinct())
        advisory = F.col("label") == "Vulnerability"
        stored = self._at(self.nodes, NODE_COLUMNS, new_nodes, version - 1, touched)
        old_local = stored.filter(~advisory).join(synced, "repository_id", "left_semi")
        new_local = new_nodes.filter(~advisory)
        replaced = stored.filter(advisory).join(new_nodes.filter(advisory).select("node_id"), "node_id", "left_semi")
        old_edges = cut_lineage(self._at(self.edges, EDGE_COLUMNS, new_edges, version - 1, touched).join(synced, "repository_id", "left_semi"))
        kept = preserved_edges(old_edges, new_nodes).select(*EDGE_COLUMNS) if preserve else old_edges.limit(0)
        deleted = old_edges.join(kept, EDGE_COLUMNS, "left_anti")
        counts = cut_lineage(_sync_counts(cut_lineage(old_local), deleted, new_local, new_edges, synced))
        edge_changes = signed_changes(old_edges, new_edges.unionByName(kept).distinct(), EDGE_COLUMNS)
        node_changes = signed_changes(old_local.unionByName(replaced.select(*NODE_COLUMNS)), new_nodes, NODE_COLUMNS)
        self.edges.append(edge_changes.withColumn("graph_version", F.lit(version)), f"version-{version}")
        self.nodes.append(node_changes.withColumn("graph_version", F.lit(version)), f"version-{version}")
        return counts


def _sync_counts(local_old: DataFrame, deleted: DataFrame, local_new: DataFrame, new_edges: DataFrame, synced: DataFrame) -> DataFrame:
    keys = ["repository_id", "node_id"]
    parts = [
        (local_new, "nodes_written"),
        (new_edges, "relationships_written"),
        (deleted, "stale_relationships_deleted"),
        (local_old.join(local_new.select(*keys), keys, "left_anti"), "nodes_pruned"),
    ]
    rows = synced
    for frame, name in parts:
        rows = rows.join(frame.groupBy("repository_id").agg(F.count("*").alias(name)), "repository_id", "left")
    return rows.fillna(0, [name for _, name in parts])


def preserved_edges(old_edges: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Old advisory and component-use edges of dependencies whose new status is UNKNOWN."""
    unknown = new_nodes.filter("label = 'Dependency' AND status = 'UNKNOWN'").select("repository_id", F.col("node_id").alias("_dep"))
    component_use = (F.col("type") == "USES") & F.col("src").startswith("Component:")
    end = F.when(F.col("type") == "AFFECTED_BY", F.col("src")).when(component_use, F.col("dst"))
    rows = old_edges.withColumn("_dep", end).filter("_dep IS NOT NULL")
    return rows.join(unknown, ["repository_id", "_dep"], "left_semi").drop("_dep")


def components_using(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repository_id, node_id, component) of the components with a USES edge to a dependency node."""
    rows = edges.filter((F.col("type") == "USES") & F.col("src").startswith("Component:"))
    asked = dependencies.select("repository_id", "node_id")
    used = rows.select("repository_id", F.col("dst").alias("node_id"), F.col("src").alias("component"))
    return used.join(asked, ["repository_id", "node_id"], "left_semi")


def related_dependencies(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One hop along DEPENDS_ON in both directions."""
    rows = edges.filter("type = 'DEPENDS_ON'")
    asked = dependencies.select("repository_id", "node_id")

    def side(own: str, other: str, direction: str) -> DataFrame:
        found = rows.select("repository_id", F.col(own).alias("node_id"), F.col(other).alias("related"), F.lit(direction).alias("direction"))
        return found.join(asked, ["repository_id", "node_id"], "left_semi")

    return side("src", "dst", "depends_on").unionByName(side("dst", "src", "depended_on_by"))


def vulnerabilities_for(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Advisory nodes of each dependency node."""
    rows = edges.filter("type = 'AFFECTED_BY'").select("repository_id", F.col("src").alias("node_id"), F.col("dst").alias("advisory"))
    return rows.join(dependencies.select("repository_id", "node_id"), ["repository_id", "node_id"], "left_semi")


def has_dependency(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The asked dependencies with whether their node exists."""
    known = nodes.filter("label = 'Dependency'").select("repository_id", "node_id", F.lit(True).alias("_known"))
    rows = dependencies.join(known, ["repository_id", "node_id"], "left")
    return rows.withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def walk_lengths(hops: DataFrame, repositories: DataFrame, max_length: int) -> DataFrame:
    """(repository_id, node_id, lengths) of every node that walks from its repository reach: bit k stands for a walk of k hops.

    One breadth-first round per length over all repositories at once; a round holds a node once, whatever the walks to it.
    """
    level = repositories.select("repository_id", F.concat(F.lit("Repository:"), F.col("repository_id").cast("string")).alias("node_id")).distinct()
    levels = level.withColumn("lengths", F.lit(1))
    for length in range(1, max_length + 1):
        level = level.withColumnRenamed("node_id", "_prev").join(hops, ["repository_id", "_prev"]).select("repository_id", F.col("_head").alias("node_id")).distinct()
        level = cut_lineage(level)
        if level.isEmpty():
            break
        levels = levels.unionByName(level.withColumn("lengths", F.lit(1 << length)))
    return levels.groupBy("repository_id", "node_id").agg(F.bit_or("lengths").alias("lengths"))


def thin_group(rows: Iterable[tuple[Sequence[str], Sequence[int], int]], limit: int) -> Iterator[int]:
    """For each partial path of one target and head, in path order, the prefix lengths that it may still be completed with.

    A partial path can only enter the best ``limit`` with a prefix that fewer than ``limit`` smaller partial paths go with. A
    prefix of p hops has p - 1 inner nodes, and it excludes a smaller path only through a node that stands in that path,
    not in this one, and that a walk of 1 to p - 1 hops reaches. So if m smaller paths are kept for p, and any p - 1 such nodes
    stand in k of them at most, this one is out for p as soon as m - k >= limit. Pure counting: no simple path is lost.
    """
    kept: dict[int, int] = {}
    uses: dict[int, dict[str, int]] = {}
    for path, marks, ways in rows:
        inner = path[1:-1]
        for p in [p for p in range(1, ways.bit_length()) if ways >> p & 1]:
            m, counts = kept.get(p, 0), uses.setdefault(p, {})
            if m >= limit:
                excluded = nlargest(p - 1, (n for node, n in counts.items() if node not in inner))
                if m - sum(excluded) >= limit:
                    ways &= ~(1 << p)
                    continue
            kept[p] = m + 1
            for node, lengths in zip(inner, marks[1:-1]):
                if lengths & ((1 << p) - 2):
                    counts[node] = counts.get(node, 0) + 1
        yield ways


def _thin(step: DataFrame, limit: int) -> DataFrame:
    """``step`` (stored) without the partial paths that cannot enter the best ``limit``; see ``thin_group``.

    Only groups with more than ``limit`` partial paths are read. They stream through their tasks in path order, a group's
    state being the counts of what it keeps; nothing is collected.
    """
    group = ["repository_id", "node_id", "_head"]
    over = step.filter("ways > 1").groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*group)
    over = cut_lineage(over)
    if over.isEmpty():
        return step

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (*group, "path", "marks", "ways")
        rows = (r for b in batches for r in zip(range(b.num_rows), repeat(b), *(b.column(c).to_pylist() for c in columns)))
        for _, members in groupby(rows, key=lambda r: r[2:5]):
            one, two = tee(members)
            held: list[tuple[pa.RecordBatch, int, int]] = []
            for (at, batch, *_), ways in zip(one, thin_group((r[5:] for r in two), limit)):
                if held and held[0][0] is not batch:
                    yield _taken(held)
                    held = []
                if ways:
                    held.append((batch, at, ways))
            if held:
                yield _taken(held)

    large = step.join(over, group, "left_semi").filter("ways > 1").repartition(*group).sortWithinPartitions(*group, F.array_join("path", "\u0001"))
    rest = step.filter("ways > 1").join(over, group, "left_anti").unionByName(step.filter("ways = 1"))
    return cut_lineage(rest.unionByName(large.select(*step.columns).mapInArrow(thin, step.schema)))


def _taken(held: list[tuple[pa.RecordBatch, int, int]]) -> pa.RecordBatch:
    """Rows of one batch with their new ways."""
    batch = held[0][0].take(pa.array([at for _, at, _ in held]))
    place = batch.schema.get_field_index("ways")
    return batch.set_column(place, batch.schema.field(place), pa.array([ways for *_, ways in held], pa.int32()))


def dependency_paths(edges: DataFrame, targets: DataFrame, max_depth: int = 4, limit: int = 25) -> DataFrame:
    """(repository_id, node_id, length, path[]) — the ``limit`` shortest simple paths repository -> dependency.

    The search walks backwards from the targets, one length per round. ``walk_lengths`` says which prefix lengths can still
    complete a partial path within the depth; one that has none is never extended, nor one that cannot enter the best
    ``limit`` (``thin_group``), nor any of a target that has its paths. Ties of one length are taken in path order. A round
    holds, per target and head, at most a number of partial paths that depends on limit and depth, not on the graph.
    """
    if not 1 <= max_depth <= MAX_DEPTH:
        raise ValueError(f"paths are searched to a depth of 1 to {MAX_DEPTH}")
    frontier, hops = path_search(edges, targets, max_depth)
    found: list[DataFrame] = []
    target = ["repository_id", "node_id"]
    done: DataFrame | None = None
    for length in range(1, max_depth + 1):
        step = extend_paths(frontier, hops, limit)
        arrived = step.filter("ways = 1").select(*target, F.lit(length).alias("length"), "path")
        best = top_per_key(arrived, target, [F.array_join("path", "\u0001")], limit)
        found.append(best.drop("rank_in_key"))
        if length == max_depth:
            break
        counts = best.groupBy(*target).agg(F.count("*").alias("n"))
        done = counts if done is None else done.unionByName(counts).groupBy(*target).agg(F.sum("n").alias("n"))
        frontier = step.filter("ways > 1").join(done.filter(F.col("n") >= limit).select(*target), target, "left_anti")
        if frontier.isEmpty():
            break
    return top_per_key(reduce(DataFrame.unionByName, found), target, [F.col("length"), F.array_join("path", "\u0001")], limit).drop("rank_in_key")


def path_search(edges: DataFrame, targets: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The first frontier of ``dependency_paths`` (every target as a path of itself), and the hops with the walk lengths of their start."""
    hops = edges.filter(F.col("type").isin("CONTAINS", "USES", "DEPENDS_ON")).select("repository_id", F.col("src").alias("_prev"), F.col("dst").alias("_head")).distinct()
    # a path ends at its repository, so no walk leads through it again
    hops = hops.filter(~F.col("_head").startswith("Repository:"))
    lengths = walk_lengths(hops, targets.select("repository_id"), max_depth)
    start = targets.select("repository_id", "node_id").distinct().join(lengths, ["repository_id", "node_id"])
    frontier = start.select(
        "repository_id", "node_id", F.col("node_id").alias("_head"), F.array("node_id").alias("path"), F.array("lengths").alias("marks"), F.col("lengths").alias("ways")
    )
    # a hop matters only if a walk from the repository gets to its start
    reached = lengths.select("repository_id", F.col("node_id").alias("_prev"), F.col("lengths").alias("_lengths"))
    return frontier, cut_lineage(hops.join(reached, ["repository_id", "_prev"]))


def extend_paths(frontier: DataFrame, hops: DataFrame, limit: int) -> DataFrame:
    """One round: every partial path by one hop backwards; ``ways`` has bit p if p more hops can complete it (1: complete)."""
    step = frontier.join(hops, ["repository_id", "_head"])
    ways = F.shiftright("ways", 1).bitwiseAND(F.col("_lengths"))
    step = step.filter((ways != 0) & ~F.array_contains("path", F.col("_prev")))
    step = step.select(
        "repository_id",
        "node_id",
        F.col("_prev").alias("_head"),
        F.concat(F.array("_prev"), F.col("path")).alias("path"),
        F.concat(F.array("_lengths"), F.col("marks")).alias("marks"),
        ways.alias("ways"),
    )
    return _thin(cut_lineage(step), limit)


def repository_graph(nodes: DataFrame, edges: DataFrame, limit: int = 500) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept nodes, edges between them, totals) per repository, cut to ``limit`` nodes.

    Order: the repository, its components, its advisories, then its dependencies with vulnerable ones first.
    """
    own = nodes.filter("label <> 'Vulnerability'").select(*NODE_COLUMNS)
    touched = edges.filter("type = 'AFFECTED_BY'").select("repository_id", F.col("dst").alias("node_id")).distinct()
    advisories = touched.join(nodes.filter("label = 'Vulnerability'").drop("repository_id"), "node_id").select(*NODE_COLUMNS)
    group = F.when(F.col("label") == "Repository", 0).when(F.col("label") == "Component", 1).when(F.col("label") == "Vulnerability", 2).otherwise(3)
    bad_first = F.when((F.col("label") == "Dependency") & (F.col("status") != "VULNERABLE"), 1).otherwise(0)
    order = [group, bad_first, F.col("name"), F.coalesce("version", F.lit("")), F.col("node_id")]
    view = own.unionByName(advisories)
    kept = top_per_key(view, ["repository_id"], order, limit, "position")
    ends = kept.select("repository_id", "node_id")
    inside = edges.join(ends.withColumnRenamed("node_id", "src"), ["repository_id", "src"], "left_semi")
    inside = inside.join(ends.withColumnRenamed("node_id", "dst"), ["repository_id", "dst"], "left_semi")
    totals = view.groupBy("repository_id").agg(
        F.count_if(F.col("label") == "Component").alias("components"),
        F.count_if(F.col("label") == "Dependency").alias("dependencies"),
        F.count_if(F.col("label") == "Vulnerability").alias("vulnerabilities"),
        (F.count("*") > limit).alias("truncated"),
    )
    return kept, inside, totals


def dependency_context(nodes: DataFrame, edges: DataFrame, dependencies: DataFrame, max_depth: int = 4, limit: int = 25) -> DataFrame:
    """Users, parents, children, advisories and paths of each dependency; an absent node is not available.

    "No graph facts" is never shown as "nothing uses it": the arrays of an absent node are null.
    """
    keys = ["repository_id", "node_id"]
    asked = dependencies.select(*keys).distinct()

    def listed(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias(name))

    related = related_dependencies(edges, asked)
    paths = dependency_paths(edges, asked, max_depth, limit)
    parts = [
        (listed(components_using(edges, asked), "component", "components_using"), "components_using"),
        (listed(related.filter("direction = 'depends_on'"), "related", "depends_on"), "depends_on"),
        (listed(related.filter("direction = 'depended_on_by'"), "related", "depended_on_by"), "depended_on_by"),
        (listed(vulnerabilities_for(edges, asked), "advisory", "vulnerabilities"), "vulnerabilities"),
        (
            paths.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("length", "path"))), lambda p: p["path"]).alias("paths")),
            "paths",
        ),
    ]
    rows = has_dependency(nodes, asked).withColumnRenamed("exists", "available")
    for frame, name in parts:
        kind = "array<array<string>>" if name == "paths" else "array<string>"
        rows = rows.join(frame, keys, "left").withColumn(
            name, F.when(F.col("available"), F.coalesce(name, F.array().cast(kind)))
        )
    return rows


def remove_repository(nodes: DataFrame, edges: DataFrame, repositories: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, removed nodes per repository) without the named repositories; advisories stay."""
    gone = repositories.select("repository_id").distinct()
    removed = nodes.join(gone, "repository_id", "left_semi").groupBy("repository_id").agg(F.count("*").alias("nodes_removed"))
    return nodes.join(gone, "repository_id", "left_anti"), edges.join(gone, "repository_id", "left_anti"), removed
