"""Ranked versions: a dense rank per package, intervals as rank ranges, and the joins that need no residual comparison.

All versions of a package that a run knows (lookups, releases, bounds of intervals) are numbered once, in the order of
their keys. An interval is then a range of whole numbers ``[lo, hi)``. A range falls into at most thirty aligned nodes of every
level of a tree with sixteen children per node, and a version lies in one node of each level, so "which intervals cover this
version" is an equi-join on (package, level, node): every pair that meets is a hit, nothing is compared in vain, and the
versions of one hot package are spread over as many keys as they have nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import versions as V
from fleetlens.session import cut_lineage
from fleetlens.skew import rank_in_key

PACKAGE = ["ecosystem", "norm_name"]
VERSION = [*PACKAGE, "version"]
#: Bits of a tree level: sixteen children per node, as versions (a row per level) outnumber intervals.
BITS = 4


def version_index(*frames: DataFrame) -> DataFrame:
    """(package, version, version_key, rank, n_ranks, is_prerelease, major) of every valid version of the frames.

    The one place where versions are parsed: each spelling of an ecosystem once, however many packages share it. Spellings
    of equal order share a rank. ``n_ranks`` is the number of ranks of the package.
    """
    eco, version = F.col("ecosystem"), F.col("version")
    asked = reduce(DataFrame.unionByName, [f.select(*VERSION) for f in frames]).filter(version.isNotNull()).distinct()
    asked = cut_lineage(asked)
    parsed = asked.select("ecosystem", "version").distinct().select(
        "*", F.explode(F.array_compact(F.array(V.version_key(version, eco)))).alias("version_key"), V.is_prerelease(version, eco).alias("is_prerelease"), V.major_of(version, eco).alias("major")
    )
    keyed = asked.join(cut_lineage(parsed), ["ecosystem", "version"])
    ranked = rank_in_key(keyed, PACKAGE, "version_key", "rank", "n_ranks")
    return ranked.select(*VERSION, "version_key", F.col("rank").cast("long"), F.col("n_ranks").cast("long"), "is_prerelease", "major")


def bound_versions(ranges: DataFrame) -> DataFrame:
    """(package, version) of every bound of the intervals, for ``version_index``."""
    bounds = F.array_compact(F.array("introduced", "fixed", "last_affected"))
    return ranges.select(*PACKAGE, F.explode(bounds).alias("version"))


def rank_spans(ranges: DataFrame, index: DataFrame) -> DataFrame:
    """(package, identifier, lo, hi, n_ranks): the intervals that can match, as ranges of ranks.

    ``introduced`` "0" and a missing lower bound start at the first rank, a missing upper bound ends behind the last;
    ``last_affected`` counts only without ``fixed``. GIT intervals and unparsable bounds never match, nor do empty ranges.
    """
    known = index.select(*PACKAGE, "version", "rank")
    sizes = index.select(*PACKAGE, "n_ranks").distinct()

    def rank_of(column: str) -> DataFrame:
        return known.select(*PACKAGE, F.col("version").alias(column), F.col("rank").alias(f"_{column}"))

    rows = ranges.filter("range_type <> 'GIT'").select(*PACKAGE, "identifier", "introduced", "fixed", "last_affected").distinct()
    for column in ("introduced", "fixed", "last_affected"):
        rows = rows.join(rank_of(column), [*PACKAGE, column], "left")
    rows = rows.join(sizes, PACKAGE)
    first = F.col("introduced").isNull() | (F.col("introduced") == "0")
    lo = F.when(first, F.lit(0)).otherwise(F.col("_introduced"))
    hi = (
        F.when(F.col("fixed").isNotNull(), F.col("_fixed"))
        .when(F.col("last_affected").isNotNull(), F.col("_last_affected") + 1)
        .otherwise(F.col("n_ranks"))
    )
    spans = rows.select(*PACKAGE, "identifier", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), "n_ranks")
    return spans.filter("lo < hi").distinct()


def _top() -> Column:
    """The level whose one node holds all ranks of the package."""
    return F.expr(f"aggregate(sequence(1, {62 // BITS}), 0, (top, k) -> IF(shiftright(n_ranks - 1, {BITS} * (k - 1)) > 0, k, top))")


def with_nodes(rows: DataFrame) -> DataFrame:
    """One row per level for rows with (rank, n_ranks): the node that the rank lies in."""
    levels = rows.withColumn("level", F.explode(F.sequence(F.lit(0), _top())))
    return levels.withColumn("node", F.expr(f"shiftright(rank, {BITS} * level)"))


def span_nodes(spans: DataFrame) -> DataFrame:
    """The aligned nodes that make up every span (lo, hi, n_ranks): disjoint, and at most thirty on a level."""
    size = 1 << BITS
    # nodes of a level that lie inside the span, from a to b; their parents that do, from c to d
    edges = f"""transform(sequence(0, _top), k -> named_struct('level', k,
      'a', shiftright(lo + shiftleft(1L, {BITS} * k) - 1, {BITS} * k), 'b', shiftright(_end, {BITS} * k),
      'c', shiftright(lo + shiftleft(1L, {BITS} * (k + 1)) - 1, {BITS} * (k + 1)), 'd', shiftright(_end, {BITS} * (k + 1))))"""
    nodes = f"""flatten(transform(_edges, e -> transform(
      CASE WHEN e.a >= e.b THEN cast(array() AS array<bigint>)
           WHEN e.level = _top OR e.c >= e.d THEN sequence(e.a, e.b - 1)
           ELSE concat(IF(e.a < {size} * e.c, sequence(e.a, {size} * e.c - 1), cast(array() AS array<bigint>)),
                       IF({size} * e.d < e.b, sequence({size} * e.d, e.b - 1), cast(array() AS array<bigint>))) END,
      node -> named_struct('level', e.level, 'node', node))))"""
    rows = spans.withColumn("_top", _top())
    # a span up to the last rank also fills what the tree has behind it
    rows = rows.withColumn("_end", F.expr(f"IF(hi >= n_ranks, shiftleft(1L, {BITS} * _top), hi)"))
    rows = rows.withColumn("_edges", F.expr(edges)).withColumn("_node", F.explode(F.expr(nodes)))
    return rows.select("*", "_node.level", "_node.node").drop("_top", "_end", "_edges", "_node")


def covering(rows: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` (package, rank, n_ranks, …) with the columns ``keep`` of every span that covers their rank, one row per span."""
    inside = span_nodes(spans).select(*PACKAGE, "level", "node", *keep)
    return with_nodes(rows).join(inside, [*PACKAGE, "level", "node"]).drop("level", "node")


def union_spans(spans: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(package, by…, lo, hi, n_ranks): the ranks that any span of the package covers, as disjoint sorted ranges.

    With ``by`` the spans of each value of these columns are a set of their own, so ``covering`` gives each value once per
    row. A span opens a new range if it starts behind every end before it: one window over the package's spans.
    """
    group = [*PACKAGE, *by]
    by_start = Window.partitionBy(*group).orderBy("lo", "hi")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.groupBy(*group, "n_ranks", "lo").agg(F.max("hi").alias("hi"))
    opens = F.coalesce((F.col("lo") > F.max("hi").over(before)).cast("int"), F.lit(1))
    marked = rows.withColumn("_opens", opens).withColumn("_range", F.sum("_opens").over(by_start))
    return marked.groupBy(*group, "n_ranks", "_range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_range")
