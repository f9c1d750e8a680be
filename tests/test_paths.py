"""Path search: the best simple paths are those of an exhaustive search, and the frontier stays bounded."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import graph as G

EDGES = "repository_id int, src string, dst string, type string"
TARGETS = "repository_id int, node_id string"


def best_paths(edges, target, depth, limit):
    back = {}
    for s, d in set(edges):
        back.setdefault(d, []).append(s)
    found, frontier = [], [(target,)]
    for _ in range(depth):
        frontier = [(s, *p) for p in frontier if not p[0].startswith("Repository:") for s in back.get(p[0], []) if s not in p]
        found += sorted((p for p in frontier if p[0].startswith("Repository:")), key="\u0001".join)
    return found[:limit]


def layered(width, layers):
    """Repository -> layer 1 -> … -> one target, every node of a layer with every node of the next."""
    names = [["Repository:1"], *([f"Dependency:l{k}n{n:02d}" for n in range(width)] for k in range(layers)), ["Dependency:target"]]
    return [e for a, b in zip(names, names[1:]) for e in product(a, b)]


def frame(spark, edges):
    return spark.createDataFrame([(1, s, d, "USES") for s, d in edges], EDGES)


def rounds(spark, edges, targets, depth, limit):
    """Partial paths that the search holds after each of its rounds."""
    frontier, hops = G.path_search(frame(spark, edges), spark.createDataFrame([(1, t) for t in targets], TARGETS), depth)
    sizes = []
    for _ in range(depth):
        step = G.extend_paths(frontier, hops, limit)
        frontier = step.filter("ways > 1")
        sizes.append(step.count())
    return sizes


def test_dense_layers_stay_bounded(spark):
    """30 x 30 x 30 x 30 nodes: 810,000 paths, and no round holds more than 25 partial paths per node of a layer."""
    edges = layered(30, 4)
    sizes = rounds(spark, edges, ["Dependency:target"], 5, 25)
    assert max(sizes) <= 30 * 25
    got = G.dependency_paths(frame(spark, edges), spark.createDataFrame([(1, "Dependency:target")], TARGETS), 5, 25).collect()
    want = [("Repository:1", "Dependency:l0n00", "Dependency:l1n00", "Dependency:l2n00", f"Dependency:l3n{n:02d}", "Dependency:target") for n in range(25)]
    assert sorted(tuple(r.path) for r in got) == want


def test_dense_cycles_stay_bounded(spark):
    """A complete graph of 30 packages: the conflict counts bound what labels of distance cannot."""
    nodes = [f"Dependency:n{n:02d}" for n in range(30)]
    edges = [("Repository:1", n) for n in nodes] + [(a, b) for a in nodes for b in nodes if a != b]
    sizes = rounds(spark, edges, nodes[:1], 5, 25)
    assert max(sizes) <= 30 * 150
    got = G.dependency_paths(frame(spark, edges), spark.createDataFrame([(1, n) for n in nodes[:3]], TARGETS), 4, 40).collect()
    for n in nodes[:3]:
        assert sorted((r.length, tuple(r.path)) for r in got if r.node_id == n) == [(len(p) - 1, p) for p in best_paths(edges, n, 4, 40)]


@pytest.mark.parametrize("seed", range(2))
def test_best_paths_are_those_of_an_exhaustive_search(spark, seed):
    r = random.Random(seed)
    edges, targets = [], []
    for repo in (1, 2):
        nodes = [f"Dependency:{chr(97 + n)}" for n in range(8)]
        own = [(f"Repository:{repo}", n) for n in r.sample(nodes, 3)] + [(a, b) for a in nodes for b in nodes if a != b and r.random() < (0.25, 0.8)[seed % 2]]
        edges += [(repo, s, d, "DEPENDS_ON") for s, d in own + own[:3]]
        edges += [(repo, nodes[0], f"Repository:{repo}", "USES"), (repo, nodes[1], "Vulnerability:x", "AFFECTED_BY")]
        targets += [(repo, n) for n in [*nodes, "Dependency:absent"]]
    df, asked = spark.createDataFrame(edges, EDGES), spark.createDataFrame(targets, TARGETS)
    for depth, limit in ((6, 3), (4, 1000)):
        got = G.dependency_paths(df, asked, depth, limit).collect()
        for repo, n in targets:
            own = [(s, d) for k, s, d, kind in edges if k == repo and kind != "AFFECTED_BY" and not d.startswith("Repository:")]
            assert sorted((x.length, x.path) for x in got if (x.repository_id, x.node_id) == (repo, n)) == [(len(p) - 1, list(p)) for p in best_paths(own, n, depth, limit)]


def test_walk_lengths_are_bits(spark):
    edges = [("Repository:1", "Dependency:a"), ("Dependency:a", "Dependency:b"), ("Dependency:b", "Dependency:a"), ("Dependency:x", "Dependency:y")]
    hops = frame(spark, edges).select("repository_id", F.col("src").alias("_prev"), F.col("dst").alias("_head"))
    got = {r.node_id: r.lengths for r in G.walk_lengths(hops, spark.createDataFrame([(1,)], "repository_id int"), 4).collect()}
    assert got == {"Repository:1": 1, "Dependency:a": 0b1010, "Dependency:b": 0b10100}
