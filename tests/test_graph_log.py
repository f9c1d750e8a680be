"""Versions of the graph: states by summation, the four counts, and what a run without answers keeps."""

from fleetlens.operators import graph as G

NODES = "repository_id int, node_id string, label string, name string, version string, ecosystem string, status string"
EDGES = "repository_id int, src string, dst string, type string"


def graph(spark, repos, statuses, scored="HIGH"):
    """Repositories with one component and the dependencies of ``statuses`` each; every vulnerable one has an advisory edge."""
    nodes, edges = [(None, "Vulnerability:V", "Vulnerability", "V", scored, None, None)], []
    for r in repos:
        nodes += [(r, f"Repository:{r}", "Repository", f"r{r}", None, None, None), (r, f"Component:{r}:src", "Component", "src", None, None, None)]
        edges += [(r, f"Repository:{r}", f"Component:{r}:src", "CONTAINS")]
        for name, status in statuses.items():
            node = f"Dependency:{r}:npm:{name}"
            nodes.append((r, node, "Dependency", name, "1.0.0", "npm", status))
            edges += [(r, f"Repository:{r}", node, "USES"), (r, f"Component:{r}:src", node, "USES")]
            if status == "VULNERABLE":
                edges.append((r, node, "Vulnerability:V", "AFFECTED_BY"))
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ids(spark, *repos):
    return spark.createDataFrame([(r,) for r in repos], "repository_id int")


def test_states_and_counts_of_versions(spark, tmp_path):
    log = G.GraphLog(spark, str(tmp_path / "g"), buckets=8)
    first = graph(spark, [1, 2, 3], {"a": "VULNERABLE", "b": "SAFE"})
    second = graph(spark, [1], {"a": "SAFE", "c": "SAFE"}, "LOW")
    log.sync(*first, ids(spark, 1, 2, 3), 1)
    for _ in range(2):  # delivered twice
        counts = log.sync(*second, ids(spark, 1), 2)
    assert [(r.nodes_written, r.relationships_written, r.stale_relationships_deleted, r.nodes_pruned) for r in counts.collect()] == [(4, 5, 6, 1)]
    assert rows(log.nodes_at(1)) == rows(first[0]) and rows(log.edges_at(1)) == rows(first[1])
    want = first[0].filter("repository_id > 1").unionByName(second[0])
    assert rows(log.nodes_at()) == rows(want)
    assert rows(log.edges_at()) == rows(first[1].filter("repository_id <> 1").unionByName(second[1]))
    changed = log.edges.read().filter("graph_version = 2")
    assert {(r.repository_id, r.sign) for r in changed.collect()} == {(1, -1), (1, 1)} and changed.filter("dst LIKE '%:npm:a'").isEmpty()
    empty = log.sync(second[0].limit(0), second[1].limit(0), ids(spark, 2), 3)
    assert [(r.nodes_written, r.stale_relationships_deleted, r.nodes_pruned) for r in empty.collect()] == [(0, 6, 4)]
    assert {r.repository_id for r in log.nodes_at().collect()} == {None, 1, 3}


def test_a_run_without_answers_keeps_what_was_known(spark, tmp_path):
    log = G.GraphLog(spark, str(tmp_path / "g"), buckets=4)
    nodes, edges = graph(spark, [1], {"a": "VULNERABLE", "b": "SAFE"})
    log.sync(nodes, edges, ids(spark, 1), 1)
    unknown, none = graph(spark, [1], {"a": "UNKNOWN", "b": "SAFE"})
    counts = log.sync(unknown, none.filter("src NOT LIKE 'Component:%'"), ids(spark, 1), 2, preserve=True).first()
    kept = {("Dependency:1:npm:a", "AFFECTED_BY"), ("Component:1:src", "USES")}
    assert {(r.src, r.type) for r in log.edges_at().collect()} == kept | {("Repository:1", "CONTAINS"), ("Repository:1", "USES")}
    assert (counts.relationships_written, counts.stale_relationships_deleted, counts.nodes_pruned) == (3, 4, 0)
