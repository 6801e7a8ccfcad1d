"""Colouring in rounds of joins, and the choice between it and the kernel."""

import itertools
import random

import pytest

from markbook.operators import graph


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string")


GRAPHS = {
    "clique": ([f"n{i}" for i in range(9)], list(itertools.combinations([f"n{i}" for i in range(9)], 2))),
    "star": (["c", *(f"l{i}" for i in range(40))], [("c", f"l{i}") for i in range(40)]),
    "none": (["x", "y"], []),
}


def random_graph(seed, n=120, m=900):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(n)]
    return nodes, sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(m)})


@pytest.mark.parametrize("name", [*GRAPHS, 1])
def test_rounds_are_proper_and_bounded(spark, name):
    nodes, edges = GRAPHS.get(name) or random_graph(name)
    got = {r.node: r.slot for r in graph.color_rounds(*frames(spark, nodes, edges)).collect()}
    degree = {n: sum(n in e for e in edges) for n in nodes}
    assert set(got) == set(nodes) and all(got[a] != got[b] for a, b in edges)
    assert 1 <= min(got.values()) and max(got.values()) <= max(degree.values()) + 1


def test_large_components_go_by_rounds(spark):
    nodes, edges = random_graph(2, 30, 60)
    small = [("s1", "s2")]
    from markbook.session import checkpointing

    checkpointing(spark)
    v, e = frames(spark, [*nodes, "s1", "s2"], [*edges, *small])
    for most_nodes, most_edges in ((5, 10**6), (10**6, 5), (10**6, 10**6)):
        got = {r.node: r.slot for r in graph.assign_slots(v, e, most_nodes, most_edges).collect()}
        assert len(got) == 32 and all(got[a] != got[b] for a, b in [*edges, *small])
