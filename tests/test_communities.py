"""Communities by modularity, against label propagation and known groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import graph as G

SCHEMA = "set_a int, set_b int, similarity double"


def cliques(n, size, bridges):
    edges = [(c * size + i, c * size + j, 1.0) for c in range(n) for i, j in itertools.combinations(range(size), 2)]
    return edges + [(c * size, (c + 1) % n * size, 0.3) for c in range(bridges)]


def random_graph(seed):
    r = random.Random(seed)
    return [(i, j, round(r.random(), 2)) for i, j in itertools.combinations(range(36), 2) if r.random() < (0.6 if i // 9 == j // 9 else 0.06)]


def quality(edges, label):
    total = 2 * sum(w for *_, w in edges)
    inside = sum(2 * w for u, v, w in edges if label[u] == label[v])
    degree = {}
    for u, v, w in edges:
        degree[label[u]] = degree.get(label[u], 0) + w
        degree[label[v]] = degree.get(label[v], 0) + w
    return inside / total - sum((k / total) ** 2 for k in degree.values())


def propagated(edges):
    label = {x: x for u, v, _ in edges for x in (u, v)}
    for _ in range(30):
        new = {}
        for x in label:
            votes = {label[x]: max(w for u, v, w in edges if x in (u, v))}
            for u, v, w in edges:
                if x in (u, v):
                    other = label[v if u == x else u]
                    votes[other] = votes.get(other, 0) + w
            new[x] = min(votes, key=lambda c: (-round(votes[c], 9), c))
        if new == label:
            break
        label = new
    return label


@pytest.mark.parametrize("name, edges", [("cliques", cliques(4, 5, 4)), ("random", random_graph(1)), ("chain", [(k, k + 1, 1.0) for k in range(24)])])
def test_modularity_is_at_least_that_of_label_propagation(spark, name, edges):
    nodes = sorted({x for u, v, _ in edges for x in (u, v)}) + [999]
    table = spark.createDataFrame([(x, x / 1000 + 0.001, "kept") for x in nodes], "set_id int, padj double, nes string")
    out = G.similarity_graph(spark.createDataFrame(edges, SCHEMA), table, "set_id", padj="padj").collect()
    label = {r["set_id"]: r["community"] for r in out}
    assert set(label) == set(nodes) and label[999] == 999 and all(r["nes"] == "kept" and r["neg_log10_padj"] is not None for r in out)
    assert all(label[c] == c and c <= x for x, c in label.items())
    assert quality(edges, label) >= quality(edges, propagated(edges)) - 1e-9
    if name == "cliques":
        assert [label[x] for x in range(20)] == [x // 5 * 5 for x in range(20)]
    both = spark.createDataFrame(edges + [(v, u, w) for u, v, w in edges], "u int, v int, w double")
    measured = G.modularity(both, spark.createDataFrame(list(label.items()), "v int, label int"))
    assert abs(measured - quality(edges, label)) < 1e-9


def test_graphs_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "set_id int")
    out = G.similarity_graph(spark.createDataFrame([], SCHEMA), nodes, "set_id")
    assert sorted(map(tuple, out.select("set_id", "community").collect())) == [(1, 1), (2, 2)]
    assert G.similarity_graph(spark.createDataFrame([], SCHEMA), nodes.limit(0), "set_id").where(F.col("community").isNull()).count() == 0
