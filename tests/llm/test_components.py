"""Connected components against union by hand."""

import random

import pytest

from echolens.llm.components import components, extended


def plain(edges):
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 3)], [(3, 5), (5, 3), (3, 5)], [(9, k) for k in range(9)], [(k + 1, k) for k in range(40)],
    [(k, (7 * k) % 31) for k in range(31)], [(a, b) for a in range(12) for b in range(a)],
    [(random.Random(3).randint(0, 60 + k), k) for k in range(60)]])
def test_components(spark, edges):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == plain(edges) and got.count() == len(plain(edges))


def test_links_in_several_parts(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(70)]
    labels = None
    for part in (edges[:20], [], edges[20:50], edges[50:]):
        labels = extended(labels, spark.createDataFrame(part, "a long, b long"))
    got = labels.collect()
    assert {r.node: r.label for r in got} == plain(edges) and len(got) == len(plain(edges))
