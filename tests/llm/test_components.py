"""Connected components, by one task's forest and by rounds over several."""

from __future__ import annotations

import random

import pytest

from webposture.llm.components import components


@pytest.mark.parametrize("task_edges", [500_000, 40])
def test_components(spark, task_edges):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 220)] + [(500, k) for k in range(501, 560)] + [(k, k) for k in (1, 2, 100)]
    edges += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    draw.shuffle(edges)
    edges += edges[:30]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(6), task_edges).collect()
    assert {r.node: r.component for r in found} == {x: parent[x] for x in linked} and len(found) == len(linked)


def test_no_edges(spark):
    assert components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
