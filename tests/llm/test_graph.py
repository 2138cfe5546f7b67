"""Components against a union-find."""

import random

import pytest

from keyspan.llm.graph import components


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        if u != v:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("kind", ["random", "path", "star", "mixed", "none", "loops"])
def test_components(spark, kind):
    rnd = random.Random(7)
    edges = {
        "random": [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)],
        "path": [(i, i + 1) for i in rnd.sample(range(500), 500)],
        "star": [(1000, i) for i in range(300)] + [(i, 2000) for i in range(300, 400)],
        "mixed": [(i * 7 % 301, (i * 11 + 3) % 301) for i in range(200)] + [(-5, -9), (-9, 2**62), (-(2**63), 5000)],
        "none": [],
        "loops": [(1, 1), (2, 2), (3, 4), (4, 3), (3, 4)],
    }[kind]
    frame = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.comp for r in components(frame).collect()} == brute(edges)
