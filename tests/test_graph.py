"""Connected components against union-find."""

import random

import pytest

from tidemark.operators.graph import components


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up) if root(x) != x}


PATH = [(i, i + 1) for i in range(40)]
STARS = [(0, i) for i in range(1, 60)] + [(i, 100 + i) for i in range(1, 60)]
CASES = {"none": [], "loop": [(1, 1)], "one": [(1, 2)], "least leaf": [(5, 1), (5, 2)], "repeated": [(1, 2), (2, 1), (2, 1), (3, 3)], "path": PATH, "two levels": STARS}


@pytest.mark.parametrize("name", [*CASES, "random"])
def test_components(spark, name):
    draw = random.Random(5)
    edges = CASES.get(name) if name in CASES else [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    got = components(spark.createDataFrame(edges, "a int, b int")).collect()
    want = plain(edges)
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
