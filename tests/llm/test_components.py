"""Connected components against union-find, on graphs of many shapes."""

import random

from eventide.llm.components import components


def _expected(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root if find(x) != x}


def test_shapes(spark):
    rng = random.Random(3)
    graphs = [
        [(3, 1), (3, 2)],
        [(i, i + 1) for i in range(40)],
        [(0, i) for i in range(1, 30)] + [(100, i) for i in range(101, 120)] + [(29, 119)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        [(5, 5)],
    ]
    for edges in graphs:
        got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.component for r in got} == _expected(edges)


def test_empty_and_null(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, None)], "a bigint, b bigint")).count() == 0
