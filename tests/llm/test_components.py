import random

import pytest

from trailmark.llm import components


def plain(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components(spark, kind):
    rnd = random.Random(1)
    if kind == "path":
        edges = [(i, i + 1) for i in range(100)] + [(200, 199)]
    elif kind == "star":
        edges = [(50, i) for i in range(120) if i != 50]
    else:
        edges = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(90)]
        edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame(edges + edges[:3], "u long, v long")
    assert sorted(map(tuple, components.components(df).collect())) == plain(edges)


def test_nulls_loops_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3), (5, 4)], "u long, v long")
    assert sorted(map(tuple, components.components(df).collect())) == [(4, 4), (5, 4)]
    assert components.components(df.limit(0)).count() == 0


def test_a_round_makes_no_broadcast(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (5, 4)], "u long, v long")
    done = components._star(components._star(df, large=True), large=False)
    assert sorted(map(tuple, done.collect())) == [(2, 1), (3, 1), (5, 4)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
