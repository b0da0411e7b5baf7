import random

import pytest

from folioscope.functions import joins
from folioscope.functions.joins import connected_components, spread_join


def components(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        up[b] = a
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize(("bound", "hot"), [(300_000, 20_000), (5, 3), (0, 20_000)])
def test_components_of_chains_and_stars(spark, monkeypatch, bound, hot):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", max(bound, 1))
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 120) if k % 40] + [(200, k) for k in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges + [(None, 3), (9, 9)], "u long, v long")).collect()}
    expected = components({n for e in edges for n in e}, edges)
    assert found == {n: c for n, c in expected.items() if n in found} and set(found) >= {n for e in edges for n in e if e[0] != e[1]}


def test_components_within_scopes_and_without_edges(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("t", "b", "c"), ("t", "c", "d")], "scope string, u string, v string")
    assert sorted(map(tuple, connected_components(edges, ["scope"]).collect())) == [("s", "a", "a"), ("s", "b", "a"), ("t", "b", "b"), ("t", "c", "b"), ("t", "d", "b")]
    assert connected_components(edges.limit(0), ["scope"]).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("bound", "hot"), [(100, 1), (2, 1), (2, 1000)])
def test_spread_join_is_a_join(spark, monkeypatch, how, bound, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(60)] + [(1, 100 + k) for k in range(30)], "key int, x int")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(1, 9)], "key int, v string")
    weighed = table.join(rows.groupBy("key").count(), "key", "left").na.fill(0)
    found = spread_join(rows, weighed, ["key"], "count", how, bound)
    assert found.columns == ["key", "x", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, rows.join(table, "key", how).collect()), key=str)
