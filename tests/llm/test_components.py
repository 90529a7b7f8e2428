"""Connected components against union-find; a star's ids take no part in the rounds."""

import random

import pytest

from quire.llm import common as C


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        r, s = find(a), find(b)
        root[max(r, s)] = min(r, s)
    return {x: find(x) for a, b in edges if a != b for x in (a, b)}


def comb(n):
    """A chain of hubs, each with an end that has a smaller id."""
    return [(1000 + i, 1000 + i + 1) for i in range(n)] + [(1000 + i, i) for i in range(n)]


@pytest.mark.parametrize("edges", [[(5, 5)], [(2, 1)], [(1, 2), (2, 1), (2, 3), (7, 9)], comb(150), [(random.Random(4).randrange(400) * 7 % 401, i) for i in range(300)], [(random.Random(i).randrange(300), random.Random(-i - 1).randrange(300)) for i in range(170)]])
def test_components(spark, edges):
    found = C.components(spark.createDataFrame(edges, "a long, b long"), C.Scratch(spark, "parts"), rounds=20)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == brute(edges)


def test_stars_are_one_pass(spark, monkeypatch):
    """A large star and a chain of its ids: few rows are joined in rounds."""
    joined, salted = [], C.salted_join
    monkeypatch.setattr(C, "salted_join", lambda rows, *rest, **how: joined.append(rows.count()) or salted(rows, *rest, **how))
    edges = spark.range(1, 20_000).selectExpr("id as a", "0 as b").union(spark.range(30_000, 30_008).selectExpr("id as a", "id + 1 as b"))
    found = C.components(edges.selectExpr("cast(a as long) a", "cast(b as long) b"), C.Scratch(spark, "parts"))
    assert {(r.label, r.n) for r in found.groupBy("label").count().withColumnRenamed("count", "n").collect()} == {(0, 20_000), (30_000, 9)}
    assert sum(joined) < 25_000
