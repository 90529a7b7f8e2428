"""Closures and bounded work against plain breadth-first searches."""

import random
from collections import deque

import pytest

from quire.operators import graphs as G
from quire.plans.registry import shared_folder


@pytest.fixture(autouse=True)
def folder(spark):
    shared_folder(spark)


def reached(seed, edges):
    out, queue = set(seed), deque(seed)
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in out:
                out.add(b)
                queue.append(b)
    return out


def closed(spark, seed, edges):
    return sorted(r.id for r in G.closure(spark.createDataFrame([(s,) for s in seed], "id long"), spark.createDataFrame(edges, "src long, dst long")).collect())


def test_a_chain_of_a_thousand(spark):
    edges = [(i, i + 1) for i in range(1000)]
    assert closed(spark, [0, 700], edges) == list(range(1001))


@pytest.mark.parametrize("n, m", [(30, 25), (30, 60), (12, 120)])
def test_closure(spark, n, m):
    rng = random.Random(n * m)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(None, 1), (2, None), (3, 3)]
    seed = rng.sample(range(n), 3) + [n + 5, None]
    assert closed(spark, seed, edges) == sorted(reached([s for s in seed if s is not None], [e for e in edges if None not in e]))


def test_closure_of_nothing(spark):
    assert closed(spark, [], [(1, 2)]) == [] and closed(spark, [4], []) == [4]


def test_dependents_and_pages(spark):
    decisions = [(1, "approve", 7, "x", 10), (2, "approve", 7, "y", 11), (3, "review_portion", 7, "z", 12), (4, "reject", 7, "x", 10), (5, "approve", 8, "x", 10), (6, "approve", 9, "q", 1), (7, "approve", 9, "q", 1)]
    frame = spark.createDataFrame(decisions, "id long, action string, scope long, scope_digest string, candidate long")
    bindings = spark.createDataFrame([(6, 2), (7, 6), (1, 7), (5, 4)], "id long, decision long")
    target = spark.createDataFrame([(7, "y", 12)], "scope long, scope_digest string, candidate long")
    assert sorted(r.id for r in G.dependents(frame, bindings, target).collect()) == [1, 2, 3, 6, 7]
    alike = spark.createDataFrame([(7, 10)], "scope long, candidate long")
    only = spark.createDataFrame([(7, "none", 99)], target.schema)
    affected = G.dependents(frame, bindings, only, alike)
    assert [r.id for r in affected.collect()] == [1]
    evidence = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 1)], "id long, source string, page long")
    assert [tuple(r) for r in G.affected_pages(affected, evidence).collect()] == [("a", 5)]


def test_links_on_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8), (8, 9), (9, 10), (10, 11), (11, 7)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    on = lambda depth: sorted((r.src, r.dst) for r in G.on_cycle(frame, depth).collect())
    assert on(2) == [(1, 2), (2, 3), (3, 1), (6, 6)]
    assert on(8) == [(1, 2), (2, 3), (3, 1), (6, 6), (7, 8), (8, 9), (9, 10), (10, 11), (11, 7)]


USES = "use long, src long, dst long, required boolean, whole boolean, size int"


def worked(spark, uses, roots, **budget):
    work, summary = G.supporting_work(spark.createDataFrame(uses, USES), spark.createDataFrame([(r,) for r in roots], "root long"), **budget)
    rows = sorted((r.root, r.n, r.use, r.depth, r.unresolved, r.cycle) for r in work.collect())
    return rows, {r.root: (r.n_uses, r.n_unresolved, r.truncated) for r in summary.collect()}


def test_work_goes_breadth_first(spark):
    uses = [(1, 10, 20, True, True, 5), (2, 10, 30, False, True, 5), (3, 20, 40, True, True, 5), (4, 30, 50, True, True, 5), (5, 40, 10, True, True, 5), (6, 40, None, True, True, 5), (7, 20, 60, None, True, 5), (8, 20, 70, True, False, 5), (9, 20, 70, True, None, 5)]
    rows, summary = worked(spark, uses, [10, 30, 99])
    assert [r[2:] for r in rows if r[0] == 10] == [
        (1, 1, False, True), (2, 1, False, False), (3, 2, False, True), (7, 2, True, False), (8, 2, True, False), (9, 2, True, False), (5, 3, False, True), (6, 3, True, False),
    ]
    assert summary == {10: (8, 4, False), 30: (1, 0, False), 99: (0, 0, False)}


def test_budgets_and_depth_cut(spark):
    chain = [(i, i, i + 1, True, True, 10) for i in range(9)]
    assert worked(spark, chain, [0], depth=3)[1] == {0: (4, 0, True)}
    assert worked(spark, chain, [5], depth=8)[1] == {5: (4, 0, False)}
    wide = [(i, 0, i + 1, True, True, 10) for i in range(9)]
    assert worked(spark, wide, [0], limit=9)[1] == {0: (9, 0, False)}
    assert worked(spark, wide, [0], limit=8)[1] == {0: (8, 0, True)}
    assert worked(spark, wide, [0], most_bytes=35)[1] == {0: (3, 0, True)}
    # Many ways to one recipe are one visit.
    layers = [(a * 100 + i * 10 + j, a * 10 + i, a * 10 + 10 + j, True, True, 0) for a in range(6) for i in range(4) for j in range(4)]
    assert worked(spark, layers, [0], depth=8, limit=1000)[1] == {0: (84, 0, False)}
