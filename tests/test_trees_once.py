"""Nodes of trees move once to their document, what is broken once to its key."""

import random
from collections import Counter

from quire.operators import model as M

NODES = "doc long, id string, preorder int, subtree_end int, parent string, ordinal int, kind string, children array<string>"


def broken(rows):
    """The rules one by one, over all pairs of a document. Parents that are there twice are not planted."""
    out, text = set(), lambda *x: ":".join(str(v) for v in x if v is not None)
    for i, n in Counter(r[1] for r in rows).items():
        if n > 1:
            out.add(("node twice", text(i)))
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        places = [r[2] for r in own]
        if None in places or sorted(places) != list(range(len(own))):
            out.add(("places", text(doc)))
        if sum(r[4] is None for r in own) != 1:
            out.add(("roots", text(doc)))
        for r in own:
            _, i, pre, end, parent, ordinal, kind, children = r
            if doc is not None and (pre is None or end is None or not (pre == end if kind == "text" else pre <= end < len(own))):
                out.add(("interval", text(i)))
            kids = [c for c in own if c[4] is not None and c[4] == i and doc is not None]
            for k, name in enumerate(children or []):
                if name is None or not any(c[5] == k and c[1] == name for c in kids):
                    out.add(("child names another", text(i, name)))
            last = pre
            for c in sorted(kids, key=lambda c: (c[2] is not None, c[2], c[1] is not None, c[1])):
                if kind != "element":
                    out.add(("parent is no element", text(c[1])))
                if None in (pre, end, c[2], c[3]) or c[2] <= pre or c[3] > end:
                    out.add(("outside its parent", text(c[1])))
                if c[2] is None or last is None or c[2] != last + 1:
                    out.add(("siblings", text(c[1])))
                if c[5] is None or c[5] >= len(children or []) or children[c[5]] != c[1]:
                    out.add(("parent names another", text(c[1])))
                last = pre if c[3] is None else c[3]
            if parent is not None and (doc is None or not any(p[1] == parent for p in own)):
                out.add(("parent", text(i)))
    return sorted(out)


def test_rules_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    rows = [(1, "", 0, 0, None, None, "element", []), (1, None, 1, 1, None, None, "text", None), (2, None, 0, 0, None, None, "text", None), (None, "q", 0, 1, None, None, "element", ["z"]), (None, "z", 1, 1, "q", 0, "text", None)]
    for doc in range(10, 60):
        n = rng.randrange(1, 8)
        up = [None] + [rng.randrange(i) for i in range(1, n)]
        ids = [f"{doc % 45}.{i}" for i in range(n)]
        for i in range(n):
            kids = [j for j in range(n) if up[j] == i]
            row = [doc, ids[i], i, max([i, *[j for j in range(n) if j > i and rng.random() < 0.5]]), None if i == 0 else ids[up[i]], None if i == 0 else [j for j in range(n) if up[j] == up[i]].index(i), "element" if kids else "text", [ids[j] for j in kids]]
            for column, value in ((2, None), (3, n), (4, "gone"), (5, 0), (5, None), (6, "text"), (7, [*row[7], "x"]), (7, [None])):
                if rng.random() < 0.03:
                    row[column] = value
            rows.append(tuple(row))
    rng.shuffle(rows)
    out = M.check_trees(spark.createDataFrame(rows, NODES).repartition(3))
    want = broken(rows)
    assert sorted(map(tuple, out.collect())) == want and {r for r, _ in want} == set(M.TREE_RULES)


def test_nodes_move_once(spark):
    rows = spark.range(1000).repartition(3).selectExpr("id as doc", "cast(id as string) as id", "0 as preorder", "0 as subtree_end", "cast(null as string) as parent", "cast(null as int) as ordinal", "'text' as kind", "cast(null as array<string>) as children")
    plan = M.check_trees(rows)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
