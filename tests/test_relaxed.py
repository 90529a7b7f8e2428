"""Searches that drop words."""

import re

from quire.operators import search as S

UNITS = "doc long, target long, edition string, kind string, state string"


def searched(spark, texts, query, units=None, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    rows = units or [(i, i, "e", "k", "supported") for i in range(len(texts))]
    hits, facets = S.search_relaxed(spark.createDataFrame([(1, query)], "query_id long, query string"), S.build_index(docs), spark.createDataFrame(rows, UNITS), **{"limit": 10, **how})
    return [(r.doc, r.words) for r in hits.orderBy("pos").collect()], {(r.facet, r.value): r.n for r in facets.collect()}, hits


def test_last_words_are_dropped(spark):
    texts = ["white bread flour", "white bread", "white wine", "bread flour", "withe bred flour"]
    assert searched(spark, texts, "white bread flour", enough=1)[0] == [(0, 3), (4, 3)]
    assert searched(spark, texts, "white bread flour", enough=2)[0] == [(0, 3), (4, 3)]
    assert searched(spark, texts, "white bread flour", enough=3)[0] == [(0, 3), (4, 3), (1, 2)]
    # Without its first word a document is no hit, however few there are.
    assert searched(spark, texts, "white bread flour", enough=99)[0] == [(0, 3), (4, 3), (1, 2), (2, 1)]
    assert searched(spark, texts, "nothing bread", enough=1)[0] == []


def test_filters_facets_targets_and_pages(spark):
    texts = ["rye"] * 6
    units = [(0, 7, "a", "x", "supported"), (1, 7, "a", "x", "supported"), (2, 8, "b", "x", "candidate"), (3, 9, "b", "y", "supported"), (4, 10, "b", "x", None), (5, 11, "c", "x", "supported")]
    hits, facets, _ = searched(spark, texts, "rye", units)
    assert hits == [(0, 1), (2, 1), (3, 1), (4, 1), (5, 1)] and facets == {("edition", "a"): 1, ("edition", "b"): 3, ("edition", "c"): 1, ("kind", "x"): 4, ("kind", "y"): 1}
    hits, facets, _ = searched(spark, texts, "rye", units, editions=["a", "b"], kinds=["x"], candidates=False)
    assert hits == [(0, 1), (4, 1)] and facets == {("edition", "a"): 1, ("edition", "b"): 1, ("kind", "x"): 2}
    hits, _, frame = searched(spark, texts, "rye", units, limit=2, offset=1)
    assert hits == [(2, 1), (3, 1)] and {r.next_offset for r in frame.collect()} == {3}
    assert searched(spark, texts, "", units)[0] == []


def test_pairs_of_a_query_and_a_document_are_not_sorted(spark):
    """Tasks leave out what can't be a hit, over several batches of documents, and no window runs over a query and a document."""
    words = "ab cd ef gh".split()
    texts = [" ".join(words[(i * 7 + k) % 4] for k in range(1 + i % 4)) for i in range(1300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    units = spark.createDataFrame([(i, i % 50 or None, "e", "k", "supported") for i in range(1300)], UNITS)
    asked = {1: "ab cd ef gh", 2: "gh ab xx", 3: "cd", 4: "xx ab"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    hits, facets = S.search_relaxed(queries, S.build_index(docs), units, limit=9, enough=20, edits=0)
    found = {}
    for q, query in asked.items():
        best = {}
        for i, text in enumerate(texts):
            want = query.split()
            n = next((k for k, w in enumerate(want) if w not in text.split()), len(want))
            if n:
                gain = sum(text.split().count(w) for w in want[:n])
                best[i % 50] = min(best.get(i % 50, (0, 0, 0)), (-n, -gain, i))
        least = next((k for k in (4, 3, 2) if sum(-n >= k for n, _, _ in best.values()) >= 20), 1)
        found[q] = sorted(b for b in best.values() if -b[0] >= least)
    assert sorted((r.query_id, r.pos, r.words, r.gain, r.doc) for r in hits.collect()) == [(q, i + 1, -n, -g, d) for q in asked for i, (n, g, d) in enumerate(found[q][:9])]
    assert {(r.query_id, r.n) for r in facets.collect() if r.facet == "kind"} == {(q, len(f)) for q, f in found.items() if f}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(query_id#" in plan and not re.search(r"windowspecdefinition\(query_id#\d+L?, doc#", plan)
