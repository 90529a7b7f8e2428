"""Typo-tolerant searches meet queries document by document, by the words near those asked for."""

import random

import numpy as np

from quire.operators import search as S


def apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def tables(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    rows = [(rng.randrange(250), word(), " ".join(word() for _ in range(rng.randrange(12)))) for _ in range(300)] + [(900, None, None), (901, "", ""), (902, "zz", "zz zy"), (None, "ab", "ab")]
    asked = [(q, " ".join(word() for _ in range(rng.randint(1, 6)))) for q in range(7)] + [(7, ""), (8, None), (9, "qqqqqqq"), (10, "z"), (None, "a ab")]
    docs = spark.createDataFrame(rows, "doc long, title string, text string").repartition(3)
    return rows, asked, docs, spark.createDataFrame(asked, "query_id long, query string")


def test_fuzzy_hits_are_those_of_all_pairs(spark):
    rows, asked, docs, queries = tables(spark)
    targets = [(d, None if d % 19 == 0 else d % 17) for d in sorted({r[0] for r in rows if r[0] is not None})]
    plain = lambda t: (t or "").replace("é", "e").split()
    tf = {}
    for doc, title, text in rows:
        for w, weight in [(w, 5.0) for w in plain(title)] + [(w, 1.0) for w in plain(text)]:
            own = tf.setdefault(doc, {})
            own[w] = own.get(w, 0) + weight
    want = []
    for q, query in asked:
        best = {}
        for doc, target in targets:
            near = [[(1 - apart(t, w) / len(t)) * n for w, n in tf.get(doc, {}).items() if w[0] == t[0] and apart(t, w) <= 2] for t in set(plain(query))]
            if any(near):
                best[target] = max(best.get(target, -1e9), sum(max(x) for x in near if x))
        ranked = sorted(((-round(g, 6), t is not None, t) for t, g in best.items()), key=lambda x: (x[0], x[1], x[2] or 0))
        want += [(q, t, -g, i + 1) for i, (g, _, t) in enumerate(ranked[:6])]
    index = S.build_index(docs, {"title": 5.0, "text": 1.0})
    out = S.search_fuzzy(queries, index, spark.createDataFrame(targets, "doc long, target long"), limit=6)
    key = lambda r: (str(r[0]), r[3])
    assert sorted(((r.query_id, r.target, round(r.gain, 6), r.pos) for r in out.collect()), key=key) == sorted(want, key=key)
    assert any(g == 0 for _, _, g, _ in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id#" in plan and not any("Aggregate [" in x and ("term#" in x.split("]")[0] or "query_id#" in x.split("]")[0] and "doc#" in x.split("]")[0]) for x in plan.splitlines())


def test_relaxed_search_makes_no_rows_of_documents_and_words(spark):
    _, _, docs, queries = tables(spark)
    units = docs.where("doc is not null").select("doc", "doc").distinct().toDF("doc", "target").selectExpr("doc", "target", "'e' as edition", "'k' as kind", "'supported' as state")
    for frame in S.search_relaxed(queries, S.build_index(docs), units, limit=5, enough=3):
        assert frame.count() > 0
        aggregates = [x.split("]")[0] for x in frame._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
        assert aggregates and not any("term#" in x for x in aggregates)


def test_searches_for_nothing(spark):
    _, _, docs, _ = tables(spark)
    queries = spark.createDataFrame([(1, None), (2, "..")], "query_id long, query string")
    far = spark.createDataFrame([(1, "qqqqqqq")], "query_id long, query string")
    units = docs.selectExpr("doc", "doc as target", "'e' as edition", "'k' as kind", "'supported' as state").distinct()
    for asked in (queries, far):
        index = S.build_index(docs)
        assert S.search_fuzzy(asked, index, units.select("doc", "target"), limit=3).count() == 0
        assert [f.count() for f in S.search_relaxed(asked, index, units, limit=3)] == [0, 0]


def test_many_words_are_counted_as_few_are(spark, monkeypatch):
    _, _, docs, _ = tables(spark)
    index = S.build_index(docs, {"title": 5.0, "text": 1.0})
    words = ["a", "ab", "be", "e", "zz"]
    rows = lambda: sorted(((r.doc, r.length, sorted(zip(r.terms, r.tfs))) for r in S._asked_counts(index, words).collect()), key=str)
    dense = rows()
    monkeypatch.setattr(S, "DENSE", 1)
    assert rows() == dense and len(dense) > 100 and np.sum([len(r[2]) for r in dense]) > 100
