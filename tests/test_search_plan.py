"""Every word counts in a search, and rare character classes keep their accents' rule."""

from pyspark.sql import functions as F

from quire.functions.text import strip_accents
from quire.operators import search as S


def test_every_word_counts(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "c"), (4, None)], "doc long, text string")
    queries = spark.createDataFrame([(7, "a b"), (8, "c"), (9, "a zzz")], "query_id long, query string")
    hits = S.score(S.query_terms(queries), S.build_index(docs), True)
    assert sorted((r["query_id"], r["doc"]) for r in hits.collect()) == [(7, 1), (7, 2), (8, 1), (8, 3)]


def test_characters_of_several(spark):
    rows = spark.createDataFrame([("é가ñ",), ("né",), ("ো中",), (None,)], "t string").select(strip_accents(F.col("t")).alias("t"))
    assert [r["t"] for r in rows.collect()] == ["e가n", "ne", "ো中", None]


def test_tasks_give_only_the_best_hits(spark):
    rows = [(i % 280, " ".join(f"w{k}" for k in range(7) if (i >> k) & 1) + " x" * (i % 5)) for i in range(300)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc long, title string").withColumn("text", F.col("title"))
    queries = spark.createDataFrame([(7, "w1 w2 x"), (8, "w0"), (9, "w3 zzz"), (10, None)], "query_id long, query string")
    index, shown = S.build_index(docs, {"title": 5.0, "text": 1.0}), docs.where("doc % 3 > 0")
    for every in (True, False):
        terms = S.query_terms(queries)
        slow = sorted(map(tuple, S._score_pairs(terms, index, every, shown).collect()))
        assert sorted(map(tuple, S.score(terms, index, every, shown).collect())) == slow
        few = S.score(terms, index, every, shown, most=2)
        assert few.count() <= 4 * 2 * 3 < len(slow)
        best = {q: sorted((s, d) for r, d, s in slow if r == q)[:2] for q in {r[0] for r in slow}}
        got = few.collect()
        assert all(sorted((r["score"], r["doc"]) for r in got if r["query_id"] == q)[:2] == b for q, b in best.items())
