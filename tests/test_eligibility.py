"""Approvals that wait for what they need."""

from quire.operators import editions as E
from quire.operators import review as V


def states(spark, tmp_path, scopes, uses):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    decisions = spark.createDataFrame([(s, "approve", 1, 1) for s in scopes if s >= 0], "scope long, action string, digest long, seq long")
    rows = spark.createDataFrame([(s, 1) for s in scopes], "scope long, digest long")
    return {r.scope: r.state for r in E.eligibility(rows, decisions, spark.createDataFrame(uses, "scope long, needs long")).collect()}


def test_long_chain(spark, tmp_path):
    chain = [(i, i + 1) for i in range(29)]
    assert set(states(spark, tmp_path, list(range(30)), chain).values()) == {"approved"}
    got = states(spark, tmp_path, [*range(30), -1], [*chain, (29, -1)])
    assert {got[i] for i in range(30)} == {"support"} and got[-1] == "undecided"


def test_cycles_and_unknown_needs(spark, tmp_path):
    got = states(spark, tmp_path, [1, 2, 3, 4, 5, 6, 7], [(1, 2), (2, 1), (3, 1), (4, 4), (5, 99), (6, 7), (6, 7)])
    assert got == {1: "support", 2: "support", 3: "support", 4: "support", 5: "support", 6: "approved", 7: "approved"}


def test_phrases_stand_between_word_boundaries(spark):
    texts = [(1, "Add 1½ cups of flour"), (2, "add ½ cup of flour now"), (3, "1/2  Cup of\nflour"), (4, None), (5, "x1/2 cup of flour"), (6, "one two three four five six seven")]
    phrases = [(1, "½ cup of flour"), (2, ""), (3, None), (4, "two three four five six seven"), (5, "TWO"), (6, "three five")]
    got = V.present(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "item_id long, phrase string"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (1, 3), (4, 6), (5, 6)]
