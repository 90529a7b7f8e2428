"""Unresolved marks in texts, many texts to a task."""

from quire.operators import consensus as C


def test_marks_meet_their_texts_without_a_frame_for_each(spark):
    texts = spark.createDataFrame([(1, "a\nb c\nb"), (2, None), (3, "x"), (None, "n")], "key long, text string")
    marks = spark.createDataFrame([(1, 2, "two", "b"), (1, 1, "one", "c"), (2, 1, "one", "zz"), (None, 5, "five", "n"), (9, 1, "one", "x")], "key long, id int, code string, fragment string")
    got = C.mark_unresolved(texts, marks)
    want = {1: "a\nb [unresolved 1: one]\n[unresolved 2: two]", 2: "\n[unresolved 1: one]", 3: "x", None: "[unresolved 5: five]"}
    assert {r.key: r.text for r in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_corrections_meet_their_texts_without_a_frame_for_each(spark):
    from quire.operators import reports as P

    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "x"), (None, "n")], "unit long, text string")
    ledger = spark.createDataFrame([(1, 2, 1, "c", "d"), (1, 1, 2, "a", "c"), (2, 1, 1, "a", "b"), (None, 1, 7, "n", "m"), (9, 1, 1, "x", "y")], "unit long, decided_at long, id long, from_text string, to_text string")
    got = P.apply_in_order(texts, ledger)
    want = {(1, 1, "applied", None), (1, 2, "applied", None), (1, None, "text", "d b"), (2, 1, "stale", None), (2, None, "text", None), (3, None, "text", "x"), (None, 7, "applied", None), (None, None, "text", "m")}
    assert {tuple(r) for r in got.collect()} == want
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()
