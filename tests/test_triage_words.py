"""Words of a page move once and come together in the order of their lines and places."""

import random

from quire.operators import review as V


def test_words_of_a_page(spark):
    rows = [(1, -2, 10, "b", 50), (1, -2, 9, "ü", 50), (1, 3, 1, "", 90), (1, 3, 2, "x", 70), (1, 30, 1, None, 10), (1, 4, 0, None, 10), (1, 4, 100, "z", 70), (2, 1, 1, None, 5), (2, 2, 5, "0", 80), (2, 2, -5, "1", 80)]
    random.Random(2).shuffle(rows)
    words = spark.createDataFrame(rows, "page long, line long, pos int, word string, confidence int").repartition(3)
    out = V.ocr_triage(words)
    got = {r["page"]: (r["text"], r["mean_confidence"], r["reasons"]) for r in out.collect()}
    assert got == {1: ("ü b\n x\nz\n", 60.0, "short"), 2: ("\n1 0", 80.0, "short,numbers")}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("hashpartitioning(page") == 1 and "hashpartitioning(page#" in plan and ", line#" not in plan.split("hashpartitioning(")[1].split(")")[0]


def test_pages_without_a_character(spark):
    """Nothing is divided by the length of an empty page."""
    rows = [(1, 1, 1, "", 50), (2, 1, 1, None, 50), (3, 1, 1, "", 50), (3, 2, 1, "a1", None), (4, 1, 1, "", 7), (4, 1, 2, "b", 9), (None, 1, 1, "c", 8)]
    got = {r["page"]: (r["text"], str(r["mean_confidence"]), r["reasons"]) for r in V.ocr_triage(spark.createDataFrame(rows, "page long, line long, pos int, word string, confidence int")).collect()}
    assert got == {1: ("", "nan", "short"), 2: ("", "None", "short"), 3: ("\na1", "0.0", "low confidence,short,numbers"), 4: (" b", "9.0", "low confidence,short"), None: ("c", "8.0", "low confidence,short")}


def test_runs_of_words_meet_in_order(spark):
    """In any order, with places that are there twice and words with spaces, over several batches."""
    rng = random.Random(4)
    rows = [(page, line, pos, rng.choice(["", "a", "b c", "d", None]), float(pos)) for page in range(40) for line in range(rng.randrange(1, 5)) for pos in rng.choices(range(30), k=rng.randrange(1, 40))]
    rows += [(99, line, pos, f"w{pos}", 1.0) for line in range(30) for pos in range(400)]
    want = {}
    for page in {r[0] for r in rows}:
        lines = {}
        for _, line, pos, word, _ in sorted((r for r in rows if r[0] == page), key=lambda r: (r[1], r[3] is None, r[2], r[3] or "")):
            lines.setdefault(line, []).append(word)
        text = "\n".join(" ".join(w for w in line if w is not None) for line in lines.values())
        size = sum(len(r[3] or "") for r in rows if r[0] == page)
        want[page] = (text, round(sum(r[4] * len(r[3] or "") for r in rows if r[0] == page) / size, 6))
    for mixed in (False, True):
        if mixed:
            rng.shuffle(rows)
        out = V.ocr_triage(spark.createDataFrame(rows, "page long, line int, pos int, word string, confidence double").repartition(1 + mixed))
        assert {r["page"]: (r["text"], r["mean_confidence"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow _word_runs" in plan
