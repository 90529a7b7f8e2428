"""Queries that take whole texts, on small tables."""

import pytest

from quire import plans


@pytest.fixture()
def given(spark, tmp_path):
    def put(texts):
        rows = [(i, text, "en", "a", len(text)) for i, text in texts.items()]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return put


def test_every_line_is_corrected(spark, given):
    d = given({1: "one two three four\nlast line here\n\ntwice\ntwice"})
    rows = plans.QUERIES["cor03_apply"](spark, d).collect()
    assert [r.text for r in rows if r.outcome == "text"] == ["ONE TWO THREE FOUR\nLAST LINE HERE\n\ntwice\ntwice"]
    assert {r.id: r.outcome for r in rows if r.id is not None} == {0: "applied", 1: "applied", 2: "stale", 3: "ambiguous", 4: "ambiguous"}


def test_titles_are_whole_lines(spark, given):
    d = given({1: "Of the many breads of northern towns\nx", 2: "Of the many breads of the southern islands and hills\ny", 3: "Of the many breads of northern towns"})
    rows = plans.QUERIES["trn08_sections"](spark, d).collect()
    sections = {r.page: r.section for r in rows}
    assert sections[1] == sections[3] != sections[2]


def test_every_line_with_a_number_is_voted_on(spark, given):
    d = given({1: "no number\n3 cups of flour\nthen 12 eggs", 2: "add 4 g", 5: "add 4 g"})
    rows = plans.QUERIES["rep05_ballots"](spark, d).collect()
    votes = {(r.page, r.line, r.reader): r.vote for r in rows}
    want = {(1, 1): "current", (1, 2): "current", (2, 0): "proposed", (5, 0): "none"}
    assert votes == {(*at, f"r{k}"): vote for at, vote in want.items() for k in (1, 2, 3)}
