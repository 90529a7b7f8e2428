"""Small golden cases for operators that SQL doesn't cover."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.functions.html import capture, capture_nodes
from quire.functions.text import phrase_form, strip_accents
from quire.operators import recipes as R
from quire.operators import reports as P
from quire.operators import search as S
from quire.operators import structure as D

PAGE = '<h1 id="beans">Beans</h1><p>Serve with <em>cold</em> glass water.</p><table><tr><td rowspan="2">2 tbsp<td>Beans</tr><tr><td>Salt</td></tr></table><p>αβ🍲 &amp; beans'


def test_capture_nests_and_keeps_text():
    rows = capture(7, PAGE)
    by_id = {r[1]: r for r in rows}
    assert "".join(r[12] for r in rows if r[6] == "text") == "BeansServe with cold glass water.2 tbspBeansSaltαβ🍲 & beans"
    for r in rows:
        if r[2]:
            parent = by_id[r[2]]
            assert parent[4] < r[4] <= r[5] <= parent[5]
    assert [r[7] for r in rows if r[7] in ("td", "tr")] == ["tr", "td", "td", "tr", "td"]


def test_capture_of_nothing(spark):
    pages = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    assert capture_nodes(pages).count() == 0


def test_intervals(spark):
    nodes = capture_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    blocks = D.outer_blocks(nodes, F.coalesce(F.col("tag").isin("h1", "p", "table", "td"), F.lit(False)))
    assert [r.tag for r in blocks.orderBy("preorder").collect()] == ["h1", "p", "table", "p"]
    inside = D.mark_inside(nodes, F.coalesce(F.col("tag") == "table", F.lit(False))).where("inside and kind = 'text'")
    assert sorted(r.text for r in inside.collect()) == ["2 tbsp", "Beans", "Salt"]
    context = D.last_boundary(nodes, F.coalesce(F.col("tag") == "h1", F.lit(False)), F.col("anchor")).where("tag = 'p'")
    assert {r.context for r in context.collect()} == {"beans"}


def test_span_text(spark):
    nodes = capture_nodes(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    ids = {r.text: r.id for r in nodes.where("text is not null").collect()}
    parts = spark.createDataFrame(
        [("s", 0, ids["Serve with "], 6, ids[" glass water."], 6), ("s", 1, ids["Salt"], 0, ids["Salt"], 4), ("bad", 0, ids["Salt"], 0, ids["Beans"], 1)],
        "span string, part int, start_node string, start_offset int, end_node string, end_offset int",
    )
    bounds, violations = D.span_bounds(parts, nodes)
    assert [(r.span, r.text) for r in D.span_text(bounds, nodes).collect()] == [("s", "with cold glass\nSalt")]
    assert [(r.span, r.reason) for r in violations.collect()] == [("bad", "reversed")]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("1½ cups beans, rinsed", (3, 2, "cups", "beans", "rinsed")),
        ("¼ cup beans", (1, 4, "cup", "beans", None)),
        ("1 1/2 cups water", (3, 2, "cups", "water", None)),
        ("0.75 kg flour", (3, 4, "kg", "flour", None)),
        ("3 eggs", (3, 1, None, "eggs", None)),
        *[(x, (None,) * 5) for x in ("1 cup (120 g) flour", "1 to 2 cups flour", "1 cup plus 2 tbsp flour", "½ cup / 120 ml water", "Salt to taste", "2 (8-ounce) cans tomatoes", "1/0 cup air", "")],
    ],
)
def test_ingredients(spark, line, expected):
    row = R.parse_ingredients(spark.createDataFrame([(line,)], "line string"), "line").first()
    assert tuple(row)[1:] == expected


def test_phrases(spark):
    row = spark.createDataFrame([("1½  Cups – “Crème” ’",)], "t string").select(phrase_form(F.col("t")).alias("p"), strip_accents("t").alias("s")).first()
    assert row.p == "1 1/2 cups - “crème” '"
    assert row.s == "1½  Cups – “Creme” ’"


def test_rolling_limit_ignores_refused(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(minutes=20 * i)) for i in range(7)]
    out = P.rolling_limit(spark.createDataFrame(rows, "user long, id long, at timestamp"), "user", most=2, seconds=3600)
    assert [r.admitted for r in out.orderBy("id").collect()] == [True, True, False, True, True, False, True]


def test_corrections_fold_in_order(spark):
    texts = spark.createDataFrame([(1, "2 g salt, 2 g salt"), (2, "one two")], "unit long, text string")
    ledger = spark.createDataFrame(
        [(1, 1, 1, "2 g", "3 g"), (2, 2, 3, "three", "four"), (2, 1, 2, "two", "three"), (2, 3, 4, "gone", "x")], "unit long, decided_at long, id long, from_text string, to_text string"
    )
    out = {(r.unit, r.id): (r.outcome, r.text) for r in P.apply_in_order(texts, ledger).collect()}
    assert out[(1, 1)][0] == "ambiguous" and out[(2, 2)][0] == "applied" and out[(2, 3)][0] == "applied" and out[(2, 4)][0] == "stale"
    assert out[(2, None)] == ("text", "one four")


def test_search_wants_the_words_after_the_fortieth(spark):
    words = [f"w{i}" for i in range(45)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40])), (3, "other")], "doc long, text string")
    queries = spark.createDataFrame([(7, " ".join(words))], "query_id long, query string")
    index = S.build_index(docs)
    assert [r.doc for r in S.search(queries, index, None, limit=10).collect()] == [1]
    assert sorted(r.doc for r in S.search_any(queries, index, [], limit=10).collect()) == [1, 2]
    assert S.query_terms(queries).count() == 45
