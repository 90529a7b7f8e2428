"""Items of a reference against pages."""

from quire.operators import review as V

PAGES = "book string, page long, before string, after string"
ITEMS = "book string, page long, item int, field string, text string, ambiguous boolean"


def matched(spark, pages, items):
    rows = V.match_items(spark.createDataFrame(pages, PAGES), spark.createDataFrame(items, ITEMS))
    return rows, {(r.page, r.item): (r.before, r.after) for r in rows.collect()}


def test_items(spark):
    pages = [("b", 1, "2 Cups  flour\nbeans\t3 oz\nwell‐ known", "3 cups flour\nbeans | 4 oz\nx"), ("b", 2, None, "")]
    items = [
        ("b", 1, 1, "amount", "2 cups flour", False), ("b", 1, 2, "cell", "beans | 3 oz", None), ("b", 1, 3, "cell", "flour | 3 oz", False), ("b", 1, 4, "text", "well-known", False), ("b", 1, 5, "text", "x", True),
        ("b", 1, 6, "continuation", "x", False), ("b", 1, 7, "cell", "column headers: Beans | 4 OZ", False), ("b", 2, 1, "text", "any", False), ("b", 2, 2, "text", None, False), ("c", 9, 1, "amount", "lost", False), ("b", 1, 8, None, "oz x", False),
    ]
    rows, got = matched(spark, pages, items)
    assert got == {(1, 1): (True, False), (1, 2): (True, False), (1, 3): (False, False), (1, 4): (True, False), (1, 7): (False, True), (2, 1): (False, False), (2, 2): (True, True), (9, 1): (False, False), (1, 8): (False, True)}
    scores = {(r.book, r.total): tuple(r)[1:-1] for r in V.item_scores(rows).collect()}
    assert scores == {("b", 0): (2, 0, 8, 4, 3, 1, 1, 0, 2, 3), ("c", 0): (1, 1, 1, 0, 0, 1, 0, 0, 0, 0), (None, 1): (3, 1, 9, 4, 3, 2, 1, 0, 2, 3)}
    log = {(r.page, r.item): r.change for r in V.transitions(rows).collect()}
    assert log == {(1, 1): "broke", (1, 2): "broke", (1, 3): "miss", (1, 4): "broke", (1, 7): "fixed", (2, 1): "miss", (9, 1): "miss", (1, 8): "fixed"}


def test_nothing(spark):
    rows, got = matched(spark, [], [])
    assert got == {} and V.transitions(rows).count() == 0
