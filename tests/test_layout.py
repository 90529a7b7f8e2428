"""Golden cases and brute force for blocks, navigation and boundary proposals."""

import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from quire.functions.html import capture_nodes, nav_entries, navigation
from quire.operators import boundaries as B
from quire.operators import layout as L

DOCS = [
    "<html><head><title>T</title></head><body id='top'>Loose <b>and bold</b><div><h2 id='a'>Beans <i id='b'>hot</i></h2><ul><li id='c'><p>One</p> two</li></ul><script>x &lt; 1</script></div>tail<p></p></body></html>",
    "<div><p>Only  this</p> rest <style>p{}</style><table><tr><td><p id='q'>cell</p></td></tr></table></div>",
]


def walked(html, targets):
    """The same blocks by a walk over an XML tree."""
    root, out = ET.fromstring(html), []
    body = root.find(".//body")

    def text(e):
        return "" if e.tag in ("script", "style") else (e.text or "") + "".join(text(c) + (c.tail or "") for c in e)

    def walk(e):
        if e.tag in ("script", "style"):
            return
        if e.get("id") in targets:
            out.append(("anchor", e.get("id"), ""))
        if e.tag in L.LEAVES:
            out.append((e.tag, e.get("id"), " ".join(text(e).split())))
            return
        for t, c in [(e.text, None)] + [(c.tail, c) for c in e]:
            if c is not None:
                walk(c)
            if t and t.strip():
                out.append(("text", None, " ".join(t.split())))

    walk(root if body is None else body)
    return out


def test_leaf_blocks_equal_a_walk(spark):
    nodes = capture_nodes(spark.createDataFrame([(i, d) for i, d in enumerate(DOCS)] + [(7, None), (8, "")], "page_id long, html string"))
    targets = ["top", "a", "b", "c", "q", "none"]
    found = L.leaf_blocks(nodes, spark.createDataFrame([(i, t) for i in range(3) for t in targets + targets], "doc long, anchor string"))
    rows = found.orderBy("doc", "i").collect()
    for i, html in enumerate(DOCS):
        assert [(r.tag, r.id, r.text) for r in rows if r.doc == i] == walked(html, targets)
    assert {r.doc for r in rows} == {0, 1}


NAV = (
    '<nav epub:type="toc"><ol><li><a href="a.html#x">One</a><ol><li><a href="b.html">Two <b>b</b></a></li><li><span>Part</span><ol><li><span>Deep</span></li></ol></li></ol></li><li>no entry<ol><li><span>In</span></li></ol></li></ol></nav>'
    '<nav epub:type="page-list"><li><span>Group</span><ol><li><a href="p#1">1</a></li></ol></li></nav><ul><li><a href="z">not here</a></li></ul>'
)
NCX = '<navMap><navPoint id="n"><navLabel><text>Top</text></navLabel><content src="t.html"/><navPoint><navLabel><text>Sub</text></navLabel></navPoint></navPoint></navMap>'


def test_navigation(spark):
    rows = nav_entries(1, NAV)
    name = {r[2]: r[5] for r in rows}
    assert [(r[4], r[5], r[6], name.get(r[3])) for r in rows] == [
        ("toc", "One", "a.html#x", None), ("toc", "Two b", "b.html", "One"), ("toc", "Part", "", "One"), ("toc", "Deep", "", "Part"), ("toc", "In", "", None),
        ("page_list", "1", "p#1", None), ("page_list", "1", "p#1", "1"),
    ]
    ncx = nav_entries(2, NCX)
    assert [(r[4], r[5], r[6], r[3]) for r in ncx] == [("ncx", "Top", "t.html", None), ("ncx", "Sub", "", ncx[0][2])]
    assert navigation(spark.createDataFrame([(1, None), (2, "<p>x</p>")], "page_id long, html string")).count() == 0


def test_profile_blocks(spark):
    html = (
        '<div class="t">A<p>inner</p></div><div class="u"><p class="x"><span class="big">Whole</span></p><p><span class="big">Half</span> more</p></div>'
        '<table><tr class="r"><td class="amt">2</td><td>cups</td></tr></table><li><p>nested</p></li><p>  </p>'
    )
    nodes = capture_nodes(spark.createDataFrame([(1, html), (2, html)], "page_id long, html string")).withColumn("book", F.col("doc"))
    rules = [(1, "title", "t"), (1, "ingredient", "table-r"), (1, "title_inline", "big")]
    rows = L.profile_blocks(nodes, spark.createDataFrame(rules, "book long, rule string, class string")).orderBy("doc", "pos").collect()
    assert [(r.tag, r.classes, r.text) for r in rows if r.doc == 1] == [
        ("div", ["t"], "Ainner"), ("p", ["authored-inline-title", "x"], "Whole"), ("p", [], "Half more"), ("tr", ["amt", "r"], "2 cups"), ("li", [], "nested"),
    ]
    assert [r.text for r in rows if r.doc == 2] == ["inner", "Whole", "Half more", "nested"]


def _page(spark, pages, kinds=None):
    """Lines (x0, y0, x1, y1, text, kind) by page, a block for each."""
    lines, blocks = [], []
    for page, rows in pages.items():
        for x0, y0, x1, y1, text, kind in rows:
            n = len(lines) + 1
            lines.append((1, page, n, n, x0, y0, x1, y1, 100, 200, text))
            if kind:
                blocks.append((1, n, kind, None, [n], []))
    schema = "edition long, page long, line long, rank long, x0 int, y0 int, x1 int, y1 int, width int, height int, text string"
    return spark.createDataFrame(lines, schema), spark.createDataFrame(blocks, "edition long, block long, kind string, marker string, line_ids array<long>, children array<long>")


RECIPE = [(5, 10, 45, 18, "Beans", "title"), (5, 20, 45, 28, "2 cups beans", "text"), (5, 30, 45, 38, "½ cup water", "text"), (5, 40, 45, 48, "1. Soak", "text"), (5, 50, 45, 58, "2. Boil", "text")]


def _proposed(spark, pages):
    rows, links = B.propose_boundaries(*_page(spark, pages))
    return [(r.kind, r.line_ids) for r in rows.orderBy("selection").collect()], [(r.selection, r.from_page, r.to_page, r.line_ids) for r in links.orderBy("from_page").collect()]


def test_steps_go_on_overleaf(spark):
    more = lambda a, b: [(5, 10, 45, 18, f"{a}. Stir", "text"), (5, 20, 45, 28, f"{b}. Serve", "text")]
    rows, links = _proposed(spark, {1: RECIPE, 2: more(3, 4), 3: more(5, 6), 5: more(7, 8)})
    assert rows == [("recipe", [1, 2, 3, 4, 5, 6, 7, 8, 9]), ("unclassified", [10, 11])]
    assert links == [(1, 1, 2, [6, 7]), (1, 2, 3, [8, 9])]
    rows, links = _proposed(spark, {1: RECIPE, 2: more(4, 5)})
    assert len(rows) == 2 and not links


def test_two_columns_and_other_lanes(spark):
    right = [(x0 + 50, y0, x1 + 50, y1, t, k) for x0, y0, x1, y1, t, k in RECIPE]
    rows, _ = _proposed(spark, {1: RECIPE + right})
    assert rows == [("recipe", [1, 2, 3, 4, 5]), ("recipe", [6, 7, 8, 9, 10])]
    # Both end with step 2, so step 3 in the left lane belongs to the left one alone; a step across both lanes to none.
    rows, links = _proposed(spark, {1: RECIPE + right, 2: [(5, 10, 45, 18, "3. Serve", "text")]})
    assert links == [(1, 1, 2, [11])]
    rows, links = _proposed(spark, {1: RECIPE + right, 2: [(30, 10, 70, 18, "3. Serve", "text")]})
    assert not links and len(rows) == 3


def test_lines_have_one_owner(spark):
    rows, _ = _proposed(spark, {1: RECIPE + [(5, 60, 45, 68, "A picture", "picture"), (5, 70, 45, 78, "nobody's", None)]})
    assert rows == [("recipe", [1, 2, 3, 4, 5]), ("unclassified", [6]), ("unclassified", [7])]
    rows, _ = _proposed(spark, {1: [(5, 10, 45, 18, "Menu", "title"), *RECIPE[1:]]})
    assert rows == [("passage", [1, 2, 3, 4, 5])]
    lines, blocks = _page(spark, {1: RECIPE})
    more = spark.createDataFrame([(1, 91, "picture", None, [1, 2, 3], [1]), (1, 92, "text", None, [5], [])], blocks.schema)
    owners = {r.line: r.block for r in B.line_owners(lines, blocks.union(more)).collect()}
    assert owners == {1: 1, 2: 2, 3: 3, 4: 4, 5: None}


def test_reasons_and_pictures(spark):
    lines, blocks = _page(spark, {1: RECIPE[:2] + [(5, 60, 45, 68, "x", "picture")], 2: RECIPE, 3: [(5, 10, 45, 18, "Beans, p. 4", "reference_entry")]})
    rows, _ = B.propose_boundaries(lines, blocks)
    assert [r.reasons for r in rows.orderBy("selection").collect()] == [
        ["fewer than two quantities", "no steps from 1 on"], ["a picture, caption, header or footer, or no single block"], ["heading, quantities and steps from 1 on"], ["marked as a reference"],
    ]
    assert [(r.edition, r.block) for r in B.unresolved_pictures(blocks).collect()] == [(1, 3)]


def test_titles_of_two_lines_and_markers(spark):
    title = [(5, 10, 45, 18, "Slow", "title"), (5, 20, 40, 28, "Beans", "title"), (5, 60, 45, 68, "Far below", "title")]
    rows, _ = _proposed(spark, {1: title})
    assert rows == [("unclassified", [1, 2]), ("unclassified", [3])]
    lines, blocks = _page(spark, {1: [*RECIPE[:3], (5, 40, 45, 48, "Soak", "text")]})
    marked = blocks.withColumn("marker", F.when(F.col("block") == 4, "1."))
    assert [r.kind for r in B.propose_boundaries(lines, marked)[0].collect()] == ["recipe"]
    assert [r.kind for r in B.propose_boundaries(lines, blocks)[0].collect()] == ["unclassified"]


def test_a_recipe_goes_on_once_a_page(spark):
    half = [(5, 10, 30, 18, "3. Stir", "text"), (60, 10, 85, 18, "3. Wait", "text")]
    rows, links = _proposed(spark, {1: RECIPE, 2: half})
    assert links == [(1, 1, 2, [6])] and rows[1] == ("unclassified", [7])


def test_no_pages(spark):
    lines, blocks = _page(spark, {1: RECIPE})
    rows, links = B.propose_boundaries(lines.limit(0), blocks.limit(0))
    assert rows.count() == links.count() == 0
