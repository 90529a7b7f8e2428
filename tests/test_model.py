"""Each rule of the book model with a planted violation."""

import pytest

from quire.operators import model as M

NODES = "doc long, id string, preorder int, subtree_end int, parent string, ordinal int, kind string, children array<string>"
#: A root with a paragraph (two texts) and an empty element.
SOUND = [(1, "r", 0, 4, None, None, "element", ["p", "e"]), (1, "p", 1, 3, "r", 0, "element", ["a", "b"]), (1, "a", 2, 2, "p", 0, "text", None), (1, "b", 3, 3, "p", 1, "text", []), (1, "e", 4, 4, "r", 1, "element", [])]


def found(df):
    return sorted(map(tuple, df.collect()))


def trees(spark, rows):
    return found(M.check_trees(spark.createDataFrame(rows, NODES)))


@pytest.mark.parametrize(
    "at, change, want",
    [
        (None, {}, []),
        (2, {3: 3}, [("interval", "a"), ("siblings", "b")]),
        (1, {3: 9}, [("interval", "p"), ("outside its parent", "p"), ("siblings", "e")]),
        (1, {3: 2}, [("outside its parent", "b"), ("siblings", "e")]),
        (4, {4: "zz"}, [("child names another", "r:e"), ("parent", "e")]),
        (4, {4: None}, [("child names another", "r:e"), ("roots", "1")]),
        (2, {5: 1}, [("child names another", "p:a"), ("parent names another", "a")]),
        (1, {6: "text"}, [("interval", "p"), ("parent is no element", "a"), ("parent is no element", "b")]),
        (4, {2: 5, 3: 5}, [("interval", "e"), ("outside its parent", "e"), ("places", "1"), ("siblings", "e")]),
        (0, {7: ["p", "e", "x"]}, [("child names another", "r:x")]),
        (4, {1: "a"}, [("child names another", "r:e"), ("node twice", "a"), ("parent names another", "a")]),
    ],
)
def test_trees(spark, at, change, want):
    rows = [tuple(change.get(k, v) if i == at else v for k, v in enumerate(row)) for i, row in enumerate(SOUND)]
    assert trees(spark, rows) == want


def test_references_fields_and_editions(spark):
    entities = spark.createDataFrame([(1, 10, "recipe"), (2, 10, "part"), (3, 11, "recipe")], "id long, edition long, kind string")
    refs = [("ok", 10, 1, "recipe"), ("none", 10, None, "recipe"), ("gone", 10, 9, "recipe"), ("far", 10, 3, "recipe"), ("kind", 10, 2, "recipe")]
    frame = spark.createDataFrame(refs, "reference string, edition long, target long, kind string")
    assert found(M.check_references(frame, entities)) == [("no target", "gone"), ("target in another edition", "far"), ("target of another kind", "kind")]
    fields = [("a", "supported", "x", ["s"], None), ("b", "supported", None, ["s"], None), ("c", "candidate", "x", [], None), ("d", "absent", None, None, "not printed"), ("e", "absent", "x", None, "y"), ("f", None, None, None, " ")]
    frame = spark.createDataFrame(fields, "field string, state string, value string, evidence array<string>, reason string")
    assert found(M.check_fields(frame)) == [("no evidence", "c"), ("no reason", "f"), ("value and state", "b"), ("value and state", "e")]
    ours, theirs = (spark.createDataFrame(x, "edition long, source string") for x in ([(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, "z"), (4, "d")]))
    assert found(M.check_editions(ours, theirs)) == [("another source", "2"), ("not in the model", "4"), ("not published", "3")]


def test_nothing(spark):
    assert trees(spark, []) == []
