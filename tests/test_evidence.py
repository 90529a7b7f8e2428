"""Each rule of the layout evidence with a planted violation, on a sound page without any."""

import pytest
from pyspark.sql import functions as F

from quire.operators import evidence as E
from quire.plans.registry import shared_folder

PAGES = "page long, render struct<w: double, h: double>, source struct<w: double, h: double>, map struct<a: double, b: double, c: double, d: double, e: double, f: double>"
LINES = "page long, line long, polygon array<struct<x: double, y: double>>, confidence double"
BLOCKS = "page long, block long, line_ids array<long>, children array<long>"
TABLES = "table long, page long, block long, rows int, columns int"
CELLS = "table long, cell long, row_start int, row_end int, column_start int, column_end int, line_ids array<long>"
BOX = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (0.0, 5.0)]


@pytest.fixture(autouse=True)
def folder(spark):
    shared_folder(spark)


def found(df):
    return sorted(map(tuple, df.collect()))


def shape(spark, pages, lines):
    return found(E.geometry(spark.createDataFrame(pages, PAGES), spark.createDataFrame(lines, LINES)))


def test_geometry(spark):
    page = (1, (100.0, 50.0), (200.0, 100.0), (2.0, 0.0, 0.0, 2.0, 0.0, 0.0))
    moved = (2, (100.0, 50.0), (200.0, 100.0), (2.0, 0.0, 0.0, 2.0, 1.0, 0.0))
    flat = (3, (100.0, 50.0), (1000.0, 1000.0), (1.0, 2.0, 2.0, 4.0, 0.0, 0.0))
    whole = [(0.0, 0.0), (100.0, 0.0), (100.0, 50.0), (0.0, 50.0)]
    assert shape(spark, [page], [(1, 1, BOX, 0.5), (1, 2, whole, None), (1, 3, BOX, 1.0)]) == []
    lines = [(1, 1, [(0.0, 0.0), (101.0, 0.0), (10.0, 5.0), (0.0, 5.0)], 0.5), (1, 2, BOX[:3], 0.5), (1, 3, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], 0.5), (1, 4, BOX, 1.5), (2, 5, whole, None), (9, 6, BOX, None), (1, 7, None, None), (3, 8, BOX, None), (1, 9, [(None, 0.0), *BOX[1:]], None)]
    assert shape(spark, [page, moved, flat], lines) == [
        ("confidence", "4"), ("flat map", "3"), ("line of no page", "6"), ("no area", "3"), ("no area", "9"), ("not four corners", "2"), ("not four corners", "7"),
        ("outside the render", "1"), ("outside the render", "9"), ("outside the source", "1"), ("outside the source", "5"), ("outside the source", "9"),
    ]


def owned(spark, lines, blocks):
    return found(E.ownership(spark.createDataFrame(lines, "page long, line long"), spark.createDataFrame(blocks, BLOCKS)))


def test_ownership(spark):
    lines = [(1, 1), (1, 2), (2, 3)]
    sound = [(1, 10, [1], [11]), (1, 11, [2], []), (2, 12, [3], None)]
    assert owned(spark, lines, sound) == []
    wrong = [(1, 10, [1, 3], [11, 12]), (1, 11, None, [13]), (1, 13, [], [11, 14]), (1, 14, [], []), (2, 12, [3], [])]
    assert owned(spark, [*lines, (1, 1)], wrong) == [
        ("block names another child", "10:12"), ("block names another line", "10:3"), ("line in no block", "2"), ("line twice", "1"), ("two parents", "11"),
    ]
    ring = [(1, 20, [1, 2], [21]), (1, 21, [], [22]), (1, 22, [], [20, 23]), (1, 23, [], [24]), (1, 24, [], []), (2, 25, [3], [25])]
    assert owned(spark, lines, ring) == [("cycle", x) for x in ("20", "21", "22", "25")]


def test_deep_trees_have_no_cycle(spark):
    chain = spark.range(1, 600).select(F.col("id").alias("block"), (F.col("id") - 1).alias("parent"))
    assert E.on_cycles(chain).count() == 0
    assert E.on_cycles(chain.union(spark.createDataFrame([(0, 599)], "block long, parent long"))).count() == 600
    assert E.on_cycles(chain.limit(0)).count() == 0


def test_grids(spark):
    blocks = spark.createDataFrame([(1, 10, [1, 2, 3], []), (2, 11, [4], [])], BLOCKS)
    run = lambda tables, cells: found(E.grids(spark.createDataFrame(tables, TABLES), spark.createDataFrame(cells, CELLS), blocks))
    sound = [(5, 1, 0, 1, 0, 2, [1]), (5, 2, 1, 2, 0, 1, [2]), (5, 3, 1, 2, 1, 2, None)]
    assert run([(5, 1, 10, 2, 2)], sound) == []
    wrong = [*sound, (5, 4, 0, 2, 1, 2, [2, 4]), (5, 5, 0, 3, 0, 1, []), (5, 6, 1, 1, 0, 1, [])]
    assert run([(5, 1, 10, 2, 2), (6, 1, 11, 1, 1)], wrong) == [
        ("cell line outside the block", "4:4"), ("cell line twice", "2"), ("cells overlap", "5:0:1"), ("cells overlap", "5:1:1"), ("outside the grid", "5:5"), ("outside the grid", "5:6"), ("table of no block", "6"),
    ]
