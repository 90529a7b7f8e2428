"""Evidence of a page's layout: geometry, owned lines, the tree of blocks, the grids of tables. One row for each thing that breaks a rule.

Every rule is a filter, a count by key or an anti-join; cycles in the tree are
found by doubling the step from a block to its ancestors, so rounds grow with
the logarithm of a tree's height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Slack at the edges of the source, and the smallest determinant and area.
SLACK, FLAT_MAP, FLAT = 1e-6, 1e-12, 1e-9


def _broken(rows: DataFrame, when: Column, rule: str, *key: str) -> DataFrame:
    return rows.where(F.coalesce(when, F.lit(True))).select(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key")).distinct()


def _twice(rows: DataFrame, rule: str, *key: str) -> DataFrame:
    return _broken(rows.groupBy(*key).agg(F.count("*").alias("__n")), F.col("__n") > 1, rule, *key)


def _missing(rows: DataFrame, known: DataFrame, on: list[str], rule: str, *key: str) -> DataFrame:
    return _broken(rows.join(known.select(*on).distinct(), on, "left_anti"), F.lit(True), rule, *key)


def geometry(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Maps that are flat, and lines whose polygon lacks four corners, has no area or lies outside the render or, mapped, outside the source.

    pages: page, render(w, h), source(w, h), map(a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f.
    lines: page, line, polygon(x, y), confidence. A null number breaks the rule that needs it; lines of unknown pages break their own.
    """
    flat = _broken(pages, F.abs(F.col("map.a") * F.col("map.d") - F.col("map.b") * F.col("map.c")) <= FLAT_MAP, "flat map", "page")
    known = lines.join(pages, "page")
    inside = lambda v, top, slack=0.0: (v >= -slack) & (v <= top + slack)
    m, p = (lambda c: F.col(f"map.{c}")), (lambda c: F.col(f"polygon")[c])
    corners = F.size("polygon") == 4
    in_render = F.forall("polygon", lambda q: inside(q["x"], F.col("render.w")) & inside(q["y"], F.col("render.h")))
    mapped = lambda q: (m("a") * q["x"] + m("c") * q["y"] + m("e"), m("b") * q["x"] + m("d") * q["y"] + m("f"))
    in_source = F.forall("polygon", lambda q: inside(mapped(q)[0], F.col("source.w"), SLACK) & inside(mapped(q)[1], F.col("source.h"), SLACK))
    around = F.transform("polygon", lambda q, i: q["x"] * p((i + 1) % 4)["y"] - p((i + 1) % 4)["x"] * q["y"])
    area = F.aggregate(around, F.lit(0.0), lambda s, x: s + x)
    four = known.where(F.coalesce(corners, F.lit(False)))
    parts = [
        flat,
        _missing(lines, pages, ["page"], "line of no page", "line"),
        _broken(known, ~corners, "not four corners", "line"),
        _broken(four, ~in_render, "outside the render", "line"),
        _broken(four, ~in_source, "outside the source", "line"),
        _broken(four, F.abs(area) <= FLAT, "no area", "line"),
        _broken(lines.where("confidence is not null"), ~inside(F.col("confidence"), F.lit(1.0)), "confidence", "line"),
    ]
    return _all(parts)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def on_cycles(parents: DataFrame) -> DataFrame:
    """block: blocks that are their own ancestors, over parents(block, parent) with one parent for each block.

    In round k each block points at its ancestor 2^k steps up, or at nothing. When no more pointers end, those that are left go
    round in cycles, and what they point at are the cycles' blocks. Each round is written to the checkpoint folder.
    """
    at = parents.select("block", F.col("parent").alias("up")).where("up is not null").checkpoint()
    n = at.count()
    while n:
        at = at.join(at.select(F.col("block").alias("up"), F.col("up").alias("next")), "up").select("block", F.col("next").alias("up")).checkpoint()
        left = at.count()
        if left == n:
            break
        n = left
    return at.select(F.col("up").alias("block")).distinct()


def ownership(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines that are there twice or in no block, blocks that name lines or children that their page lacks, and children with two parents or on a cycle.

    lines: page, line. blocks: page, block, line_ids, children. Needs the checkpoint folder.
    """
    named = blocks.select("page", "block", F.explode("line_ids").alias("line"))
    child = blocks.select("page", F.col("block").alias("parent"), F.explode("children").alias("block"))
    single = child.groupBy("block").agg(F.min("parent").alias("parent"))
    parts = [
        _twice(lines, "line twice", "line"),
        _twice(blocks, "block twice", "block"),
        _missing(lines, named, ["line"], "line in no block", "line"),
        _missing(named, lines, ["page", "line"], "block names another line", "block", "line"),
        _missing(child, blocks, ["page", "block"], "block names another child", "parent", "block"),
        _twice(child, "two parents", "block"),
        _broken(on_cycles(single), F.lit(True), "cycle", "block"),
    ]
    return _all(parts)


def grids(tables: DataFrame, cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tables of no block of their page, cells outside their grid or over each other, cell lines that are there twice or not in the table's block.

    tables: table, page, block, rows, columns. cells: table, cell, row_start, row_end, column_start, column_end, line_ids.
    A cell outside its grid takes no place in it.
    """
    placed = cells.join(tables.select("table", "block", "rows", "columns"), "table")
    fits = (F.col("row_start") >= 0) & (F.col("row_start") < F.col("row_end")) & (F.col("row_end") <= F.col("rows")) & (F.col("column_start") >= 0) & (F.col("column_start") < F.col("column_end")) & (F.col("column_end") <= F.col("columns"))
    over = placed.where(fits).select("table", F.explode(F.sequence("row_start", F.col("row_end") - 1)).alias("row"), "column_start", "column_end")
    over = over.select("table", "row", F.explode(F.sequence("column_start", F.col("column_end") - 1)).alias("column"))
    held = placed.select("table", "block", "cell", F.explode("line_ids").alias("line"))
    parts = [
        _missing(tables, blocks, ["page", "block"], "table of no block", "table"),
        _twice(cells, "cell twice", "cell"),
        _broken(placed, ~fits, "outside the grid", "table", "cell"),
        _twice(over, "cells overlap", "table", "row", "column"),
        _twice(held, "cell line twice", "line"),
        _missing(held, blocks.select("block", F.explode("line_ids").alias("line")), ["block", "line"], "cell line outside the block", "cell", "line"),
    ]
    return _all(parts)
