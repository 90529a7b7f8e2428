"""Regions, ballots, allowances and sections of scanned pages, folded page by page.

Groups here are a page's readings, each a small ordered scan. Spark groups and
shuffles; inputs are sorted inside a group, so the order of rows doesn't
matter. Books and owners may be large: their pages and operations are cut into
islands or chunks first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.groups import per_group
from quire.functions.islands import CHUNK, before, meet, with_islands
from quire.functions.text import FRACTIONS, nfkc
from quire.operators.readings import alike

#: Operations in a chunk of the personal fold.
PART = 100_000


def cluster_boxes(boxes: list[tuple[str, float, float, float, float]], share: float = 0.4, pad: float = 0.02) -> list[tuple[float, ...]]:
    """Regions of (reader, l, t, r, b): boxes that overlap by a share of the smaller one are one region, kept if two readers or more drew it."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    area = lambda b: (b[3] - b[1]) * (b[4] - b[2])
    for i, a in enumerate(boxes):
        for j in range(i):
            b = boxes[j]
            over = max(0, min(a[3], b[3]) - max(a[1], b[1])) * max(0, min(a[4], b[4]) - max(a[2], b[2]))
            if over > share * max(min(area(a), area(b)), 1e-12):
                root[find(i)] = find(j)
    groups: dict[int, list] = {}
    for i, b in enumerate(boxes):
        groups.setdefault(find(i), []).append(b)
    out = []
    for g in groups.values():
        if len({b[0] for b in g}) >= 2:
            low = [max(0.0, min(b[k] for b in g) - pad) for k in (1, 2)]
            high = [min(1.0, max(b[k] for b in g) + pad) for k in (3, 4)]
            out.append(tuple(round(x, 3) for x in (*low, *high)))
    return sorted(out, key=lambda b: (b[1], b[0], b))


def cluster_regions(boxes: DataFrame) -> DataFrame:
    """page, region, l, t, r, b from boxes(page, reader, l, t, r, b)."""
    schema = "page long, region int, l double, t double, r double, b double"
    return per_group(boxes, ["page"], ["reader", "l", "t", "r", "b"], lambda g: [(i, *b) for i, b in enumerate(cluster_boxes(g))], schema)


# --- ballots ------------------------------------------------------------------------


def claim_tokens(text: Column) -> Column:
    """Words and single signs in plain lower case; a fraction after a digit is a number of its own."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), f"([0-9])([{''.join(FRACTIONS)}])", "$1 $2")
    return F.regexp_extract_all(F.lower(F.replace(nfkc(apart), F.lit("⁄"), F.lit("/"))), F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def ballots(rows: DataFrame) -> DataFrame:
    """Adds vote to rows(reading, current, proposed): which claim the reading holds as a run of tokens.

    Every place of the longer claim is looked up first, of equal ones that of the proposal. If the other
    claim also starts somewhere outside those places, or neither is there, the vote is none. A null reading is empty; an empty claim is never there.
    """
    held = rows.withColumns({"__hay": claim_tokens(F.col("reading")), "__cur": claim_tokens(F.col("current")), "__new": claim_tokens(F.col("proposed"))})
    new_first = F.size("__new") >= F.size("__cur")
    held = held.withColumns({"__first": F.when(new_first, F.col("__new")).otherwise(F.col("__cur")), "__second": F.when(new_first, F.col("__cur")).otherwise(F.col("__new"))})

    def places(claim: str) -> Column:
        ends = F.size("__hay") - F.size(claim)
        starts = F.when((F.size(claim) > 0) & (ends >= 0), F.sequence(F.lit(0), ends)).otherwise(F.array().cast("array<int>"))
        # The first token is looked at before a run is cut out.
        return F.filter(starts, lambda i: (F.get("__hay", i) == F.get(claim, F.lit(0))) & (F.slice("__hay", i + 1, F.size(claim)) == F.col(claim)))

    found = held.withColumns({"__at": places("__first"), "__other": places("__second")})
    outside = F.exists("__other", lambda j: ~F.exists("__at", lambda i: (i <= j) & (j < i + F.size("__first"))))
    name = lambda first: F.when(new_first == first, "proposed").otherwise("current")
    vote = F.when(F.size("__at") > 0, F.when(outside, "none").otherwise(name(True))).when(F.size("__other") > 0, name(False)).otherwise("none")
    return found.withColumn("vote", vote).drop("__hay", "__cur", "__new", "__first", "__second", "__at", "__other")


# --- recovery allowance ---------------------------------------------------------------


def recovery_status(attempts: DataFrame, region_limit: int = 2, page_limit: int = 6) -> DataFrame:
    """attempt, region, region_left, page_left: overlapping boxes of a page share an allowance; regions close over overlaps."""

    def fold(group: list[tuple]) -> list[tuple]:
        group = sorted(group)
        root = list(range(len(group)))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for i, (_, l, t, r, b) in enumerate(group):
            for j in range(i):
                _, l2, t2, r2, b2 = group[j]
                if min(r, r2) > max(l, l2) and min(b, b2) > max(t, t2):
                    one, two = find(i), find(j)
                    root[max(one, two)] = min(one, two)
        region = [group[find(i)][0] for i in range(len(group))]
        used = Counter(region)
        return [(x[0], g, max(0, region_limit - used[g]), max(0, page_limit - len(group))) for x, g in zip(group, region)]

    schema = "source long, page long, attempt long, region long, region_left int, page_left int"
    return per_group(attempts, ["source", "page"], ["attempt", "l", "t", "r", "b"], fold, schema).drop("source", "page")


# --- books and owners --------------------------------------------------------------------


def key_of(title: str) -> str:
    """Letters and spaces of a title, in plain lower case."""
    return " ".join(re.sub(r"[^a-z]+", " ", unicodedata.normalize("NFKD", title).casefold()).split())


def slug_of(title: str, page: int) -> str:
    """A stable name; a title without a letter or digit of ASCII is named by its page."""
    return re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()).strip("-")[:60] or f"page-{page}"


def assemble_sections(pages: DataFrame, near: int = 8) -> DataFrame:
    """book, page, section: a page continues the section of a like title within `near` pages, else opens one with a stable slug.

    Sections end at a gap of more than `near` pages, so each island between
    such gaps is scanned apart, a batch at a time, with the sections of the
    last pages as state. Slugs are numbered over the book afterwards.
    """
    rows = pages.select("book", F.col("page").cast("long").alias("page"), F.coalesce("title", F.lit("")).alias("title"))
    rows = with_islands(rows, "book", "page", near + 1)
    rows = rows.repartition("book", "island").sortWithinPartitions("book", "island", "page", "title").select("book", "island", "page", "title")
    form = to_arrow_schema(T.StructType.fromDDL("book string, page long, first long, opening long, slug string, opens boolean"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            out = []
            for book, island, page, title in zip(*(c.to_pylist() for c in batch.columns)):
                if (book, island) != here:
                    here, held = (book, island), []
                # (title key, last page, first page, number of the opening on it, slug), oldest first
                held = [s for s in held if page - s[1] <= near]
                name = key_of(title)
                found = next((i for i in range(len(held) - 1, -1, -1) if alike(held[i][0], name)), None)
                if found is None:
                    opening = held[-1][3] + 1 if held and held[-1][2] == page else 0
                    held.append((name, page, page, opening, slug_of(title, page)))
                    found = len(held) - 1
                    opens = True
                else:
                    held[found] = (held[found][0], page, *held[found][2:])
                    opens = False
                out.append((book, page, *held[found][2:], opens))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(form)], schema=form)

    linked = rows.mapInArrow(scan, "book string, page long, first long, opening long, slug string, opens boolean")
    opened = linked.where("opens").select("book", "slug", "first", "opening", F.floor(F.col("first") / (near + 1) / CHUNK).alias("chunk"))
    numbered = before(opened, ["book", "slug"], "chunk", ["first", "opening"], {"k": F.lit(1)}, F.sum).select("book", "first", "opening", "k")
    section = F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "k"))
    return meet(linked, numbered, ["book", "first", "opening"], "inner").select("book", "page", section.alias("section"))


def fold_personal(ops: DataFrame, most: int = 1000) -> DataFrame:
    """owner, seq, result, revision of save and remove operations, idempotent by operation id and fingerprint; seq is unique in an owner.

    Repeats and changes depend on the rows of one operation or one place. Only
    owners that pass the limit are scanned in order, with their places as state.
    """
    rows = ops.select("owner", "seq", "op", (F.col("kind") == "save").alias("save"), F.struct("kind", "place").alias("mark"), "place")
    rows = rows.withColumn("save", F.coalesce("save", F.lit(False)))
    bounds = ops.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("*").alias("n"))
    chunk = F.floor((F.col("seq") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.ceil(F.col("n") / PART))
    rows = rows.join(F.broadcast(bounds)).withColumn("chunk", chunk).drop("lo", "hi", "n")
    # The first of an operation counts; the others are judged by it.
    first = rows.groupBy("owner", "op").agg(F.min(F.struct("seq", "mark")).alias("f"))
    rows = meet(rows, first, ["owner", "op"], "inner")
    counts = F.col("seq") == F.col("f.seq")
    late = F.when(~counts, F.when(F.col("mark").eqNullSafe(F.col("f.mark")), "repeated").otherwise("conflict"))
    rows = rows.select("owner", "seq", "save", "place", "chunk", late.alias("late"))
    # A place is saved or not by the last counting operation on it before.
    used = rows.where("late is null")
    by_place = W.partitionBy("owner", "place").orderBy("chunk")
    ends = used.groupBy("owner", "place", "chunk").agg(F.max(F.struct("seq", "save")).alias("end"))
    ends = ends.select("owner", "place", "chunk", F.lag("end.save").over(by_place).alias("carried"))
    inside = F.coalesce(F.lag("save").over(W.partitionBy("owner", "place", "chunk").orderBy("seq")), "carried", F.lit(False))
    used = meet(used, ends, ["owner", "place", "chunk"]).withColumn("changed", (inside != F.col("save")).cast("long")).drop("carried")
    rows = used.unionByName(rows.where("late is not null").withColumn("changed", F.lit(0).cast("long")))
    step = F.when(F.col("save"), F.col("changed")).otherwise(-F.col("changed"))
    rows = before(rows, ["owner"], "chunk", ["seq"], {"revision": F.col("changed"), "size": step}, F.sum)
    over = rows.groupBy("owner").agg((F.max("size") > most).alias("over"))
    rows = meet(rows, over, ["owner"], "inner")
    result = F.coalesce("late", F.when(F.col("changed") == 1, "done").otherwise("same"))
    free = rows.where("not over").select("owner", "seq", result.alias("result"), F.col("revision").cast("int").alias("revision"))
    form = to_arrow_schema(T.StructType.fromDDL("owner long, seq long, result string, revision int"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, places, revision = (), set(), 0
        for batch in batches:
            results, revisions = [], []
            for owner, save, place, result in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if (owner,) != here:
                    here, places, revision = (owner,), set(), 0
                if result is None:
                    if save and place not in places and len(places) >= most:
                        result = "full"
                    else:
                        changed = (place not in places) == save
                        (places.add if save else places.discard)(place)
                        revision += changed
                        result = "done" if changed else "same"
                results.append(result)
                revisions.append(revision)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(results, pa.string()), pa.array(revisions, pa.int32())], schema=form)

    full = rows.where("over").select("owner", "seq", "save", "place", "late").repartition("owner").sortWithinPartitions("owner", "seq")
    return free.union(full.mapInArrow(scan, "owner long, seq long, result string, revision int"))


def budget_pages(nodes: DataFrame, most_bytes: int = 16_000, most_nodes: int = 100) -> DataFrame:
    """selection, page, node, start, end: a selection's texts in pages of bounded bytes and nodes; a long text is cut between characters."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        page = held = count = 0
        out = []
        for node, text in zip(*(rows.sort_values("node")[c] for c in ("node", "text"))):
            at, text = 0, text or ""
            while True:
                if count >= most_nodes or (held >= most_bytes):
                    page, held, count = page + 1, 0, 0
                room = most_bytes - held
                raw = text[at : at + room].encode()
                piece = raw[:room].decode(errors="ignore") if len(raw) > room else text[at : at + room]
                if not piece and at < len(text):
                    page, held, count = page + 1, 0, 0
                    continue
                out.append((*key, page, node, at, at + len(piece)))
                held, count, at = held + len(piece.encode()), count + 1, at + len(piece)
                if at >= len(text):
                    break
        return pd.DataFrame(out, columns=["selection", "page", "node", "start", "end"])

    return nodes.groupBy("selection").applyInPandas(run, "selection long, page int, node long, start int, end int")


def mark_unresolved(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """key, text: each mark (key, id, code, fragment) replaces its line: the exact one, else the first that holds it; else it is appended."""
    held = marks.groupBy(F.col("key").alias("of")).agg(F.collect_list(F.struct("id", "code", "fragment")).alias("marks"))
    rows = texts.select("key", "text").join(held, F.col("key").eqNullSafe(F.col("of")), "left").drop("of")
    form = to_arrow_schema(T.StructType.fromDDL("key long, text string"))

    def marked(text: str | None, signs: list[dict]) -> str:
        lines = (text or "").split("\n")
        for row in sorted(signs, key=lambda x: x["id"]):
            sign, fragment = f"[unresolved {row['id']}: {row['code']}]", row["fragment"]
            exact = next((i for i, x in enumerate(lines) if x == fragment), None)
            inside = next((i for i, x in enumerate(lines) if fragment and fragment in x and "[unresolved" not in x), None) if exact is None else None
            if exact is not None:
                lines[exact] = sign
            elif inside is not None:
                lines[inside] = lines[inside].replace(fragment, sign, 1)
            else:
                lines.append(sign)
        return "\n".join(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice at a time, so that its texts are few in memory.
            for at in range(0, batch.num_rows, 500):
                keys, bodies, signs = batch.slice(at, 500).columns
                done = [marked(text, found or []) for text, found in zip(bodies.to_pylist(), signs.to_pylist())]
                yield pa.RecordBatch.from_arrays([keys, pa.array(done, pa.string())], schema=form)

    return rows.mapInArrow(run, "key long, text string")


def validate_layout(cells: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """rule, key: table cells that overlap, lines that two blocks own, blocks with two parents."""
    grid = cells.select("table", F.explode(F.sequence("row_start", F.col("row_end") - 1)).alias("row"), "column_start", "column_end")
    grid = grid.select("table", "row", F.explode(F.sequence("column_start", F.col("column_end") - 1)).alias("column"))
    twice = lambda rows, by, rule, key: rows.groupBy(*by).count().where("count > 1").select(F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"))
    owned = twice(lines, ["line"], "line owned twice", ["line"])
    parents = twice(blocks.where("parent is not null").select("block", "parent").distinct(), ["block"], "two parents", ["block"])
    return twice(grid, ["table", "row", "column"], "cells overlap", ["table", "row", "column"]).unionByName(owned).unionByName(parents)


def page_ledger(pages: DataFrame, sections: DataFrame, unresolved: DataFrame) -> DataFrame:
    """A row per page with its folio, sections in order and open items."""
    ids = lambda rows, name: rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_set("id")), ",").alias(name))
    rows = pages.join(ids(sections, "sections"), "page", "left").join(ids(unresolved, "open"), "page", "left")
    return rows.select("page", "printed", F.coalesce("sections", F.lit("")).alias("sections"), F.coalesce("open", F.lit("")).alias("open"))


def adjacent_windows(pages: DataFrame) -> DataFrame:
    """book, page, text: each page with the next one, as evaluation units."""
    w = W.partitionBy("book").orderBy("page")
    after = F.lead("text").over(w)
    return pages.select("book", "page", F.concat("text", F.lit("\n"), after).alias("text")).where("text is not null")
