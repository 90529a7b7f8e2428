"""Repair of conversation structure: the cheapest edits that make roles take turns.

Each row of a conversation is kept, given another role or deleted, and rows
without a text may be inserted before it or at the end, so that the roles spell
`(s?(ua)+)?`. Among the cheapest edits the audit, their letters in order, is the
least in ASCII order.

One integer holds both: high digits carry the cost, below them every letter has
its own digit, first letter highest, and places after the last letter are zero.
The least integer is the cheapest edit with the least audit, so the minimum of
plain integers over a DAG of (row, place in the pattern) decides everything.

A conversation may be of any length. Rows are sorted once over the cluster and
numbered in that order; blocks of `block` rows are solved each by itself, a
conversation inside a block whole. A conversation that reaches a block's edge is
solved there from every place in the pattern to every other (16 integers). Over
the same rows no audit is a proper prefix of another of equal cost, as insertions
come before a row; so the integers can be replaced by cost and rank, and tables
of neighbouring blocks joined to one table of the same size. Tables are joined
`fan` at a time, level by level, and the way back down gives each block its first
and last place. No task holds a conversation; only its sha256, which is sequential, is
read in order by one task, a batch of rows at a time.

Faults: a row is blank (no word), else a duplicate (role and text were seen
earlier), else truncated (its last character that isn't a space is no end of
a sentence). Blank and duplicate rows must be deleted; a truncated one that is
kept or given another role costs more.

Defined results: a null role or text counts as one space, so a null text is
blank and a null role is a role that no pattern has; null turns come first and
are left out of the gaps; rows of one turn are ordered by role and the md5 of the text; rows
that repeat conversation, turn, role and text are duplicates of the first; a
null conv_id is one conversation; texts of any length are read whole; an empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Places in the pattern: nothing yet, after s, after u, after a. Where a kept initial leads from each, and the role that R and I give there.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GIVEN = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
START, ENDS = 0, (0, 3)
PLACES = range(len(KEPT))
#: Digits of the letters, in ASCII order; zero is the padding.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {v: k for k, v in DIGITS.items()}
BITS = 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
Entry = tuple[int, int] | None
Table = list[list[Entry]]


@dataclass(frozen=True)
class Repair:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    #: Rows of a block, and tables that are joined at once.
    block: int = 512
    fan: int = 256


# --- one block ----------------------------------------------------------------------


def steps(initial: str, fault: int, p: Repair) -> list[list[tuple[int, int, str]]]:
    """From each place: (cost, next place, letters) of the ways to deal with a row, an insertion before it or not."""
    extra = p.truncated if fault == TRUNCATED else 0
    plain: list[list[tuple[int, int, str]]] = []
    for place in PLACES:
        ways = [(p.delete, place, "D")]
        if fault not in (BLANK, DUPLICATE):
            ways.append((p.rerole + extra, GIVEN[place][0], "R"))
            if initial in KEPT[place]:
                ways.append((extra, KEPT[place][initial], "K"))
        plain.append(ways)
    return [ways + [(p.insert + c, to, "I" + x) for c, to, x in plain[GIVEN[place][0]]] for place, ways in enumerate(plain)]


def weights(initials: str, faults: str, first: int, last: bool, p: Repair) -> tuple[list[tuple[int, int] | None], int]:
    """For each place after the rows the least integer of the edits that lead there from `first`, with its number of letters, and the number of low bits.

    last: nothing follows, so rows may be inserted at the end too.
    """
    width = BITS * 2 * (len(initials) + 1)
    now: list[tuple[int, int] | None] = [(0, 0) if place == first else None for place in PLACES]
    known: dict[tuple[str, str], list[list[tuple[int, int, str]]]] = {}
    for row in zip(initials, faults):
        ways = known.get(row) or known.setdefault(row, steps(row[0], int(row[1]), p))
        after: list[tuple[int, int] | None] = [None] * len(PLACES)
        for place, had in enumerate(now):
            if had is None:
                continue
            for cost, to, letters in ways[place]:
                value, n = had[0] + (cost << width), had[1]
                for x in letters:
                    n += 1
                    value += DIGITS[x] << (width - BITS * n)
                if after[to] is None or value < after[to][0]:
                    after[to] = value, n
        now = after
    if last:
        after = list(now)
        for place, had in enumerate(now):
            to = GIVEN[place][0]
            if had is not None:
                value = had[0] + (p.insert << width) + (DIGITS["I"] << (width - BITS * (had[1] + 1)))
                if after[to] is None or value < after[to][0]:
                    after[to] = value, had[1] + 1
        now = after
    return now, width


def letters_of(value: int, n: int, width: int) -> str:
    return "".join(LETTERS[value >> (width - BITS * k) & 7] for k in range(1, n + 1))


def solve(initials: str, faults: str, p: Repair) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    found, width = weights(initials, faults, START, True, p)
    value, n = min(found[place] for place in ENDS if found[place])
    return value >> width, letters_of(value, n, width)


def audit_between(initials: str, faults: str, first: int, to: int, last: bool, p: Repair) -> str:
    found, width = weights(initials, faults, first, last, p)
    return letters_of(*found[to], width)


# --- tables of a block ----------------------------------------------------------------


def ranked(values: list[list[tuple | None]]) -> Table:
    """(cost, rank) for (cost, what orders the audits): equal audits have equal ranks."""
    order = {x: i for i, x in enumerate(sorted({v[1] for row in values for v in row if v}))}
    return [[(v[0], order[v[1]]) if v else None for v in row] for row in values]


def block_table(initials: str, faults: str, last: bool, p: Repair) -> Table:
    rows = []
    for first in PLACES:
        found, width = weights(initials, faults, first, last, p)
        rows.append([(v[0] >> width, v[0] & ((1 << width) - 1)) if v else None for v in found])
    return ranked(rows)


def joined(a: Table, b: Table) -> Table:
    """The table of two neighbours: audits are ordered by the first part, then by the second."""
    rows = []
    for first in PLACES:
        row: list[tuple | None] = []
        for to in PLACES:
            ways = [(x[0] + y[0], (x[1], y[1])) for x, y in ((a[first][m], b[m][to]) for m in PLACES) if x and y]
            row.append(min(ways, default=None))
        rows.append(row)
    return ranked(rows)


def way_through(tables: list[Table], first: int, ends: tuple[int, ...]) -> list[int]:
    """The place after each table on the least way from `first` to one of `ends`."""
    at: list[tuple | None] = [(0, 0) if place == first else None for place in PLACES]
    back: list[list[int]] = []
    for table in tables:
        after, came = [], []
        for to in PLACES:
            ways = [((at[m][0] + table[m][to][0], (at[m][1], table[m][to][1])), m) for m in PLACES if at[m] and table[m][to]]
            best = min(ways, default=(None, -1))
            after.append(best[0])
            came.append(best[1])
        at = ranked([after])[0]
        back.append(came)
    place = min((at[e], e) for e in ends if at[e])[1]
    way = []
    for came in reversed(back):
        way.append(place)
        place = came[place]
    return way[::-1]


def packed(table: Table) -> list[int]:
    return [x for row in table for v in row for x in (v or (-1, -1))]


def unpacked(flat: list[int]) -> Table:
    n = len(PLACES)
    pairs = list(zip(flat[::2], flat[1::2]))
    return [[v if v[0] >= 0 else None for v in pairs[i * n : (i + 1) * n]] for i in range(n)]


# --- rows -----------------------------------------------------------------------------


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The rows with `at`, a number that grows with conversation, turn, role and the md5 of the text over the whole table.

    Ranges cut long conversations too; rows that are equal in all columns are dealt by a hash of where they were.
    """
    marked = rows.withColumn("__tie", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()))
    marked = marked.withColumn("__text", F.md5(F.col("text").cast("binary")))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "__text", "__tie"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie", "__text").withColumn("at", F.monotonically_increasing_id())


def faults_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, conv_id, initial, fault without duplicates), and the `at` of rows whose role and text were not seen earlier in the conversation."""
    word, ended = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
    own = F.when(~F.col("text").rlike(word), BLANK).when(~F.col("text").rlike(ended), TRUNCATED).otherwise(FINE)
    light = rows.select("at", "conv_id", F.substring("role", 1, 1).alias("initial"), own.alias("fault"))
    said = F.sha2(F.concat_ws("\x1f", F.length("role"), "role", "text").cast("binary"), 256)
    first = rows.groupBy("conv_id", said.alias("said")).agg(F.min("at").alias("at")).select("at")
    return light, first


def _solve_blocks(batches: Iterator[pa.RecordBatch], p: Repair, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Conversations inside a block with their audit; those at its first or last row with what later steps need."""
    for batch in batches:
        out: list[tuple] = []
        for block, rows, first in zip(*(batch.column(c).to_pylist() for c in ("block", "rows", "first"))):
            rows.sort(key=lambda r: r["at"])
            fresh, start = set(first), 0
            for r in rows:
                if r["fault"] != BLANK and r["at"] not in fresh:
                    r["fault"] = DUPLICATE
            for end in range(1, len(rows) + 1):
                if end < len(rows) and rows[end]["conv_id"] == rows[start]["conv_id"]:
                    continue
                own = rows[start:end]
                initials, marks = "".join(r["initial"] or " " for r in own), "".join(str(r["fault"]) for r in own)
                counts = [marks.count(str(f)) for f in (BLANK, DUPLICATE, TRUNCATED)]
                edge = start == 0 or end == len(rows)
                cost, audit = (None, None) if edge else solve(initials, marks, p)
                out.append((own[0]["conv_id"], block, own[0]["at"], *counts, edge, cost, audit, initials if edge else None, marks if edge else None))
                start = end
        columns = list(zip(*out)) if out else [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _per_row(rows: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    """Columns of `run`'s answer for each row's values, a batch at a time."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    form = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, schema.split(", "))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [run(*values) for values in zip(*(batch.column(c).to_pylist() for c in columns))]
            made = list(zip(*out)) if out else [()] * len(form)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(made, form)], schema=form)

    return rows.select(*columns).mapInArrow(go, schema)


def places(edges: DataFrame, p: Repair, scratch: Scratch) -> DataFrame:
    """conv_id, block, first, to, cost: where the least way enters and leaves each conversation's part of a block, and what the part costs.

    edges: conv_id, block, initials, faults, last.
    """
    table = lambda conv, block, initials, faults, last: (conv, block, packed(block_table(initials, faults, last, p)))
    level = scratch.settle(_per_row(edges, ["conv_id", "block", "initials", "faults", "last"], table, "conv_id long, k long, tab array<long>"))
    levels = [level]

    def join_all(conv, k, parts):
        tables = [unpacked(t["tab"]) for t in sorted(parts, key=lambda t: t["k"])]
        whole = tables[0]
        for t in tables[1:]:
            whole = joined(whole, t)
        return conv, k, packed(whole)

    # Blocks of a conversation count from its first, `fan` of them make one of the next level, until each conversation has one.
    most = lambda df: df.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"] or 0
    while most(levels[-1]) > p.fan:
        packs = levels[-1].groupBy("conv_id", F.floor(F.col("k") / p.fan).alias("k")).agg(F.collect_list(F.struct("k", "tab")).alias("parts"))
        levels.append(scratch.settle(_per_row(packs, ["conv_id", "k", "parts"], join_all, "conv_id long, k long, tab array<long>")))
    # From the top down: the ways into and out of each part.
    wanted = levels[-1].groupBy("conv_id").agg(F.collect_list(F.struct("k", "tab")).alias("parts")).withColumns({"first": F.lit(START), "to": F.lit(-1)})

    def descend(conv, parts, first, to):
        parts.sort(key=lambda t: t["k"])
        tables = [unpacked(t["tab"]) for t in parts]
        way = way_through(tables, first, ENDS if to < 0 else (to,))
        starts = [first, *way[:-1]]
        return conv, [t["k"] for t in parts], starts, way, [t[a][b][0] for t, a, b in zip(tables, starts, way)]

    for depth in range(len(levels) - 1, -1, -1):
        flat = _per_row(wanted, ["conv_id", "parts", "first", "to"], descend, "conv_id long, k array<long>, first array<int>, to array<int>, cost array<long>")
        found = scratch.settle(flat.select("conv_id", F.explode(F.arrays_zip("k", "first", "to", "cost")).alias("x")).select("conv_id", "x.*"))
        if depth:
            below = levels[depth - 1].groupBy("conv_id", F.floor(F.col("k") / p.fan).alias("k")).agg(F.collect_list(F.struct("k", "tab")).alias("parts"))
            wanted = below.join(found.select(F.col("conv_id").alias("c"), F.col("k").alias("kk"), "first", "to"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("k") == F.col("kk")))
    return found.withColumnRenamed("k", "block")


def edits(rows: DataFrame, p: Repair, scratch: Scratch) -> DataFrame:
    """conv_id, at (of its first row), first place, audit, cost, blank, duplicate, truncated: of each conversation, or of its part in a block."""
    light, first = faults_of(rows)
    block = lambda at: F.floor(at / p.block)
    row = F.struct("at", "conv_id", "initial", "fault")
    both = light.select(block(F.col("at")).alias("block"), row.alias("row"), F.lit(None).cast("long").alias("seen")).unionByName(
        first.select(block(F.col("at")).alias("block"), F.lit(None).cast(light.select(row.alias("x")).schema["x"].dataType).alias("row"), F.col("at").alias("seen"))
    )
    packs = both.groupBy("block").agg(F.collect_list("row").alias("rows"), F.collect_list("seen").alias("first"))
    columns = "conv_id long, block long, at long, blank long, duplicate long, truncated long, edge boolean, cost long, audit string, initials string, faults string"
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in columns.split(", "))])
    parts = scratch.settle(packs.mapInArrow(lambda it: _solve_blocks(it, p, schema), columns))
    names = ["conv_id", "at", "first", "audit", "cost", "blank", "duplicate", "truncated"]
    whole = parts.where("not edge").withColumn("first", F.lit(START)).select(*names)
    # The last part of each conversation may insert at the end.
    final = parts.where("edge").groupBy("conv_id").agg(F.max("block").alias("block")).withColumn("last", F.lit(True))
    edges = parts.where("edge").alias("p").join(final.alias("f"), F.expr("p.conv_id <=> f.conv_id and p.block = f.block"), "left").select("p.*", F.coalesce("f.last", F.lit(False)).alias("last"))
    edges = scratch.settle(edges)
    ways = places(edges.select("conv_id", "block", "initials", "faults", "last"), p, scratch)
    met = edges.drop("cost", "audit").alias("e").join(ways.alias("w"), F.expr("e.conv_id <=> w.conv_id and e.block = w.block")).select("e.*", "w.first", "w.to", "w.cost")
    carried = ["conv_id", "at", "first", "cost", "blank", "duplicate", "truncated"]

    def again(*values):
        *rest, initials, faults, to, last = values
        return (*rest, audit_between(initials, faults, rest[2], to, last, p))

    kinds = "conv_id long, at long, first int, cost long, blank long, duplicate long, truncated long, audit string"
    return whole.unionByName(_per_row(met, [*carried, "initials", "faults", "to", "last"], again, kinds))


# --- the repaired conversations ---------------------------------------------------------


class _Reading:
    """One conversation, row by row in order: counts, audit and the digest of what is left."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.cost, self.audits = conv_id, [0, 0, 0], 0, []
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.before, self.illegal, self.place, self.rows = "", 0, START, 0
        self.digest, self.any = hashlib.sha256(), False
        self.letters: list[str] = []

    def part(self, first: int, audit: str, cost: int, counts: tuple[int, ...]) -> None:
        self.finish()
        self.letters, self.place = list(reversed(audit)), first
        self.audits.append(audit)
        self.cost += cost
        self.counts = [a + b for a, b in zip(self.counts, counts)]

    def say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def insert(self) -> None:
        self.place, role = GIVEN[self.place]
        self.say(role, "")

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1] or " "
        self.illegal += self.rows > 0 and self.before + initial not in ("su", "ua", "au")
        self.before, self.rows = initial, self.rows + 1
        while (letter := self.letters.pop()) == "I":
            self.insert()
        if letter == "K":
            self.place = KEPT[self.place][initial]
            self.say(role, text)
        elif letter == "R":
            self.place, role = GIVEN[self.place]
            self.say(role, text)

    def finish(self) -> None:
        """Insertions after the last row of a part."""
        while self.letters:
            self.letters.pop()
            self.insert()

    def result(self) -> tuple:
        self.finish()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts, self.illegal, self.cost, "".join(self.audits), self.digest.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])
    now: _Reading | None = None
    done: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for conv, kind, turn, role, text, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "part"))):
            if now is None or now.conv_id != conv:
                if now:
                    done.append(now.result())
                now = _Reading(conv)
            if kind == 1:
                now.part(part["first"], part["audit"], part["cost"], (part["blank"], part["duplicate"], part["truncated"]))
            elif kind == 2:
                now.row(turn, role, text)
        if done:
            yield batch_of(done)
            done = []
    if now:
        yield batch_of([now.result()])


def repair(conversations: DataFrame, params: Repair = Repair(), everyone: DataFrame | None = None) -> DataFrame:
    """RESULT's columns, a row per conversation. everyone: conv_ids that may have no row at all."""
    p, scratch = params, Scratch(conversations.sparkSession, "repair")
    source = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    rows = scratch.settle(sorted_rows(source))
    parts = edits(rows, p, scratch)
    part = F.struct("first", "audit", "cost", "blank", "duplicate", "truncated")
    nothing = lambda name, like: F.lit(None).cast(like).alias(name)
    told = parts.select("conv_id", "at", F.lit(1).alias("kind"), nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"), part.alias("part"))
    said = rows.select("conv_id", "at", F.lit(2).alias("kind"), "turn", "role", "text", nothing("part", told.schema["part"].dataType))
    stream = told.unionByName(said)
    if everyone is not None:
        ids = everyone.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        stream = stream.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), nothing("turn", "long"), nothing("role", "string"), nothing("text", "string"), nothing("part", told.schema["part"].dataType)))
    in_order = stream.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")
    return in_order.mapInArrow(_read, RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by h, the crc32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes the ends of sentences from it, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
