"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least `cosine` is a
distance of at most eps = sqrt(2 - 2 cosine). They are sorted by grid cells of
side eps / `cuts` on leading principal directions and cut into blocks in that
order. A box of a block holds its extent on every leading direction and the
extent of what its vectors have outside them; two blocks meet only if these
come within eps. Inside a task two sequences are halved again and again: each
pair of sequences is sorted along the line between its means, which parts it
best, and halves whose extents there are over eps apart are skipped. What is
left is a product in single precision; values near the threshold are decided
in double precision. A task returns link counts and a forest of links, no
pairs.

Any directions give the same links. They come from a bounded sample. Equal
vectors collapse to one first and count as many. How much is skipped depends
on the data: blocks part where the leading directions hold much of the
spread; where all directions are alike only the halves part (see README).

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; a shorter vector counts as filled with zeros; a
null id keeps its row, links with nothing and is kept; rows that repeat an id
count as one vector each. An empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, components


@dataclass(frozen=True)
class GridJoin:
    cosine: float = 0.9
    #: Directions of the sort order and cells to eps on each; directions of the boxes.
    order: int = 3
    cuts: int = 4
    boxes: int = 32
    #: Vectors of a block, and of the smallest piece of the recursion.
    block: int = 4096
    leaf: int = 128
    #: Vectors that the directions are fitted on.
    sample: int = 4096

    @property
    def eps(self) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)) * (1 + 1e-9) + 1e-12)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, filled with zeros up to width."""
    lists = lists.cast(pa.list_(pa.float64()))
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def directions(sample: np.ndarray) -> np.ndarray:
    """Columns: orthonormal directions, the widest first."""
    return np.linalg.eigh(np.cov(sample.T, bias=True).reshape(sample.shape[1], -1))[1][:, ::-1]


def _placed(batches: Iterator[pa.RecordBatch], axes: np.ndarray, p: GridJoin) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = _unit(_matrix(batch.column("v"), len(axes)))
        along = unit @ axes[:, : p.order]
        cells = np.floor(along * (p.cuts / p.eps)).astype(np.int32)
        cell = [pa.array(cells[:, k] if k < cells.shape[1] else np.zeros(len(cells), np.int32)) for k in range(3)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("n"), *cell, pa.array(along[:, 0]), pa.array([r.tobytes() for r in unit], pa.binary())],
            names=["rep", "n", "c1", "c2", "c3", "y", "unit"],
        )


def _extent(unit: np.ndarray, axes: np.ndarray, p: GridJoin) -> np.ndarray:
    """Places on the leading directions, and the length of the rest: distances between such rows are no larger than those of the vectors."""
    along = unit @ axes[:, : p.boxes]
    return np.column_stack([along, np.sqrt(np.maximum(0, 1 - (along * along).sum(1)))])


def _blocks(batches: Iterator[pa.RecordBatch], axes: np.ndarray, p: GridJoin, part: int) -> Iterator[pa.RecordBatch]:
    """Runs of at most p.block sorted rows of one partition, each with its box."""
    held: list[pa.RecordBatch] = []
    count = made = 0

    def cut(n: int) -> pa.RecordBatch:
        nonlocal held, count, made
        table = pa.Table.from_batches(held).combine_chunks()
        now, rest = table.slice(0, n), table.slice(n)
        held, count = rest.to_batches(), len(rest)
        raw = b"".join(now.column("unit").to_pylist())
        along = _extent(np.frombuffer(raw).reshape(len(now), -1), axes, p)
        made += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part << 32 | made]),
                pa.array([now.column("rep").to_numpy().tobytes()], pa.binary()),
                pa.array([now.column("n").to_numpy().tobytes()], pa.binary()),
                pa.array([raw], pa.binary()),
                pa.array([along.min(0).tolist()]),
                pa.array([along.max(0).tolist()]),
            ],
            names=["block", "reps", "weights", "units", "low", "high"],
        )

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        while count >= p.block:
            yield cut(p.block)
    if count:
        yield cut(count)


class Pieces:
    """The links between two sequences of vectors, or within one, found by halves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, weight2: np.ndarray, ids: np.ndarray, ids2: np.ndarray, same: bool, p: GridJoin):
        self.x, self.y, self.same, self.p = x, y, same, p
        self.x32, self.y32 = x.astype(np.float32), y.astype(np.float32)
        self.weight, self.weight2 = weight, weight2
        self.links, self.links2 = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        every = np.concatenate([ids, ids if same else ids2])
        self.every, self.root, self.shift = every, {}, len(x)
        #: Products of single precision that were needed, of len(x) * len(y) or half of them.
        self.products = 0
        order, order2 = np.arange(len(x)), np.arange(len(y))
        todo = [(order, order2)]
        if same:  # a diagonal of squares, and what lies off it
            todo, cuts = [], [(0, len(x))]
            while cuts:
                a, b = cuts.pop()
                if b - a <= p.leaf:
                    self._leaf(order[a:b], order[a:b], True)
                else:
                    m = (a + b) // 2
                    cuts += [(a, m), (m, b)]
                    todo.append((order[a:m], order[m:b]))
        for i, j in todo:
            self._halves(i, j)

    def _halves(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.p
        todo = [(i, j)]
        while todo:
            i, j = todo.pop()
            line = self.x32[i].mean(0, dtype=np.float64) - self.y32[j].mean(0, dtype=np.float64)
            length = np.linalg.norm(line)
            line /= length if length > 0 else 1
            # The nearest come first on both sides.
            u, v = self.x[i] @ line, self.y[j] @ line
            order, order2 = np.argsort(u), np.argsort(-v)
            i, j, u, v = i[order], j[order2], u[order], v[order2]
            near, near2 = np.searchsorted(u, v[0] + p.eps, "right"), np.searchsorted(-v, p.eps - u[0], "right")
            i, j = i[:near], j[:near2]
            if not len(i) or not len(j):
                continue
            if max(len(i), len(j)) > 8 * p.leaf:
                m, k = (len(i) + 1) // 2, (len(j) + 1) // 2
                todo += [(a, b) for a in (i[:m], i[m:]) for b in (j[:k], j[k:]) if len(a) and len(b)]
                continue
            # Strips of the first side, each with what lies within eps of it.
            for at in range(0, len(i), p.leaf):
                reach = int(np.searchsorted(-v[: len(j)], p.eps - u[at], "right"))
                if not reach:
                    break
                self._leaf(i[at : at + p.leaf], j[:reach], False)

    def _leaf(self, i: np.ndarray, j: np.ndarray, square: bool) -> None:
        self.products += len(i) * len(j)
        cosine = self.x32[i] @ self.y32[j].T
        hit = cosine >= self.p.cosine - 1e-5
        if not hit.any():
            return
        a, b = np.nonzero(hit & (cosine <= self.p.cosine + 1e-5))
        if len(a):
            hit[a, b] = np.einsum("ij,ij->i", self.x[i[a]], self.y[j[b]]) >= self.p.cosine
        if square:
            np.fill_diagonal(hit, False)
        self.links[i] += hit @ self.weight2[j]
        if not square:
            (self.links if self.same else self.links2)[j] += self.weight[i] @ hit
        self._join(i, j if self.same else j + self.shift, hit)

    def _join(self, i: np.ndarray, j: np.ndarray, hit: np.ndarray) -> None:
        """Groups of vectors: every row joins its first hit, every column its own first one, then first hits join the rest's."""
        rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        top = hit[rows].argmax(1)
        for a, b in zip(i[rows].tolist(), j[top].tolist()):
            self._union(a, b)
        side = hit[:, columns].argmax(0)
        for a, b in zip(i[side].tolist(), j[columns].tolist()):
            self._union(a, b)
        # Hits between groups that are still apart.
        left, right = (np.array([self._find(k) for k in s.tolist()]) for s in (i[rows], j[columns]))
        a, b = np.nonzero(hit[np.ix_(rows, columns)] & (left[:, None] != right[None, :]))
        for r, s in {*zip(left[a].tolist(), right[b].tolist())}:
            self._union(r, s)

    def _find(self, k: int) -> int:
        root = self.root
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    def _union(self, a: int, b: int) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            low, high = (a, b) if self.every[a] <= self.every[b] else (b, a)
            self.root[high] = low

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """id, links and the smallest id of its group here."""
        near = self.links if self.same else np.concatenate([self.links, self.links2])
        at = np.flatnonzero(near)
        return self.every[at], near[at], self.every[[self._find(k) for k in at.tolist()]] if len(at) else self.every[at]


def _links(batches: Iterator[pa.RecordBatch], p: GridJoin) -> Iterator[pa.RecordBatch]:
    """id, how many it links with here, and the smallest id of its group here."""
    for batch in batches:
        for row in range(batch.num_rows):
            value = lambda c: batch.column(c)[row].as_py()  # noqa: B023, E731
            ids, ids2 = np.frombuffer(value("reps"), np.int64), np.frombuffer(value("reps2"), np.int64)
            weight, weight2 = np.frombuffer(value("weights"), np.int64), np.frombuffer(value("weights2"), np.int64)
            x, y = (np.frombuffer(value(k)).reshape(len(i), -1) for k, i in (("units", ids), ("units2", ids2)))
            found = Pieces(x, y, weight, weight2, ids, ids2, value("block") == value("block2"), p).found()
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["id", "links", "root"])


def embedding_duplicates(vectors: DataFrame, params: GridJoin = GridJoin(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per vector."""
    p = params
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    usable = F.coalesce(finite & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("ok", usable)
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")))
    good = rows.where("ok")
    width = good.agg(F.max(F.size("v"))).first()[0]
    ids = rows.select("vec_id", "h1", "h2")
    alone = F.col("vec_id")
    if width is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone.alias("component_id"), F.lit(True).alias("kept"))
    distinct = scratch.settle(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(p.sample).select("v").toArrow().column("v").combine_chunks()
    axes = directions(_unit(_matrix(sample, width)))
    placed = distinct.select("rep", "n", "v").mapInArrow(lambda it: _placed(it, axes, p), "rep long, n long, c1 int, c2 int, c3 int, y double, unit binary")
    # The sort order is the epsilon grid order; a partition is an interval of it, or a few of them, and holds whole blocks.
    parts = max(1, -(-distinct.count() // (2 * p.block)))
    ordered = placed.repartitionByRange(parts, "c1", "c2", "c3", "y", "rep").coalesce(parts).sortWithinPartitions("c1", "c2", "c3", "y", "rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _blocks(batches, axes, p, TaskContext.get().partitionId())

    blocks = scratch.settle(ordered.select("rep", "n", "unit").mapInArrow(cut, "block long, reps binary, weights binary, units binary, low array<double>, high array<double>"))
    cell = lambda c, k: F.floor(F.col(c)[k] / p.eps).cast("int")
    boxes = blocks.select("block", "low", "high")
    own = boxes.withColumn("cell", F.explode(F.sequence(cell("low", 0), cell("high", 0))))
    reach = boxes.select(F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    reach = reach.withColumn("cell", F.explode(F.sequence(cell("low2", 0) - 1, cell("high2", 0) + 1)))
    gaps = F.zip_with(
        F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))
    )
    gap = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    pairs = own.join(reach, "cell").where("block <= block2").where(gap <= p.eps**2).select("block", "block2").distinct()
    second = blocks.select(F.col("block").alias("block2"), F.col("reps").alias("reps2"), F.col("weights").alias("weights2"), F.col("units").alias("units2"))
    both = pairs.repartition(max(8, spark.sparkContext.defaultParallelism), "block", "block2")
    both = both.join(blocks.drop("low", "high"), "block").join(second, "block2")
    found = scratch.settle(both.mapInArrow(lambda it: _links(it, p), "id long, links long, root long"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    named = (
        distinct.select("h1", "h2", "rep", "n")
        .join(counts, "rep", "left")
        .join(labels.withColumnRenamed("id", "rep"), "rep", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    )
    scratch.drop(blocks)
    out = ids.join(named, ["h1", "h2"], "left")
    component = F.coalesce("component_id", alone)
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == alone, F.lit(True)).alias("kept")
    )
