"""MinHash near-dedup on SetSketch registers.

A document is the set of its distinct n-word shingles (64-bit hashes). A
register holds the truncated logarithm of the least value that one random
function takes on the set: exponentially spaced minima, which merge by
maximum and agree on two sets about as often as the sets' similarity.
Registers are banded to find candidates, pairs are estimated jointly by
likelihood, and whatever may reach the threshold is verified on full sets.

Equal sets collapse to one, which gets a number. In a bucket every member is
paired only with the bucket's smallest number. A star group is a smallest
number with all its partners; groups that verified links leave in more than
one component are compared in blocks inside tasks, only across components:
first by registers alone, then, for the members that an estimate leaves a
partner, on full sets, which gives at most a forest of links. So no group's
pairs become rows, few full sets move, and no link between members of a
bucket is lost.

Defined results: a null or wordless text has an empty set and links with
nothing; fewer words than n make one shingle; a null id keeps its row, links
with nothing and is kept; rows that repeat an id are one document that links
by each of its texts; texts of any length are read whole. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, Words, components, grams, hot_keys, mix, salted_join, text_chunks, tidied


@dataclass(frozen=True)
class NearDedup:
    """A pair links with percent * union <= 100 * intersection.

    bands * rows registers: a pair at similarity s shares no band with
    probability (1 - s**rows)**bands, 6e-7 at the default's 0.8; 24 bands give
    8e-7 at 0.85. Set bands for the threshold in use.
    """

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 36
    #: Registers are floor(1 - log_base(minimum / rate)), held to 0..255.
    base: float = 1.09
    rate: float = 20.0
    #: Most members of one block of a star group.
    block: int = 400

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def registers(values: np.ndarray, starts: np.ndarray, p: NearDedup) -> np.ndarray:
    """One row of registers for each run of shingle hashes that begins at starts."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(starts), p.registers), np.uint32)
    for j, a in enumerate(_multipliers(p.registers)):
        least[:, j] = np.minimum.reduceat(x * a, starts)
    spread = -np.log1p(-(least + 0.5) / 2.0**32) / p.rate
    return np.clip(np.floor(1 - np.log(spread) / np.log(p.base)), 0, 255).astype(np.uint8)


def shingle_runs(offsets: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a chunk, text after text, and where each text's run begins (and ends)."""
    words = Words(offsets, data, lower=True)
    h = words.hashes()
    count = np.diff(words.first)
    full = grams(h, n)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    values = np.empty(bounds[-1], np.uint64)
    rows = np.repeat(np.arange(len(count)), runs)
    at = words.first[rows] + np.arange(bounds[-1]) - bounds[rows]
    whole = count[rows] >= n
    values[whole] = full[at[whole]]
    for row in np.flatnonzero((count > 0) & (count < n)):
        few = h[words.first[row] : words.first[row + 1]]
        values[bounds[row]] = grams(few, len(few))[0] ^ np.uint64(len(few))
    return values, bounds


def _sketches(batches: Iterator[pa.RecordBatch], p: NearDedup) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, offsets, data in text_chunks(batch.column(1)):
            values, bounds = shingle_runs(offsets, data, p.shingle)
            n = len(offsets) - 1
            sizes, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            full = np.flatnonzero(np.diff(bounds))
            regs: list[bytes | None] = [None] * n
            if len(full):
                found = registers(values, bounds[full], p)
                for k, i in enumerate(full):
                    own = np.unique(values[bounds[i] : bounds[i + 1]])
                    sizes[i] = len(own)
                    low[i], high[i] = own.sum().view(np.int64), mix(own).sum().view(np.int64)
                    regs[i] = found[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(sizes), pa.array(low), pa.array(high), pa.array(regs, pa.binary())],
                names=["doc_id", "n_shingles", "low", "high", "regs"],
            )


def _sets(batches: Iterator[pa.RecordBatch], p: NearDedup) -> Iterator[pa.RecordBatch]:
    """sid, n_shingles, shingles, regs of the texts whose set is the one asked for: an id may have several texts."""
    last = None
    for batch in batches:
        sids, want = batch.column("sid").to_numpy(), [batch.column(c).to_numpy() for c in ("low", "high")]
        for first, offsets, data in text_chunks(batch.column("text")):
            values, bounds = shingle_runs(offsets, data, p.shingle)
            rows, found = [], []
            for i in range(len(offsets) - 1):
                own = np.unique(values[bounds[i] : bounds[i + 1]])
                row = first + i
                if sids[row] != last and own.sum().view(np.int64) == want[0][row] and mix(own).sum().view(np.int64) == want[1][row]:
                    last = sids[row]
                    rows.append(row)
                    found.append(own.tobytes())
            held = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [held.column("sid"), held.column("n_shingles"), pa.array(found, pa.binary()), held.column("regs")], names=["sid", "n_shingles", "shingles", "regs"]
            )


def likelihood(equal: np.ndarray, larger: np.ndarray, smaller: np.ndarray, a: np.ndarray, b: np.ndarray, base: float) -> np.ndarray:
    """The similarity, of a grid, under which the register comparisons are likeliest.

    equal, larger and smaller count the registers of the first set against
    the second; a and b are the sets' sizes, which are known.
    """
    grid = np.linspace(0.005, 0.995, 100)
    u = (a / (a + b))[:, None]
    v = 1 - u

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)

    most = np.minimum(u / v, v / u)
    j = np.minimum(grid[None, :], most)
    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    same = np.maximum(1 - up - down, 1e-12)
    fit = larger[:, None] * np.log(up) + smaller[:, None] * np.log(down) + equal[:, None] * np.log(same)
    return np.minimum(grid[np.argmax(fit, axis=1)], most[:, 0])


def _margin(p: NearDedup) -> float:
    """Six standard errors of the estimate at the threshold, at least."""
    s = p.percent / 100
    return s - 6.5 * np.sqrt(s * (1 - s) / p.registers) - 0.02


def estimate(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, p: NearDedup) -> np.ndarray:
    equal = (left == right).sum(1)
    larger = (left > right).sum(1)
    return likelihood(equal, larger, p.registers - equal - larger, a, b, p.base)


def _verified(batches: Iterator[pa.RecordBatch], p: NearDedup) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b) that link: first by estimate, then on full sets."""
    for batch in batches:
        one, two = batch.column("one").to_pylist(), batch.column("two").to_pylist()
        if not one:
            continue
        n1 = np.array([len(x) // 8 for x in one])
        n2 = np.array([len(x) // 8 for x in two])
        r1 = np.frombuffer(b"".join(batch.column("regs_one").to_pylist()), np.uint8).reshape(len(one), -1)
        r2 = np.frombuffer(b"".join(batch.column("regs_two").to_pylist()), np.uint8).reshape(len(one), -1)
        may = estimate(r1, r2, n1, n2, p) >= _margin(p)
        for i in np.flatnonzero(may):
            x, y = np.frombuffer(one[i], np.uint64), np.frombuffer(two[i], np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            may[i] = 100 * shared >= p.percent * (len(x) + len(y) - shared)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(may)) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def shared_counts(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Intersection sizes of sets[:n] with sets[n:], or of all with all where n is the length.

    Sets become differences to the first one: what near copies have in common
    vanishes, and only values in two differences or more are multiplied out,
    the frequent ones as a dense product, the others pair by pair.
    """
    size = np.array([len(s) for s in sets])
    pivot = sets[0]
    marks = [np.setxor1d(s, pivot, assume_unique=True) for s in sets]
    mark = np.array([len(m) for m in marks])
    row = np.repeat(np.arange(len(sets)), mark)
    value = np.concatenate(marks)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, int)
    often = np.diff(np.append(start, len(value)))
    both = np.zeros((len(sets), len(sets)), np.float32)
    dense = np.flatnonzero(often >= 24)
    for at in range(0, len(dense), 2048):
        part = dense[at : at + 2048]
        x = np.zeros((len(sets), len(part)), np.float32)
        reach = often[part]
        col = np.repeat(np.arange(len(part)), reach)
        idx = np.repeat(start[part] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        x[row[idx], col] = 1
        both += x @ x.T
    for k in range(2, 24):
        for at in range(0, len(rare := start[often == k]), 4096):
            members = row[rare[at : at + 4096, None] + np.arange(k)]
            for i in range(k):
                for j in range(i + 1, k):
                    np.add.at(both, (members[:, i], members[:, j]), 1)
                    np.add.at(both, (members[:, j], members[:, i]), 1)
    np.fill_diagonal(both, mark)
    apart = mark[:, None] + mark[None, :] - 2 * both
    shared = (size[:, None] + size[None, :] - apart) / 2
    return shared if n == len(sets) else shared[:n, n:]


@dataclass
class _Block:
    """The members of one block of a star group, or of two: those of the first block come first."""

    ids: np.ndarray
    labels: np.ndarray
    regs: np.ndarray
    order: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, key, table: pa.Table) -> "_Block":
        i, j = key[1].as_py(), key[2].as_py()
        blocks, ids = table.column("block").to_numpy(), table.column("id").to_numpy()
        order = np.lexsort((ids, blocks != i))
        regs = table.column("regs").to_pylist()
        n = int((blocks == i).sum())
        left, right = (np.arange(n), np.arange(n, len(ids))) if i != j else (np.arange(len(ids)),) * 2
        return cls(ids[order], table.column("label").to_numpy()[order], np.frombuffer(b"".join(regs[k] for k in order), np.uint8).reshape(len(order), -1), order, left, right)

    def may_link(self, size: np.ndarray, p: NearDedup) -> np.ndarray:
        """Pairs of left and right in different components whose estimate reaches the threshold."""
        left, right, labels = self.left, self.right, self.labels
        may = np.zeros((len(left), len(right)), bool)
        for k in range(len(left)):
            near = (labels[right] != labels[left[k]]) & (100 * np.minimum(size[right], size[left[k]]) >= p.percent * np.maximum(size[right], size[left[k]]))
            other = np.flatnonzero(near & (self.ids[right] > self.ids[left[k]]) if left is right else near)
            if len(other):
                base = np.broadcast_to(self.regs[left[k]], (len(other), self.regs.shape[1]))
                may[k, other] = estimate(base, self.regs[right[other]], np.full(len(other), size[left[k]]), size[right[other]], p) >= _margin(p)
        return may


def _hopefuls(key, table: pa.Table, p: NearDedup) -> pa.Table:
    """The members of a block, or of two, that registers leave a partner in another component."""
    table = table.combine_chunks()
    block = _Block.of(key, table)
    may = block.may_link(table.column("n_shingles").to_numpy()[block.order], p)
    some = np.zeros(len(block.ids), bool)
    some[block.left[may.any(1)]] = True
    some[block.right[may.any(0)]] = True
    return table.take(pa.array(block.order[some])).select(["a", "i", "j", "block", "id", "label"])


def _block_links(key, table: pa.Table, p: NearDedup) -> pa.Table:
    """Links between components among one block of a star group, or between two."""
    table = table.combine_chunks()
    block = _Block.of(key, table)
    ids, labels, left, right = block.ids, block.labels, block.left, block.right
    raw = table.column("shingles").to_pylist()
    sets = [np.frombuffer(raw[k], np.uint64) for k in block.order]
    size = np.array([len(s) for s in sets])
    may = block.may_link(size, p)
    own, others = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
    a, b = [], []
    if len(own):
        shared = shared_counts([sets[left[k]] for k in own] + [sets[right[k]] for k in others], len(own))
        union = size[left[own]][:, None] + size[right[others]][None, :] - shared
        links = np.argwhere((100 * shared >= p.percent * union) & may[np.ix_(own, others)])
        root = {x: x for x in set(labels.tolist())}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x, y in links:
            one, two = left[own[x]], right[others[y]]
            r, s = find(labels[one]), find(labels[two])
            if r != s:
                root[r] = s
                a.append(ids[one])
                b.append(ids[two])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    p = params
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = scratch.settle(
        source.mapInArrow(tidied(lambda it: _sketches(it, p)), "doc_id long, n_shingles long, low long, high long, regs binary")
    )
    usable = sketches.where("doc_id is not null and n_shingles > 0")
    digest = ["low", "high", "n_shingles"]
    # A set's number is settled with it, so every later reading sees the same.
    distinct = usable.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.min_by("regs", "doc_id").alias("regs"))
    distinct = scratch.settle(distinct.withColumn("sid", F.monotonically_increasing_id()))

    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", i * p.rows + 1, p.rows)) for i in range(p.bands)])
    bands = distinct.select(F.col("sid").alias("b"), F.explode(keys).alias("key"))
    # Written first: a join of two plain shuffles is one whose hot keys Spark can split.
    buckets = scratch.settle(bands.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("last")).where("a <> last").select("key", "a"))
    pairs = scratch.settle(bands.join(buckets, "key").where("a <> b").select("a", "b").distinct())

    candidates = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b"))).distinct()
    wanted = distinct.join(candidates, "sid").select("sid", F.col("rep").alias("doc_id"), "low", "high", "regs", "n_shingles")
    # The list of candidates grows with the corpus: a merge join at every size, never a broadcast.
    texts = source.join(wanted.hint("merge"), "doc_id")
    sets = scratch.settle(texts.mapInArrow(tidied(lambda it: _sets(it, p)), "sid long, n_shingles long, shingles binary, regs binary"))
    side = lambda k, n: sets.select(F.col("sid").alias(k), F.col("shingles").alias(n), F.col("regs").alias(f"regs_{n}"))
    first = scratch.settle(pairs.groupBy("b").agg(F.min("a").alias("a")))
    hot = hot_keys(first, ["a"])
    with_both = salted_join(first.join(side("b", "two"), "b"), side("a", "one"), ["a"], hot, ["b"])
    links = with_both.mapInArrow(tidied(lambda it: _verified(it, p)), "a long, b long")
    # An id with several texts joins their sets.
    again = usable.groupBy("doc_id").agg(F.min("low").alias("l"), F.max("low").alias("h"), F.min("high").alias("l2"), F.max("high").alias("h2")).where("l <> h or l2 <> h2").select("doc_id")
    bound = usable.join(again, "doc_id").join(distinct.select(*digest, "sid"), digest).select("doc_id", "sid").distinct()
    links = scratch.settle(links.union(bound.join(bound.groupBy("doc_id").agg(F.min("sid").alias("a")), "doc_id").select("a", F.col("sid").alias("b")).where("a <> b")))
    labels = components(links, scratch)

    # Star groups that are not yet one component, in blocks of bounded size.
    members = pairs.select("a", F.col("b").alias("id")).union(pairs.select("a", F.col("a").alias("id")).distinct())
    members = members.join(labels, "id", "left").select("a", "id", F.coalesce("label", "id").alias("label"))
    groups = members.groupBy("a").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    alone = first.groupBy("a").agg(F.count("*").alias("direct"))  # a lone pair has been verified already
    groups = groups.where("low <> high").join(alone, "a", "left").where("not (n = 2 and coalesce(direct, 0) = 1)")
    spread = F.ceil(F.col("n") / p.block).cast("int")
    open_members = members.join(groups.select("a", spread.alias("n_blocks")), "a").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    open_members = scratch.settle(open_members.join(sets.select(F.col("sid").alias("id"), "n_shingles", "regs"), "id"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    placed = open_members.select("a", "id", "label", "block", "n_shingles", "regs", other)
    placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    schema = "a long, i int, j int, block int, id long, label long"
    hopefuls = scratch.settle(placed.groupBy("a", "i", "j").applyInArrow(lambda key, t: _hopefuls(key, t, p), schema))
    held = hopefuls.join(sets.select(F.col("sid").alias("id"), "shingles", "regs"), "id")
    more = scratch.settle(held.groupBy("a", "i", "j").applyInArrow(lambda key, t: _block_links(key, t, p), "a long, b long"))
    # Components of components: the extra links join labels.
    lifted = (
        more.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left")
        .join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
        .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    )
    above = components(lifted, scratch)
    final = (
        labels.join(above.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "left")
        .select("id", F.coalesce("top", "label").alias("label"))
        .union(above.join(labels, "id", "left_anti").select("id", F.col("label")))
    )
    # The smallest document of each component of sets.
    linked = final.join(distinct.select(F.col("sid").alias("id"), "rep"), "id")
    tops = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked = scratch.settle(linked.join(tops, "label").select(F.col("id").alias("sid"), "component_id"))
    scratch.drop(buckets, pairs, sets, first, links, open_members, hopefuls, more)
    named = distinct.join(linked, "sid", "left").select(*digest, F.coalesce("component_id", "rep").alias("component_id"))
    rows = sketches.select("doc_id", *digest).join(named, digest, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
