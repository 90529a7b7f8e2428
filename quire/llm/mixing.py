"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is a share of all words by weight, held to `most` times
the source; what is over is shared again by weight. A document of a source is
taken target / source_size times on average: the whole part always, one more
with the fractional part as inclusion probability. The fractions are settled
by the cube method: a step moves three undecided documents' probabilities
along the null space of the constraints (words and documents of the source)
until one becomes 0 or 1, so totals stay; which of the two ends it takes is
drawn so that inclusion probabilities stay too. Blocks of a source run at the same
time and leave at most two undecided documents each; these go through the
same flight again, in fewer blocks. The last block holds a few documents back
and lands them and the last two on the choice whose words come nearest.

Deterministic: blocks come from hashes of the ids, inside a block the
documents are sorted by a hash before the flight, and the hashes seed the
draws. The landing picks the nearest words, not at random: inclusion
probabilities hold but for the few documents of a source that it settles.

Defined results: a null text has size 0; a null source is the last source; a
source without words has target 0 and takes nothing; rows that repeat an id
are separate documents of the mix. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, Scratch


@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in order, repeating.
    weights: Sequence[float] = (5, 2, 1)
    #: Most times that a source is taken.
    most: float = 3.0
    #: Documents in a block of the flight, and documents that the last block lands.
    block: int = 4000
    landing: int = 12
    #: A document of more than so many times its source's mean size is a long one, if it is over a thousandth of the target.
    large: float = 4.0


def targets(sizes: DataFrame, p: Mix) -> DataFrame:
    """source, source_size, sized (documents with a word), target from (source, size), by source.

    Sources whose share is over their limit are those with the least limit
    per weight: with sources in that order, the first k are at the limit and
    the others share the rest, for the least k that leaves none above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("sized"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1  # one row for each source
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    named = by_source.withColumn("weight", F.get(weights, F.pmod(rank, F.lit(len(p.weights)))))
    named = named.withColumn("limit", F.col("source_size") * p.most)
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = named.withColumn("level", level).withColumn("held", F.col("limit") < F.col("level") * F.col("weight"))
    rest = F.min(F.when(~F.col("held"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return filled.select("source", "source_size", "sized", F.when(F.col("held"), F.col("limit")).otherwise(rest * F.col("weight")).alias("target"))


def flight(size: np.ndarray, prob: np.ndarray, seed: Sequence[int] = (0,)) -> np.ndarray:
    """Probabilities after the flight: at most two are still fractions.

    A step goes to one of its two ends at random, so that each probability stays what it was on average.
    """
    draw = np.random.default_rng(seed).random(len(prob)).tolist()  # a step settles a document at least
    prob = prob.tolist()
    size = size.tolist()
    held: list[int] = []
    tiny = 1e-9
    for new in range(len(prob)):
        if tiny < prob[new] < 1 - tiny:
            held.append(new)
        while len(held) == 3:
            a, b, c = held
            u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - prob[i]) / x if x > 0 else prob[i] / -x for i, x in zip(held, u) if x)
            down = min(prob[i] / x if x > 0 else (1 - prob[i]) / -x for i, x in zip(held, u) if x)
            step = up if draw.pop() * (up + down) < down else -down
            for i, x in zip(held, u):
                prob[i] += step * x
            held = [i for i in held if tiny < prob[i] < 1 - tiny]
    return np.clip(np.array(prob), 0, 1)


def _snap(prob: np.ndarray) -> np.ndarray:
    return np.where(prob < 1e-9, 0.0, np.where(prob > 1 - 1e-9, 1.0, prob))


def _land(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """0 or 1 for each of a few documents: words near what is expected, then the count."""
    bits = (np.arange(1 << len(size))[:, None] >> np.arange(len(size))) & 1
    words = np.abs(bits @ size - size @ prob)
    count = np.maximum(np.abs(bits.sum(1) - prob.sum()) - 1, 0)
    return bits[np.argmin(words + 0.1 * size.mean() * count)].astype(float)


def _fly(table: pa.Table, hold: int, last: bool) -> pa.Table:
    """Probabilities of a block after its flight. last: it decides all, by a landing of `hold` documents and the two that stay, or without one by draws."""
    size = table.column("size").to_numpy()
    order = np.lexsort((table.column("row").to_numpy(), table.column("mark").to_numpy()))
    prob = table.column("prob").to_numpy().copy()
    moving = order[: max(0, len(order) - hold)] if last else order
    marks = table.column("mark").to_numpy()[moving].view(np.uint64)
    seed = [len(marks), int(np.bitwise_xor.reduce(marks)), int(marks.sum(dtype=np.uint64))]
    prob[moving] = _snap(flight(size[moving], prob[moving], seed))
    if last:
        left = order[(prob[order] > 0) & (prob[order] < 1)]
        prob[left] = _land(size[left], prob[left]) if hold else np.random.default_rng([*seed, 1]).random(len(left)) < prob[left]
    return table.set_column(table.schema.get_field_index("prob"), "prob", pa.array(prob))


FLYING = "source string, mark long, row long, size long, prob double"


def _decided(flying: DataFrame, hold: int, p: Mix, scratch: Scratch) -> list[DataFrame]:
    """Tables of row, source, size and a probability of 0 or 1 for all rows of FLYING."""
    most = flying.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done = []
    while most:
        blocks = max(1, -(-most // p.block))
        last = blocks == 1
        block = F.pmod(F.xxhash64(F.lit(blocks), "mark"), F.lit(blocks))
        flown = scratch.settle(
            flying.withColumn("block", block).groupBy("source", "block").applyInArrow(lambda t: _fly(t.drop(["block"]), hold, last), FLYING)
        )
        done.append(flown.where("prob = 0 or prob = 1"))
        if last:
            break
        flying = flown.where("prob > 0 and prob < 1")
        most = min(most, 2 * blocks)
    return done


def _shifted(small: DataFrame, large: DataFrame) -> DataFrame:
    """The probabilities of the other documents, after long ones took `off` words more than expected (less, below zero)."""
    off = large.groupBy("source").agg(F.sum("off").alias("off"))
    room = small.groupBy("source").agg(F.sum(F.col("prob") * F.col("size")).alias("held"), F.sum((1 - F.col("prob")) * F.col("size")).alias("free"))
    by_source = off.join(room, off["source"].eqNullSafe(room["source"])).select(off["source"].alias("s"), "off", "held", "free")
    less = F.least(F.col("off") / F.greatest("held", F.lit(1.0)), F.lit(1.0))
    more = F.least(-F.col("off") / F.greatest("free", F.lit(1.0)), F.lit(1.0))
    moved = F.when(F.col("off") > 0, F.col("prob") * (1 - less)).when(F.col("off") < 0, F.col("prob") + (1 - F.col("prob")) * more).otherwise(F.col("prob"))
    return small.join(by_source, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("prob", moved).drop("s", "off", "held", "free")


def mix(docs: DataFrame, params: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies: a row per document."""
    p = params
    scratch = Scratch(docs.sparkSession, "mixing")
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), count.alias("size")))
    goals = scratch.settle(targets(sizes, p))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goals.withColumn("times", times).withColumn("whole", F.floor("times")).withColumn("prob", F.col("times") - F.col("whole"))
    rows = sizes.join(goal, sizes["source"].eqNullSafe(goal["source"])).select(
        "doc_id", sizes["source"].alias("source"), "size", "source_size", "sized", "target", F.col("whole").alias("whole"), "prob"
    )
    # Undecided rows only: the hash of an id places it, a row number tells repeated ids apart.
    mark = F.xxhash64(F.lit("mix"), "doc_id", "size")
    rows = rows.withColumn("mark", mark).withColumn("row", F.monotonically_increasing_id())
    fixed = F.col("size") == 0
    rows = rows.withColumn("prob", F.when(fixed, F.lit(0.0)).otherwise(F.col("prob")))
    rows = scratch.settle(rows)
    open_ = rows.where("prob > 0").select("source", "mark", "row", "size", "prob", ((F.col("size") * F.col("sized") > p.large * F.col("source_size")) & (F.col("size") * 1000 > F.col("target"))).alias("long"))
    longs = open_.where("long").drop("long")
    done = _decided(longs, 0, p, scratch)
    flying = open_.where("not long").drop("long")
    if done:
        drawn = reduce(DataFrame.union, done).select("row", F.col("prob").alias("taken"))
        off = longs.join(drawn, "row").select("source", ((F.col("taken") - F.col("prob")) * F.col("size")).alias("off"))
        flying = scratch.settle(_shifted(flying, off))
        sure = flying.where("prob <= 0 or prob >= 1").withColumn("prob", F.when(F.col("prob") >= 1, 1.0).otherwise(0.0))
        done.append(sure)
        flying = flying.where("prob > 0 and prob < 1")
    done += _decided(flying, p.landing, p, scratch)
    chosen = reduce(DataFrame.union, done).select("row", F.col("prob").alias("extra")) if done else rows.withColumn("extra", F.lit(0.0)).limit(0).select("row", "extra")
    copies = (F.col("whole") + F.coalesce("extra", F.lit(0.0))).cast("long")
    out = rows.join(chosen, "row", "left").withColumn("copies", F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(copies))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
