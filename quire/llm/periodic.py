"""Periodic runs of words, found by recursive frequency splitting.

A run is a maximal stretch of words with smallest period q in which words q
apart are identical, at least `copies` times q long and at least `least` words.
Each of its words occurs at least `copies` times in it, so a word that occurs
less often in a segment is in no run of that segment and splits it. Splitting
is repeated, for the segments that changed, until nothing changes; natural
prose falls apart into stretches too short for a run.

What survives is scanned by lags. At lag q the words at multiples of q are
compared with those q further on: a run of period q holds at least
`copies` - 1 multiples in a row that agree, whatever its start. So all lags of
a segment together cost about n log n comparisons, and only stretches that
pass are compared word by word. A stretch inside a known run whose period
divides q is that run again and is passed over.

One pass over the documents without a shuffle: documents are independent, so
no key or group can be hot. Words are compared by 64-bit hashes. A batch of
texts is handled in pieces of `CHUNK_BYTES`, the lags of a segment in groups
of a bounded number of comparisons; a longer document is a piece of its own.

Defined results: a null or blank text has no words and no runs, its collapsed
text is empty; rows that repeat an id are judged each on its own text; a null
id is an id like others; an empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, Words, text_chunks

#: Comparisons that one group of lags makes at once.
GROUP = 2_000_000


@dataclass(frozen=True)
class Periodic:
    #: Least length of a run, in words and in periods.
    least: int = 6
    copies: int = 4

    def __post_init__(self):
        if self.copies < 4:
            raise ValueError("what is passed over as a known run is certain only for four copies or more")


def survivors(ids: np.ndarray, edges: np.ndarray, p: Periodic) -> list[tuple[int, int]]:
    """Segments (start, end) that frequency splitting leaves. ids: word numbers; edges: where the first segments start, and the end of the last."""
    done: list[tuple[int, int]] = []
    lows, highs = edges[:-1], edges[1:]
    while True:
        fits = highs - lows >= p.least
        lows, highs = lows[fits], highs[fits]
        if not len(lows):
            return done
        sizes = highs - lows
        owner = np.repeat(np.arange(len(lows)), sizes)
        at = np.arange(len(owner)) + np.repeat(lows - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        _, kinds, counts = np.unique(owner * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        rare = counts[kinds] < p.copies
        hit = np.bincount(owner[rare], minlength=len(lows)) > 0
        done += zip(lows[~hit].tolist(), highs[~hit].tolist())
        # What is left of the segments that lost a word, cut where positions or owners jump.
        stay = ~rare & hit[owner]
        at, owner = at[stay], owner[stay]
        if not len(at):
            return done
        first = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner) > 0)]))
        lows, highs = at[first], at[np.append(first[1:], len(at)) - 1] + 1


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _probes(w: np.ndarray, lags: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lag, first and last multiple of the groups of at least `need` multiples in a row that agree with the word a lag further on."""
    counts = (len(w) - 1) // lags  # multiples iq with iq + q inside
    lag = np.repeat(lags, counts)
    step = np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)
    same = w[lag * step] == w[lag * (step + 1)]
    # A lag's last multiple can't run on into the next lag's first.
    new = step == 0
    opens = same & (new | ~np.concatenate([[False], same[:-1]]))
    closes = same & np.concatenate([new[1:] | ~same[1:], [True]])
    one, two = np.flatnonzero(opens), np.flatnonzero(closes)
    fits = two - one + 1 >= need
    return lag[one[fits]], step[one[fits]], step[two[fits]]


def runs_of(w: np.ndarray, p: Periodic = Periodic()) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in one segment of word numbers, by start, then period."""
    found: list[tuple[int, int, int]] = []
    owner = np.full(len(w), -1)  # at each place the last run that was found there
    known = np.zeros((0, 3), np.int64)
    lags = np.arange(1, len(w) // p.copies + 1)
    costs = np.cumsum(len(w) // lags)
    while len(lags):
        take = max(1, int(np.searchsorted(costs, GROUP, "right")))
        group, lags, costs = lags[:take], lags[take:], costs[take:] - costs[take - 1]
        lag, one, two = _probes(w, group, p.copies - 1)
        at = np.searchsorted(lag, np.unique(lag))
        for i, j in zip(at, np.append(at[1:], len(lag))):
            q = int(lag[i])
            low, high = one[i:j] * q, (two[i:j] + 1) * q
            # A run found later overlaps a known one of period r by less than r + q words at its ends: the middle still names the known one.
            r = owner[(low + high) // 2]
            if len(known):
                start, length, period = known[r].T
                fresh = (r < 0) | (start > low) | (start + length <= high) | (q % period > 0)
                low, high = low[fresh], high[fresh]
            before = len(found)
            for a, b in zip(low.tolist(), high.tolist()):
                # The word before the first multiple's predecessor differs, as does that at the multiple after the last.
                left, right = max(0, a - q + 1), min(len(w) - q, b)
                for s, e in zip(*_stretches(w[left:right] == w[left + q : right + q])):
                    start, length = left + int(s), int(e - s) + q
                    if length >= max(p.least, p.copies * q):
                        r = owner[start + length // 2]
                        inside = r >= 0 and found[r][0] <= start and start + length <= found[r][0] + found[r][1] and q % found[r][2] == 0
                        if not inside:
                            owner[start : start + length] = len(found)
                            found.append((start, length, q))
            if len(found) > before:
                known = np.array(found)
    return sorted(found, key=lambda x: (x[0], x[2]))


def _keep(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] == 0


def _find(batches: Iterator[pa.RecordBatch], p: Periodic) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        counts: list[int] = []
        runs: list[list[dict]] = []
        collapsed: list[bytes] = []
        for _, offsets, data in text_chunks(batch.column("text")):
            words = Words(offsets, data)
            _, ids = np.unique(words.hashes(), return_inverse=True)
            here: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
            for low, high in survivors(ids, words.first, p):
                row = int(np.searchsorted(words.first, low, "right")) - 1
                shift = low - int(words.first[row])
                here[row] += [(s + shift, n, q) for s, n, q in runs_of(ids[low:high], p)]
            raw = data.tobytes()
            for i, own in enumerate(here):
                own.sort(key=lambda x: (x[0], x[2]))
                tokens = raw[offsets[i] : offsets[i + 1]].split()
                if own:
                    tokens = [t for t, k in zip(tokens, _keep(len(tokens), own)) if k]
                counts.append(int(words.first[i + 1] - words.first[i]))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                collapsed.append(b" ".join(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def find_runs(docs: DataFrame, params: Periodic = Periodic(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text: a row per document.

    The collapsed text has the words that no run holds after its first period, joined by one space.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        lambda it: _find(it, params),
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string",
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents get a tail that repeats its first words.

    With h the crc32 of the id and g = h div 10, a document with h mod 10 = 0
    and n words repeats, from word a = g mod n on, the first
    1 + (n - a) div (3 + g mod 8) words from there. A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", SPACE), lambda w: w != "")
    # A step for each: a column that lambdas use is to be computed once.
    rows = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.select("*", n.alias("n"), F.when(n > 0, F.pmod("g", n)).alias("a"))
    rows = rows.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long").alias("period"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("period")))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """find_runs' rows with their longest run and digests of runs and collapsed text."""
    # Greatest length; among equals the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.less")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.less")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
