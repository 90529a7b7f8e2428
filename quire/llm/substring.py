"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words. Each word covered by a window that
also starts in a document with a smaller id is removed; windows are judged on
the input. Positions modulo `period` that lie in a difference cover are
anchors: for any two offsets some shift below `period` brings both onto the
cover, so two occurrences of a window share an anchor of
window - period + 1 words at aligned places. Only anchors are hashed
over the whole corpus. Around anchors that occur in two documents, the full
windows are hashed and the smallest document of each is found, which is the
extension and the exact test at once.

Documents with equal word sequences collapse first: all but the smallest id
lose every window. Hot windows are reduced by a map-side minimum and salted
where they meet their minimum; nothing is paired. Window hashes have 128 bits.

Defined results: a null text has no words; documents under `window` words
lose nothing; a null id keeps its row and loses nothing; rows that repeat an
id are judged each on its own text, and none of them against another, since
an id isn't smaller than itself; texts of any length are read whole. An empty
table gives an empty table. Other columns are not read by
`substring_duplicates`, and kept by `remove_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, Words, grams, hot_keys, mix, salted_join, text_chunks, tidied


@dataclass(frozen=True)
class Substring:
    window: int = 50
    period: int = 31
    #: A perfect difference set modulo 31.
    cover: tuple[int, ...] = (1, 5, 11, 24, 25, 27)

    def __post_init__(self):
        apart = {(a - b) % self.period for a in self.cover for b in self.cover}
        if len(apart) != self.period or self.period > self.window:
            raise ValueError("the cover must give every difference modulo the period, and the period must fit in the window")

    @property
    def anchor(self) -> int:
        return self.window - self.period + 1

    def places(self, n: int) -> np.ndarray:
        """Anchor positions of a document of n words."""
        if n < self.window:
            return np.zeros(0, np.int64)
        at = np.arange(n - self.anchor + 1)
        return at[np.isin(at % self.period, self.cover)]


def sequence_key(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a word sequence, from the hashes of its words."""
    place = np.arange(1, len(own) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(own ^ place).sum().view(np.int64)) if len(own) else 0, int(mix(own + mix(place)).sum().view(np.int64)) if len(own) else 0


def _outline(batches: Iterator[pa.RecordBatch], p: Substring) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, two hashes of the word sequence, sha256 of the joined words, anchor hashes."""
    for batch in batches:
        for first, offsets, data in text_chunks(batch.column(1)):
            words = Words(offsets, data)
            h = words.hashes()
            anchors = grams(h, p.anchor).view(np.int64)
            n = len(offsets) - 1
            count = np.diff(words.first)
            low, high, sha, found = [], [], [], []
            raw = data.tobytes()
            for i in range(n):
                own = h[words.first[i] : words.first[i + 1]]
                one, two = sequence_key(own)
                low.append(one)
                high.append(two)
                sha.append(hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest())
                found.append(anchors[words.first[i] + p.places(len(own))])
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), pa.array(count.astype(np.int64)), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sha), lists],
                names=["doc_id", "n_words", "low", "high", "sha", "anchors"],
            )


KEY = ["doc_id", "low", "high"]


def _windows(batches: Iterator[pa.RecordBatch], p: Substring) -> Iterator[pa.RecordBatch]:
    """KEY, start and hashes w1, w2 of the windows around a document's shared anchors."""
    for batch in batches:
        shared, keys = batch.column("shared"), [batch.column(c).to_numpy() for c in KEY]
        for first, offsets, data in text_chunks(batch.column("text")):
            words = Words(offsets, data)
            h = words.hashes()
            one, two = grams(h, p.window).view(np.int64), grams(h, p.window, "gram2").view(np.int64)
            rows, starts, lows, highs = [], [], [], []
            for i in range(len(offsets) - 1):
                n = words.first[i + 1] - words.first[i]
                own = h[words.first[i] : words.first[i + 1]]
                if n < p.window or sequence_key(own) != (keys[1][first + i], keys[2][first + i]):
                    continue  # another text of the id
                at = p.places(n)
                held = np.asarray(shared[first + i].values, np.int64)
                held = at[held[held < len(at)]]
                edge = np.zeros(n + 2, np.int64)
                np.add.at(edge, np.maximum(held - (p.window - p.anchor), 0), 1)
                np.add.at(edge, held + 1, -1)
                start = np.flatnonzero(np.cumsum(edge)[: n - p.window + 1])
                rows.append(np.full(len(start), first + i))
                starts.append(start)
                lows.append(one[words.first[i] + start])
                highs.append(two[words.first[i] + start])
            if rows:
                row = np.concatenate(rows)
                columns = [*(k[row] for k in keys), np.concatenate(starts).astype(np.int32), np.concatenate(lows), np.concatenate(highs)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*KEY, "start", "w1", "w2"])


def removed_mask(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge)[:n] > 0


def _digests(batches: Iterator[pa.RecordBatch], p: Substring) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, removed, sha = [], [], []
        for row, (text, starts) in enumerate(zip(batch.column("text"), batch.column("starts"))):
            raw = (text.as_py() or "").encode()
            data = np.frombuffer(raw, np.uint8)
            found = Words(np.array([0, len(raw)]), data)
            if sequence_key(found.hashes()) != (batch.column("low")[row].as_py(), batch.column("high")[row].as_py()):
                continue  # another text of the id
            words = raw.split()
            gone = removed_mask(len(words), np.asarray(starts.values, np.int64), p.window)
            rows.append(row)
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([w for w, x in zip(words, gone) if not x])).hexdigest())
        keys = batch.select(KEY).take(pa.array(rows, pa.int64())).columns
        yield pa.RecordBatch.from_arrays([*keys, pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=[*KEY, "n_removed", "kept_sha256"])


@dataclass
class Found:
    """A document is KEY: an id and its word sequence. outline: a row per document; copies: documents whose every window is in a smaller one; starts: removed windows of the others; texts: their texts."""

    outline: DataFrame
    copies: DataFrame
    texts: DataFrame
    starts: DataFrame


def find(docs: DataFrame, p: Substring, scratch: Scratch, id_col: str, text_col: str) -> Found:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    outline = scratch.settle(
        source.mapInArrow(tidied(lambda it: _outline(it, p)), "doc_id long, n_words long, low long, high long, sha string, anchors array<long>")
    )
    long_ones = outline.where(f"doc_id is not null and n_words >= {p.window}")
    # The smallest id of each word sequence that more than one document has.
    twins = long_ones.groupBy("low", "high").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").drop("last")
    copies = scratch.settle(long_ones.select(*KEY).join(twins, ["low", "high"]).where("doc_id <> rep").select(*KEY).distinct())
    # Anchors that two documents have.
    anchors = long_ones.select(*KEY, "anchors").join(copies, KEY, "left_anti").select(*KEY, F.posexplode("anchors").alias("k", "hash"))
    common = scratch.settle(anchors.groupBy("hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("hash"))
    shared = scratch.settle(anchors.join(common, "hash").groupBy(*KEY).agg(F.collect_set("k").alias("shared")))
    texts = scratch.settle(source.join(shared, "doc_id"))
    windows = scratch.settle(texts.mapInArrow(tidied(lambda it: _windows(it, p)), "doc_id long, low long, high long, start int, w1 long, w2 long"))
    scratch.drop(common, shared)
    marks = ["w1", "w2"]
    smallest = windows.groupBy(*marks).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").drop("hi")
    smallest = scratch.settle(smallest)
    gone = salted_join(windows, smallest, marks, hot_keys(windows, marks), KEY).where("lo < doc_id")
    starts = scratch.settle(gone.groupBy(*KEY).agg(F.collect_set("start").alias("starts")))
    scratch.drop(windows, smallest)
    return Found(outline.drop("anchors"), copies, texts, starts)


def substring_duplicates(docs: DataFrame, params: Substring = Substring(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = find(docs, params, scratch, id_col, text_col)
    cut = (
        found.texts.drop("shared").join(found.starts, KEY)
        .mapInArrow(tidied(lambda it: _digests(it, params)), "doc_id long, low long, high long, n_removed long, kept_sha256 string")
        .dropDuplicates(KEY)
    )
    nothing = hashlib.sha256(b"").hexdigest()
    whole = found.copies.select(*KEY, F.lit(None).cast("long").alias("n_removed"), F.lit(nothing).alias("kept_sha256"), F.lit(True).alias("whole"))
    changed = scratch.settle(whole.union(cut.withColumn("whole", F.lit(False))))
    scratch.drop(found.texts)
    rows = found.outline.join(changed, KEY, "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def _shorten(batches: Iterator[pa.RecordBatch], p: Substring, text_col: str) -> Iterator[pa.RecordBatch]:
    """Cut removed words out of the texts; what is kept stays byte for byte. __marks: what the texts of a row's id lose."""
    for batch in batches:
        at = batch.schema.get_field_index(text_col)
        out = []
        for text, marks in zip(batch.column(at), batch.column("__marks")):
            value = text.as_py()
            if value is not None and marks.is_valid:
                raw = value.encode()
                words = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))
                key = sequence_key(words.hashes())
                mark = next((m for m in marks.as_py() if (m["low"], m["high"]) == key), None)
                if mark and mark["whole"]:
                    value = ""
                elif mark:
                    gone = removed_mask(len(words.starts), np.array(mark["starts"], np.int64), p.window)
                    ends = np.append(words.starts[1:], len(raw))  # a kept word keeps the space that follows it
                    value = b"".join(raw[s:e] for s, e, g in zip(words.starts, ends, gone) if not g).decode()
            out.append(value)
        columns = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])


def remove_duplicates(docs: DataFrame, params: Substring = Substring(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the removed words; their columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = find(docs, params, scratch, id_col, text_col)
    marks = found.copies.select(*KEY, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")).union(found.starts.select(*KEY, F.lit(False), "starts"))
    marks = marks.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("low", "high", "whole", "starts")).alias("__marks"))  # one for each text of an id
    scratch.drop(found.texts)
    joined = docs.join(marks, docs[id_col] == F.col("__id"), "left").drop("__id")
    return joined.mapInArrow(tidied(lambda it: _shorten(it, params, text_col)), docs.schema)
