"""Token ids in a binary file format: Simple-8b words in blocks.

A block holds the ids of whole documents, in pieces of PIECE ids. A piece is
a run of little-endian 64-bit words. The top four bits of a word select how
many ids of which width follow from the lowest bits up:

    selector   0  1  2  3  4  5  6  7  8  9 10 11 12 13
    ids       60 30 20 15 12 10  8  7  6  5  4  3  2  1
    bits       1  2  3  4  5  6  7  8 10 12 15 20 30 60

Selector 15 is an escape: its word holds nothing and the next one is a whole
64-bit id. A word takes as many ids as fit. `offsets` has the first word of
each piece, so a reader starts at any piece and decodes all words at once.

Files are Parquet with a row per block: shard, block, doc_ids, lengths, words,
offsets. Shards are disjoint ascending ranges of document ids and blocks of a
shard ascend too, so that order is the order of the ids.

Defined results: a null text holds only the end id; rows that repeat an id
stand next to each other; a null id comes first; texts of any length are
encoded whole. An empty table gives no files and an empty table. Other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .bpe import cut_words, odd_words
from .common import Scratch

PIECE = 1024
#: Ids of a block, unless one document has more.
BLOCK = 1_048_576
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 64])
ESCAPE = 15


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least one; an id over 2**53 may get one more."""
    return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.int8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and the first word of each piece; all pieces advance together."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    starts = np.arange(0, n, PIECE)
    if not n:
        return np.zeros(0, np.uint64), starts
    width = np.concatenate([_widths(ids), np.full(60, 127, np.int8)])
    at, end = starts.copy(), np.minimum(starts + PIECE, n)
    live = np.arange(len(starts))
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, selector, first id
    near, far = np.arange(8), np.arange(60)
    while len(live):
        place, room = at[live], end[live] - at[live]
        top = np.maximum.accumulate(width[place[:, None] + near], 1)
        selector = np.full(len(live), 13, np.int8)
        for s in (12, 11, 10, 9, 8, 7, 6):  # wider counts overwrite
            selector[(top[:, COUNTS[s] - 1] <= BITS[s]) & (room >= COUNTS[s])] = s
        selector[top[:, 0] > 60] = ESCAPE
        dense = np.flatnonzero((top[:, 7] <= 6) & (room >= 10))
        if len(dense):
            most = np.maximum.accumulate(width[place[dense, None] + far], 1)
            for s in (5, 4, 3, 2, 1, 0):
                selector[dense[(most[:, COUNTS[s] - 1] <= BITS[s]) & (room[dense] >= COUNTS[s])]] = s
        made.append((live, selector, place))
        at[live] = place + COUNTS[selector]
        live = live[at[live] < end[live]]
    piece, selector, place = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(piece, kind="stable")
    piece, selector, place = piece[order], selector[order], place[order]
    size = 1 + (selector == ESCAPE)
    slot = np.cumsum(size) - size
    words = np.zeros(size.sum(), np.uint64)
    for s in np.unique(selector):
        rows = np.flatnonzero(selector == s)
        if s == ESCAPE:
            words[slot[rows]] = np.uint64(ESCAPE << 60)
            words[slot[rows] + 1] = ids[place[rows]]
            continue
        word = np.full(len(rows), int(s) << 60, np.uint64)
        for k in range(COUNTS[s]):
            word |= ids[place[rows] + k] << np.uint64(BITS[s] * k)
        words[slot[rows]] = word
    return words, slot[np.searchsorted(piece, np.arange(len(starts)))]


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of consecutive words that start at a piece."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    last = -2
    for i in np.flatnonzero(selector == ESCAPE):
        if i != last:  # else it is itself a whole id
            literal[i + 1 if i + 1 < len(words) else i] = True
            last = i + 1
    escape = np.zeros(len(words), bool)
    escape[np.flatnonzero(literal) - 1] = True
    count = np.where(escape, 0, np.where(literal, 1, COUNTS[selector]))
    first = np.cumsum(count) - count
    out = np.zeros(count.sum(), np.uint64)
    out[first[literal]] = words[literal]
    plain = ~literal & ~escape
    for s in np.unique(selector[plain]):
        rows = np.flatnonzero(plain & (selector == s))
        mask, word, to = np.uint64((1 << int(BITS[s])) - 1), words[rows], first[rows]
        for k in range(COUNTS[s]):
            out[to + k] = (word >> np.uint64(BITS[s] * k)) & mask
    return out


# --- encoding with the tokenizers library ------------------------------------------


def _is_letters(word: str) -> bool:
    """Letters of long standing, at which Python and the library can't differ, perhaps after a line feed."""
    body = word[1:] if word[:1] == "\n" else word
    return body.isalpha() and max(body) < "\u3000"


class LibraryEncoder:
    """Texts to ids with a tokenizer file; remembers the ids of words.

    by_space: a space or a line feed before a non-space starts a new piece of
    this tokenizer, so a text in which only non-spaces follow them is cut
    there, unless it holds a special token's string, which the library finds
    first. New words go to the library together as one text, and their ids are
    told apart by length; words of letters are one piece each, and a full stop
    or comma after them is a piece too, so they need no pattern. Two generations of words are remembered, so that frequent ones stay.
    """

    REMEMBERED = 300_000
    RUN_CHARS = 3_000_000

    def __init__(self, raw: bytes, by_space: bool):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_buffer(raw)
        self.by_space = by_space
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.line, *stops = self._whole(["\n", ".", ","])
        self.stops = dict(zip(".,", stops))
        vocabulary = self.tokenizer.get_vocab()
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # a character of a byte-level token is a byte
        # Words of letters need no pattern: they part where the space or line feed stands.
        self.spaced, self.lined = Tokenizer.from_buffer(raw), Tokenizer.from_buffer(raw)
        for tokenizer, mark, behavior in ((self.spaced, " ", "merged_with_next"), (self.lined, "\n", "isolated")):
            tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(mark, behavior), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, tokenizer, words: list[str]) -> None:
        """Ids of words that go to the library as texts of some ten thousand."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            texts = [w if w[0] == "\n" else " " + w for w in part]
            ids = np.array(tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.cumsum(self.length[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(t.encode()) for t in texts])) + 1
            raw, cuts = ids.tobytes(), [0, *(cuts * 4).tolist()]
            self.words.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))

    def _learn(self, words: set[str]) -> None:
        older, held = self.older, self.words
        held.update((w, older[w]) for w in words if w in older)
        words = words.difference(held)
        stopped = {w: w[:-1] for w in words if w[-1:] in self.stops and _is_letters(w[:-1])}
        bases = set(stopped.values())
        held.update((w, older[w]) for w in bases if w in older)
        new = words.difference(stopped).union(bases).difference(held)
        spaced, lined, rest = [], [], []
        for w in new:
            (rest if not _is_letters(w) else lined if w[0] == "\n" else spaced).append(w)
        for tokenizer, part in ((self.spaced, spaced), (self.lined, lined), (self.tokenizer, rest)):
            self._remember(tokenizer, part)
        held.update((w, held[base] + self.stops[w[-1]]) for w, base in stopped.items())

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") < self.RUN_CHARS):
                size += len(texts[to] or "")
                to += 1
            if len(self.words) > self.REMEMBERED:
                self.words, self.older = {}, self.words
            run = [t or "" for t in texts[at:to]]
            plain = [self.by_space and not any(s in t for s in self.special) for t in run]
            words = [cut_words(t) if p else [t] for t, p in zip(run, plain)]
            fresh = set().union(*(w[1:] for w in words)).difference(self.words)
            if odd := odd_words(fresh):
                words = [[t] if not odd.isdisjoint(w[1:]) else w for t, w in zip(run, words)]
                fresh -= odd
            self._learn(fresh)
            held = self.words.__getitem__
            for head, tail in zip(self._whole([w[0] for w in words]), words):
                yield np.frombuffer(b"".join([head, *map(held, tail[1:])]), np.int32)
            at = to


_KEPT: dict[int, LibraryEncoder] = {}


def library_encoder(raw: bytes, by_space: bool) -> Callable[[list], Iterator[np.ndarray]]:
    key = hash((raw, by_space))
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = LibraryEncoder(raw, by_space)
    return _KEPT[key].encode


# --- files ---------------------------------------------------------------------------

SCHEMA = "shard int, block int, doc_ids array<long>, lengths array<int>, words binary, offsets array<int>"


def _blocks(batches: Iterator[pa.RecordBatch], encode: Callable, end: int, shard: int) -> Iterator[pa.RecordBatch]:
    ids: list = []
    docs: list[int | None] = []
    size = block = 0

    def cut() -> pa.RecordBatch:
        nonlocal ids, docs, size, block
        words, offsets = pack(np.concatenate(ids))
        row = [
            pa.array([shard], pa.int32()),
            pa.array([block], pa.int32()),
            pa.array([docs], pa.list_(pa.int64())),
            pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
            pa.array([words.tobytes()], pa.binary()),
            pa.array([offsets.astype(np.int32)], pa.list_(pa.int32())),
        ]
        ids, docs, size, block = [], [], 0, block + 1
        return pa.RecordBatch.from_arrays(row, names=["shard", "block", "doc_ids", "lengths", "words", "offsets"])

    tail = np.array([end], np.int32)
    for batch in batches:
        names = batch.column(0).to_pylist()
        for name, found in zip(names, encode(batch.column(1).to_pylist())):
            if size and size + len(found) + 1 > BLOCK:
                yield cut()
            ids.append(np.concatenate([found, tail]))
            docs.append(name)
            size += len(found) + 1
    if size:
        yield cut()


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0, by_space: bool = False, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append the end id, and write the files under path."""
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # under two megabytes
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _blocks(batches, library_encoder(raw.value, by_space), end, TaskContext.get().partitionId())

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files.

    Starts come from sums of shards (a row each), then of the blocks of a shard.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    before = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    shard = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("base"))
    within = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before("shard", "block")), F.lit(0)).alias("inner"))
    base = within.join(shard, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = unpack(np.frombuffer(batch.column("words")[row].as_py(), np.uint64)).astype("<u4")
                size = batch.column("lengths")[row].values.to_numpy().astype(np.int64)
                ends = np.cumsum(size)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[row].values, pa.array(ends - size + batch.column("base")[row].as_py()), pa.array(size), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.drop("offsets").join(base, ["shard", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = 0, by_space: bool = False) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    path = Scratch(docs.sparkSession, "tokens").root
    write(docs, path, tokenizer, end, by_space)
    return read(docs.sparkSession, path)
