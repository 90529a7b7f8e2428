"""Byte-level BPE: encoding, decoding, and token counts by section.

The ranks of a public vocabulary file drive the merges. A text is split by
the vocabulary's pattern; pieces not met before are encoded together in
padded matrices, one for each range of lengths. In a round every row merges
its leftmost pair of minimum rank, its tail moves up, and finished rows leave
the matrix. Pair ranks come from an open-addressing hash table. A row of over
WIDE bytes is a matrix of its own; its round merges that pair at all its
places from left to right, which gives the same ids: a merge makes no pair of
lower rank, so these places would come next one after another.

Defined results: a null text encodes to no ids and decodes to no bytes; a
null id keeps its row; repeated rows give equal rows; texts of any length are
encoded whole. An empty table gives an empty table. Other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import tidied

#: Bytes from which a row merges all places of its pair in a round.
WIDE = 256
#: Pieces, and words, whose ids a worker remembers; characters of a run of texts.
REMEMBERED = 400_000
RUN_CHARS = 3_000_000
_NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> rank of the merged token, by linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 2.5).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask
        self.ranks[slot] = rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, _NONE for pairs that don't merge or where an id is -1."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(key)
        held = self.keys[slot]
        out = np.where(held == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((held != key) & (held != -1))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            held = self.keys[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return np.where((left < 0) | (right < 0), _NONE, out)


class Vocabulary:
    """Tokens by rank of a rank file: a base64 token and its rank on each line."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.splitlines()))}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        decimal = [b"%d " % i for i in range(len(self.tokens))]
        self.decimal = np.array(decimal).view(np.uint8).reshape(len(decimal), -1)  # zeros fill each row up
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.table = PairTable(*(np.array(x, np.int32) for x in zip(*splits)))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, merged on its own, as 32-bit integers."""
        out = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        low = 0
        for high in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, WIDE):
            rows = np.flatnonzero((lengths > low) & (lengths <= high))
            for at in range(0, len(rows), max(1, 200_000 // high)):
                part = rows[at : at + max(1, 200_000 // high)]
                for row, ids in zip(part.tolist(), self._matrix([pieces[i] for i in part], high)):
                    out[row] = ids
            low = high
        for row in np.flatnonzero(lengths > WIDE):
            out[row] = self._wide(pieces[row])
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        # A last column of -1 stands after every row; pair k is of ids k and k + 1.
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1)
        done = np.full((n, width), -1, np.int32)
        rank = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width)
        live = np.arange(n)
        while len(live):
            place = rank.argmin(1)  # the leftmost of equal ranks
            best = rank[np.arange(len(live)), place]
            over = best == _NONE
            if over.any():
                done[live[over], : ids.shape[1] - 1] = ids[over, :-1]
                keep = ~over
                live, ids, rank, place, best = live[keep], ids[keep], rank[keep], place[keep], best[keep]
                if not len(live):
                    break
            row = np.arange(len(live))
            used = int((ids >= 0).sum(1).max())
            ids, rank, column = ids[:, : used + 1], rank[:, :used], np.arange(used + 1)
            ids[row, place] = best
            after = np.minimum(column + (column > place[:, None]), used)
            ids = np.take_along_axis(ids, after, 1)
            rank = np.take_along_axis(rank, np.minimum(after[:, :used], used - 1), 1)
            rank[row, place] = self.table.find(ids[row, place], ids[row, place + 1])
            back = np.flatnonzero(place > 0)
            before = place[back] - 1
            rank[back, before] = self.table.find(ids[back, before], ids[back, before + 1])
        ends = np.cumsum((done >= 0).sum(1) * 4).tolist()
        flat = done[done >= 0].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _wide(self, piece: bytes) -> bytes:
        ids = self.byte_id[np.frombuffer(piece, np.uint8)]
        rank = self.table.find(ids[:-1], ids[1:])
        while len(rank) and (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            # Of places next to each other, as in a run of one token, every second one.
            opens = np.concatenate([[True], np.diff(at) > 1])
            start = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            ids[at] = best
            ids, rank = np.delete(ids, at + 1), np.delete(rank, at)
            now = at - np.arange(len(at))
            near = np.unique(np.concatenate([now - 1, now]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self.table.find(ids[near], ids[near + 1])
        return ids.tobytes()


def cut_words(text: str) -> list[str]:
    """What stands before the first space or line feed, then the words after them; a line feed stays with its word, a space doesn't."""
    return text.replace("\n", " \n").split(" ")


def odd_words(words: set[str]) -> set[str]:
    """Those with a space or nothing where the word should begin."""
    return {w for w in words if not (rest := w[1:] if w[:1] == "\n" else w) or rest[0].isspace()}


class Encoder:
    """Texts to ids and back; remembers the ids of pieces and of words.

    by_space: the pattern never joins a space or a line feed and a following
    non-space to what stands before them, so such a place is a boundary. Then
    a text in which only non-spaces follow these is cut there, and whole words
    are remembered, with the line feed but without the space before them.
    """

    def __init__(self, raw: bytes, pattern: str, by_space: bool = False):
        self.vocabulary = Vocabulary(raw)
        self.split = regex.compile(pattern).findall
        self.by_space = by_space
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.pieces))
        self.pieces.update(zip(new, self.vocabulary.encode([p.encode() for p in new])))

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; texts are handled in runs of a few megabytes."""
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size + len(texts[to] or "") < RUN_CHARS):
                size += len(texts[to] or "")
                to += 1
            if len(self.pieces) > REMEMBERED or len(self.words) > REMEMBERED:
                self.pieces.clear()
                self.words.clear()
            words = [cut_words(t) if self.by_space and t else [t or ""] for t in texts[at:to]]
            fresh = set().union(*(w[1:] for w in words)).difference(self.words)
            if odd := odd_words(fresh):
                words = [[t or ""] if not odd.isdisjoint(w[1:]) else w for t, w in zip(texts[at:to], words)]
                fresh -= odd
            heads = [self.split(w[0]) for w in words]
            new = {w: self.split(w if w[0] == "\n" else " " + w) for w in fresh}
            self._learn(set().union(*heads, *new.values()))
            ids_of, word_ids = self.pieces.__getitem__, self.words.__getitem__
            self.words.update((w, b"".join(map(ids_of, p))) for w, p in new.items())
            for head, tail in zip(heads, words):
                yield np.frombuffer(b"".join([*map(ids_of, head), *map(word_ids, tail[1:])]), np.int32)
            at = to

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, gathered from one table."""
        v = self.vocabulary
        size = v.sizes[ids]
        ends = np.cumsum(size)
        return v.bytes[np.repeat(v.starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.vocabulary.decimal[ids].tobytes().translate(None, b"\0")[:-1]


_ENCODERS: dict[tuple[int, str, bool], Encoder] = {}


def _encoder(raw: bytes, pattern: str, by_space: bool) -> Encoder:
    key = (hash(raw), pattern, by_space)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw, pattern, by_space)
    return _ENCODERS[key]


def _shared(docs: DataFrame, ranks: str):
    """The rank file (under a megabyte), read on the driver."""
    return docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())


def encode(docs: DataFrame, ranks: str, pattern: str, by_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_tokens."""
    raw = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(raw.value, pattern, by_space)
        for batch in batches:
            ids = list(coder.encode(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, ids array<int>, n_tokens long")


def decode(encoded: DataFrame, ranks: str, pattern: str, by_space: bool = False) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that aren't UTF-8 become the replacement character."""
    raw = _shared(encoded, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(raw.value, pattern, by_space)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, text string")


def round_trip(docs: DataFrame, ranks: str, pattern: str, by_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes they decode to."""
    raw = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(raw.value, pattern, by_space)
        for batch in batches:
            count, one, two = [], [], []
            for ids in coder.encode(batch.column(1).to_pylist()):
                count.append(len(ids))
                one.append(hashlib.sha256(coder.decimal(ids)).hexdigest())
                two.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
