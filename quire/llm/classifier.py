"""Quality classifier: a byte-level convolutional network in numpy.

Filters over `width` bytes run along the whole text. Responses are max-pooled
over chunks of `chunk` bytes that overlap by half, together all of the text;
a document's mean and maximum over its chunks pass one hidden layer into one
probability. A filter on bytes is a table of 256 rows for each of its places,
so a response is a sum of rows.

The network is fitted on the driver on a bounded sample of labelled documents:
at most `sample` of them and `sample_bytes` of text, in the order of hashes of
their ids, each whole. Every document is then scored whole on the executors.
Labels, language, source and id are no inputs.

Defined results: a null or empty text is scored as one place of padding; a
label that is null trains nothing, nor does an id whose labels differ; without
usable labels of both kinds every score is the share of label 1, or 0.5;
repeated rows give equal rows; a null id is scored like others; texts of any
length are scored whole. An empty table gives an empty table. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_chunks


@dataclass(frozen=True)
class Net:
    width: int = 5
    filters: int = 16
    hidden: int = 16
    chunk: int = 256
    #: Bounds of the training sample: documents, and bytes of their texts.
    sample: int = 4000
    sample_bytes: int = 10_000_000
    epochs: int = 8
    batch: int = 64
    rate: float = 0.004
    seed: int = 11
    threshold: float = 0.3

    @property
    def half(self) -> int:
        """Places of half a chunk; chunk i is halves i and i + 1."""
        return self.chunk // 2


Weights = dict[str, np.ndarray]


def _start(p: Net) -> Weights:
    rng = np.random.default_rng(p.seed)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return {
        "table": draw(p.width, 256, p.filters, s=0.3),
        "shift": np.zeros(p.filters, np.float32),
        "w1": draw(2 * p.filters, p.hidden, s=(1 / p.filters) ** 0.5),
        "b1": np.zeros(p.hidden, np.float32),
        "w2": draw(p.hidden, s=p.hidden**-0.5),
        "b2": np.zeros(1, np.float32),
    }


def responses(w: Weights, padded: np.ndarray, n: int) -> np.ndarray:
    """Filter responses at the first n places of padded bytes."""
    table = w["table"]
    out = table[0][padded[:n]]
    for k in range(1, len(table)):
        out += table[k][padded[k : n + k]]
    return out


def _head(w: Weights, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.concatenate([mean, top], 1)
    h = np.maximum(x @ w["w1"] + w["b1"], 0)
    return x, h, 1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30)))


def _chunks(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk, and the first chunk of each document, for documents of count halves; a lone half is a chunk."""
    chunks = np.maximum(count - 1, 1)
    first = np.cumsum(chunks) - chunks
    ends = np.cumsum(count)
    one = np.arange(chunks.sum()) - np.repeat(first - ends + count, chunks)
    return one, np.minimum(one + 1, np.repeat(ends - 1, chunks)), first


def _halves(raw: np.ndarray, p: Net) -> tuple[np.ndarray, np.ndarray]:
    """A text's halves with the bytes that their last places reach, and how many places each has."""
    n = max(1, len(raw))
    count = -(-n // p.half)
    padded = np.zeros(count * p.half + p.width - 1, np.uint8)
    padded[: len(raw)] = raw
    at = np.arange(count) * p.half
    return padded[at[:, None] + np.arange(p.half + p.width - 1)], np.minimum(n - at, p.half)


def fit(texts: list[bytes], labels: np.ndarray, p: Net) -> Weights:
    w = _start(p)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    rng, t = np.random.default_rng(p.seed), 0
    for epoch in range(p.epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), p.batch):
            part = order[at : at + p.batch]
            cut = [_halves(np.frombuffer(texts[i], np.uint8), p) for i in part]
            rows, places = (np.concatenate(x) for x in zip(*cut))
            count = np.array([len(x) for _, x in cut])
            y = labels[part].astype(np.float32)
            flat = np.concatenate([rows.ravel(), np.zeros(p.width - 1, np.uint8)])
            r = responses(w, flat, rows.size).reshape(*rows.shape, p.filters)[:, : p.half]
            r[np.arange(p.half) >= places[:, None]] = -np.inf
            place = r.argmax(1)
            peaks = np.take_along_axis(r, place[:, None, :], 1)[:, 0]
            one, two, first = _chunks(count)
            size = np.maximum(count - 1, 1)
            winner = np.where(peaks[one] >= peaks[two], one[:, None], two[:, None])
            f = np.broadcast_to(np.arange(p.filters), winner.shape)
            peak = peaks[winner, f] + w["shift"]
            act = np.maximum(peak, 0)
            mean, top = np.add.reduceat(act, first) / size[:, None], np.maximum.reduceat(act, first)
            x, h, prob = _head(w, mean, top)
            g: Weights = {}
            d = ((prob - y) / len(part)).astype(np.float32)
            g["w2"], g["b2"] = h.T @ d, d.sum(keepdims=True)
            dh = np.outer(d, w["w2"]) * (h > 0)
            g["w1"], g["b1"] = x.T @ dh, dh.sum(0)
            dx = dh @ w["w1"].T
            owner = np.repeat(np.arange(len(part)), size)
            da = (dx[:, : p.filters] / size[:, None])[owner]
            da += dx[owner, p.filters :] * (act == top[owner])
            da *= peak > 0
            g["shift"] = da.sum(0)
            g["table"] = np.zeros_like(w["table"])
            at_place = place[winner, f]
            for k in range(p.width):
                np.add.at(g["table"][k], (rows[winner, at_place + k], f), da)
            t += 1
            rate = p.rate * (1 - epoch / p.epochs) ** 0.5
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def score(w: Weights, offsets: np.ndarray, data: np.ndarray, p: Net) -> np.ndarray:
    """Probabilities of the whole texts of a chunk of bytes."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    pad = p.width - 1
    ends = np.cumsum(size + pad)
    begin = ends - size - pad
    padded = np.zeros(int(ends[-1]) + pad, np.uint8)
    padded[np.arange(len(data)) + np.repeat(begin - offsets[:-1], np.diff(offsets))] = data
    count = -(-size // p.half)
    first = np.cumsum(count) - count
    at = np.repeat(begin, count) + (np.arange(count.sum()) - np.repeat(first, count)) * p.half
    stop = np.minimum(at + p.half, np.repeat(begin + size, count))
    peak = np.empty((len(at), p.filters), np.float32)
    block = 192  # halves whose responses are held at once
    for k in range(0, len(at), block):
        a, z = at[k : k + block], stop[k : k + block]
        r = responses(w, padded[a[0] : z[-1] + pad], int(z[-1] - a[0]))
        marks = np.empty(2 * len(a), np.int64)
        marks[::2], marks[1::2] = a - a[0], np.minimum(z - a[0], len(r) - 1)
        peak[k : k + block] = np.maximum.reduceat(r, marks)[::2]
        peak[min(k + block, len(at)) - 1] = r[marks[-2] :].max(0)
    one, two, first = _chunks(count)
    act = np.maximum(np.maximum(peak[one], peak[two]) + w["shift"], 0)
    return _head(w, np.add.reduceat(act, first) / np.maximum(count - 1, 1)[:, None], np.maximum.reduceat(act, first))[2]


def held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, p: Net, id_col: str, text_col: str, label_id: str, label: str) -> Weights | float:
    """The weights, or the share of label 1 where only one kind is there."""
    usable = labels.select(F.col(label_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").where(~held_out("id"))
    agreed = usable.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = agreed.orderBy(*order).limit(p.sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(chosen), "id")
    # Sizes first: the driver takes whole texts while they fit the bound.
    ids, room = [], p.sample_bytes
    for row in texts.groupBy("id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(*order).collect():  # at most p.sample rows
        if row["size"] <= room:
            ids.append(row["id"])
            room -= row["size"]
    held = docs.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64())}))
    table = texts.join(F.broadcast(held), "id", "left_semi").select("id", "y", "text").toArrow()
    table = table.take(np.lexsort((table.column("text").to_numpy(), table.column("id").to_numpy())))
    y = table.column("y").to_numpy()
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    return fit([x.encode() for x in table.column("text").to_pylist()], y, p)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    params: Net = Net(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    p = params
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, p, id_col, text_col, label_id, label))  # a hundred kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for first, offsets, data in text_chunks(batch.column(1)):
                n = len(offsets) - 1
                found = np.full(n, w) if isinstance(w, float) else score(w, offsets, data, p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"))
