"""Shared scratch storage, word kernels and connected components."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: A word is a run of bytes that are none of these.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Text bytes that one numpy pass handles; a longer document is one pass.
CHUNK_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A temporary one stands in only on one machine, as in tests; a cluster without the setting is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quire.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("quire.scratch", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no earlier stage; what is left of them goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self._files(self.root)[1].deleteOnExit(self._files(self.root)[0])

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def settle(self, df: DataFrame) -> DataFrame:
        """Write df and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quire_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that no later step reads, and let go of the shuffle files of the jobs that made them.

        Spark removes shuffle files when the driver's JVM finds their plans unreachable, which needs a collection.
        """
        for df in frames:
            path, files = self._files(df._quire_path)
            files.delete(path, True)
        self.spark._jvm.System.gc()


def hot_keys(rows: DataFrame, keys: list[str], shares: int = 1000) -> DataFrame | None:
    """keys and salts of the keys that hold over 1/shares of the rows, None without any.

    There are fewer than `shares` of them at any size, so the list may come to the driver and be broadcast.
    """
    each = max(-(-rows.count() // shares), 1000)  # rows that one task takes with ease
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > each)
    found = counts.select(*keys, F.ceil(F.col("__n") / each).cast("int").alias("__salts"))
    held = found.toArrow()
    return rows.sparkSession.createDataFrame(held) if held.num_rows else None


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table whose keys are unique. A hot key's rows are dealt by the columns `by` over as many copies of its row of the table."""
    if hot is None:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    left = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), *by), F.coalesce("__salts", F.lit(1))).cast("int"))
    right = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)))
    return left.drop("__salts").join(right.drop("__salts"), [*keys, "__salt"], how).drop("__salt")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives freed memory back to the system at the end of a task: Spark keeps its Python workers, and what they hold counts as the executor's."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return go


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


# --- words of a batch of texts -------------------------------------------------

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "gram": 0xD6E8FEB86659FD93, "gram2": 0xA0761D6478BD642F}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2^64, and of its inverse."""
    if name not in _POWERS or len(_POWERS[name][0]) <= n:
        base = _BASES[name]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(int(n * 1.25) + 2, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[name] = tuple(both)
    return _POWERS[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES):
    """(first row, offsets, bytes) of runs of rows; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


class Words:
    """Word starts, ends and hashes of a chunk; words of text i are first[i]:first[i + 1]."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        inside = ~_SPACES[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens, closes = inside.copy(), inside.copy()
        if len(data):
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._lower = lower

    def hashes(self) -> np.ndarray:
        data = _LOWER[self.data] if self._lower else self.data
        up, down = _powers("byte", len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        found = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(found + (self.ends - self.starts).astype(np.uint64))


def grams(hashes: np.ndarray, n: int, base: str = "gram") -> np.ndarray:
    """A hash of each n consecutive hashes; the caller skips those that cross a text's end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(base, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(hashes) - n + 1])


# --- connected components -------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id that each id in edges (a, b) reaches.

    An id with one neighbour takes no part in the rounds and gets its
    neighbour's label in the end, so a star, however large, is one pass: rounds
    label the others among themselves, then each of their components takes the
    least of its ids and their neighbours. Each round takes the least label among
    the neighbours and then follows labels one step further, so a chain
    shrinks by more than half. Labels stay distributed; only the count of
    changed ones comes to the driver. An id with very many neighbours is salted.
    """
    both = scratch.settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    ids = scratch.settle(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("low"), F.count("*").alias("n"), F.min("b").alias("next")))
    ends = ids.where("n = 1").select("id", "low", "next")
    outer = ends.select(F.col("id").alias("a"), F.col("next").alias("b"))
    inner = both.join(outer, ["a", "b"], "left_anti").join(outer.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    inner, hubs = scratch.settle(inner), ids.where("n > 1").select("id", "low")
    first = inner.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = scratch.settle(hubs.join(first, "id", "left").select("id", F.least("id", "near").alias("label")))
    hot = hot_keys(inner, ["b"])
    for _ in range(rounds):
        near = salted_join(inner, labels.select(F.col("id").alias("b"), "label"), ["b"], hot, ["a"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.least("label", "near").alias("mid"), F.col("label").alias("old"))
        jump = step.join(labels.select(F.col("id").alias("mid"), F.col("label").alias("far")), "mid", "left")
        moved, seen = jump.select("id", F.least("mid", F.coalesce("far", "mid")).alias("label"), "old"), Observation()
        moved = scratch.settle(moved.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("changed")))
        scratch.drop(labels)
        labels = moved
        if not seen.get["changed"]:
            break
    else:
        raise RuntimeError("components did not settle; raise rounds")
    tops = labels.join(hubs, "id").groupBy("label").agg(F.min("low").alias("top"))
    named = scratch.settle(salted_join(labels, tops, ["label"], hot_keys(labels, ["label"]), ["id"]).select("id", F.col("top").alias("label")))
    known = named.select(F.col("id").alias("next"), F.col("label").alias("far"))
    given = salted_join(ends, known, ["next"], hot_keys(ends, ["next"]), ["id"], "left").select("id", F.coalesce("far", "low").alias("label"))
    found = scratch.settle(given.union(named))
    scratch.drop(both, ids, inner, labels, named)
    return found
