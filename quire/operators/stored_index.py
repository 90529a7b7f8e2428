"""A stored index: postings in blocks with their largest share of a score, and a top-k search that skips blocks.

A block holds the postings of one term for a run of `block` documents, so a
word that every document has is many small rows, not one long list. With each
posting lies its impact, the part of BM25 that doesn't depend on the query, and
with each block the largest of them. Blocks are partitioned by a hash of the
term and sorted by term, so a search reads the partitions of its terms.

Documents are dealt by ranges of their ids, so the blocks of a run are made
where its texts are. A search deals the blocks of its words by run: a run meets
all queries in one task, and a posting moves once for however many queries. The
heads of a run's blocks say how large a score can be there; a run whose bound is
below the last of the best scores that its task has for a query is not opened
for it. More query words than HELD are joined instead: heads first, then the
most promising runs of each query, then those whose bound the last score leaves.

Defined results: those of `search.search` and `search.search_any` on the same
sections. A query without words finds nothing; a document without words is not
found and counts for no statistic, nor does one without id; an empty table gives an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.functions.text import tokens
from quire.operators.search import B, HELD, K1, Asked, _idf, millionths, page, query_terms

TERMS = "term string, df long, idf double, bucket int"
RUNS = "term string, run long, docs array<long>, tfs array<double>, lengths array<long>"
BLOCKS = "term string, run long, n int, top double, docs array<long>, impacts array<double>, bucket int"


@dataclass(frozen=True)
class Layout:
    #: Partitions of terms, documents of a block, and runs of documents that a query opens before it knows a bound.
    buckets: int = 16
    block: int = 128
    ahead: int = 4


@dataclass
class StoredIndex:
    """terms(bucket, term, df, idf), blocks(bucket, term, run, n, top, docs, impacts) and docs(doc, length, run)."""

    terms: DataFrame
    blocks: DataFrame
    layout: Layout
    docs: DataFrame


def _bucket(p: Layout):
    return F.pmod(F.xxhash64("term"), F.lit(p.buckets)).cast("int").alias("bucket")


def _run_blocks(batches: Iterator[pa.RecordBatch], weights: list[float], block: int, first: int) -> Iterator[pa.RecordBatch]:
    """term, run, docs, tfs, lengths of each word of a run of documents, and a row without term for each run, over rows in the order of doc.

    Runs are numbered from `first`. Rows that repeat a document are one, and one without words is in no run.
    """

    def blocks(rows: pa.RecordBatch, doc: np.ndarray, start: int) -> pa.RecordBatch:
        number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
        n = int(number[-1]) + 1
        ids = doc[np.searchsorted(number, np.arange(n))]
        values, owner, weight, length = [], [], [], np.zeros(n, np.int64)
        for w, column in zip(weights, rows.columns[1:]):
            sizes = np.diff(column.offsets.to_numpy())
            values.append(column.flatten()), owner.append(np.repeat(number, sizes)), weight.append(np.full(sizes.sum(), w))
            np.add.at(length, number, sizes)
        coded = pa.concat_arrays(values).dictionary_encode()
        key, place = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.concatenate(owner), return_inverse=True)
        tf, code, at = np.bincount(place, np.concatenate(weight), len(key)), key // n, key % n
        run = at // block
        cuts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (run[1:] != run[:-1])]))
        whole = np.arange(0, n, block)
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(code[cuts])), pa.nulls(len(whole), pa.string())])
        offsets = pa.array(np.concatenate([cuts, len(at) + whole, [len(at) + n]]), pa.int32())
        lists = [np.concatenate(x) for x in ((ids[at], ids), (tf, np.zeros(n)), (length[at], length))]
        runs = pa.array(start + np.concatenate([run[cuts], whole // block]))
        return pa.RecordBatch.from_arrays([terms, runs, *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)], names=["term", "run", "docs", "tfs", "lengths"])

    held = None
    for batch in batches:
        full = sum(np.diff(c.offsets.to_numpy()) for c in batch.columns[1:]) > 0
        rows = pa.Table.from_batches([batch.filter(pa.array(full))])
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        doc = rows.column(0).to_numpy()
        number = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
        # The last document may go on, so its run stays open.
        done = int(number[-1]) // block
        cut = int(np.searchsorted(number, done * block))
        if cut:
            yield blocks(rows.slice(0, cut).to_batches()[0], doc[:cut], first)
        first, held = first + done, rows.slice(cut)
    if held is not None and held.num_rows:
        yield blocks(held.combine_chunks().to_batches()[0], held.column(0).to_numpy(), first)


def write_index(sections: DataFrame, path: str, weights: dict[str, float] | None = None, layout: Layout = Layout()) -> None:
    """Write the index of sections(doc long, <fields>) to a new folder. The table `whole` comes last: without it there is no index.

    Texts are dealt by ranges of documents, so the blocks of a run are made where its texts are and only whole blocks move to their terms.
    """
    spark, p = sections.sparkSession, layout
    weights = weights or {"text": 1.0}
    # Documents in the order of their ids; a run is a stretch of them.
    dealt = sections.where("doc is not null").select("doc", *weights).repartitionByRange("doc").sortWithinPartitions("doc")
    words = dealt.select("doc", *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f"words_{i}") for i, f in enumerate(weights)])

    def run_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        yield from _run_blocks(batches, [float(w) for w in weights.values()], p.block, TaskContext.get().partitionId() << 32)

    words.mapInArrow(run_blocks, RUNS).write.parquet(f"{path}/runs")
    runs = spark.read.schema(RUNS).parquet(f"{path}/runs")
    docs = runs.where("term is null").select("run", F.explode(F.arrays_zip("docs", "lengths")).alias("d"))
    docs.select("d.docs", "d.lengths", "run").toDF("doc", "length", "run").write.parquet(f"{path}/docs")
    whole = spark.read.parquet(f"{path}/docs").agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"), F.lit(p.buckets).alias("buckets"), F.lit(p.block).alias("block"), F.lit(p.ahead).alias("ahead"))
    size = whole.first()
    held = runs.where("term is not null")
    terms = held.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    terms = terms.select(_bucket(p), "term", "df", _idf(F.lit(size["n_docs"]), F.col("df")).alias("idf"))
    terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    impact = lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / F.lit(size["avg_length"] or 1.0))))
    # A block moves as it is; impacts are worked out where it is written.
    placed = held.withColumn("bucket", _bucket(p)).repartitionByRange("bucket", "term", "run").sortWithinPartitions("bucket", "term", "run")
    impacts = placed.select("bucket", "term", "run", "docs", F.zip_with("tfs", "lengths", impact).alias("impacts"))
    blocks = impacts.select("bucket", "term", "run", F.size("docs").alias("n"), F.array_max("impacts").alias("top"), "docs", "impacts")
    blocks.write.partitionBy("bucket").parquet(f"{path}/blocks")
    whole.write.parquet(f"{path}/whole")


def read_index(spark: SparkSession, path: str) -> StoredIndex:
    size = spark.read.parquet(f"{path}/whole").first()
    terms, blocks = spark.read.schema(TERMS).parquet(f"{path}/terms"), spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return StoredIndex(terms, blocks, Layout(size["buckets"], size["block"], size["ahead"]), spark.read.schema("doc long, length long, run long").parquet(f"{path}/docs"))


def _opened(runs: DataFrame, wanted: DataFrame, blocks: DataFrame, every: bool) -> DataFrame:
    """query_id, doc, score of the documents in the runs(query_id, run)."""
    held = runs.select("query_id", "run").join(wanted, "query_id").join(blocks.select("bucket", "term", "run", "docs", "impacts"), ["bucket", "term", "run"])
    each = held.select("query_id", "n_terms", "idf", F.explode(F.arrays_zip("docs", "impacts")).alias("p")).select("query_id", "n_terms", F.col("p.docs").alias("doc"), (F.col("idf") * F.col("p.impacts")).alias("part"))
    found = each.groupBy("query_id", "doc").agg((-F.sum("part")).alias("score"), F.count("*").alias("n"), F.max("n_terms").alias("n_terms"))
    return (found.where("n = n_terms") if every else found).select("query_id", "doc", F.round("score", 6).alias("score"))


def bounded_runs(wanted: DataFrame, blocks: DataFrame, every: bool) -> DataFrame:
    """query_id, run, bound: runs of documents that may have hits, with the least (best) score that one can have there. Reads heads only."""
    heads = wanted.join(blocks.select("bucket", "term", "run", "top"), ["bucket", "term"])
    runs = heads.groupBy("query_id", "run").agg((-F.sum(F.col("idf") * F.col("top"))).alias("bound"), F.count("*").alias("n"), F.max("n_terms").alias("n_terms"))
    return (runs.where("n = n_terms") if every else runs).select("query_id", "run", "bound")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run, of rows that are sorted by run."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        run = rows.column("run").to_numpy()
        cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist()]
        for i, j in zip(cuts, cuts[1:]):
            yield rows.slice(i, j - i)
        held = rows.slice(cuts[-1]) if len(run) else held
    if held is not None:
        yield held


def bounds(tops: np.ndarray, asked: Asked) -> np.ndarray:
    """The largest score in millionths that each query can have in a run with these impacts at most; below zero where it can't have a hit."""
    most = np.full(len(asked.need), -1.0)
    if asked.every:
        for q, _, words, weight in asked.each:
            if (tops[words] > 0).all():
                most[q] = millionths(tops[words] @ weight)
    else:
        for numbers, words, weight in asked.parts:
            score = tops[words] @ weight
            most[numbers] = np.where(score > 0, millionths(score), -1)
    return most


def _opened_runs(batches: Iterator[pa.RecordBatch], asked: Asked, least: np.ndarray, some: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(documents, impacts by word) of the runs in which a query may still have a hit. some: a row of word -1 lists the documents that may be shown."""
    for rows in _runs(batches):
        rows = rows.combine_chunks()
        word, top = rows.column("word").to_numpy(), rows.column("top").to_numpy()
        real = word >= 0
        if some and real.all():
            continue
        tops = np.zeros(len(asked.words))
        tops[word[real]] = top[real]
        if not (bounds(tops, asked) >= np.maximum(least - 1, 0)).any():
            continue
        lists = rows.column("docs").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        docs, impacts = lists.flatten().to_numpy(), rows.column("impacts").combine_chunks().flatten().to_numpy()
        of = np.repeat(word, sizes)
        shown = np.unique(docs[of < 0] if some else docs)
        docs, of = docs[of >= 0], of[of >= 0]
        place = np.minimum(np.searchsorted(shown, docs), len(shown) - 1)
        good = shown[place] == docs
        x = np.zeros((len(shown), len(asked.words)))
        x[place[good], of[good]] = impacts[good]
        for first in range(0, len(shown), 500):
            yield pa.array(shown[first : first + 500]), x[first : first + 500]


def top_hits(terms: DataFrame, index: StoredIndex, every: bool, most: int, visible: DataFrame | None = None) -> DataFrame:
    """query_id, doc, score: at least the `most` best visible hits of each query, and no wrong ones. terms: query_id, term, n_terms.

    The words of up to HELD rows are looked up once and go to all tasks; a larger batch of queries stays distributed.
    """
    p, spark = index.layout, terms.sparkSession
    asked = terms.select("query_id", "term", "n_terms").limit(HELD + 1).toArrow()
    if asked.num_rows > HELD:
        return _joined_hits(terms, index, every, most, visible)
    out = terms.select("query_id", F.lit(0).cast("long").alias("doc"), F.lit(0.0).alias("score"))
    if not asked.num_rows:
        return out.limit(0)
    asked = Asked.of(asked, every)
    words = spark.createDataFrame(list(enumerate(asked.words)), "word int, term string").withColumn("bucket", _bucket(p))
    used = sorted({r["bucket"] for r in words.select("bucket").distinct().collect()})  # partitions to read: at most p.buckets numbers
    known, blocks = index.terms.where(F.col("bucket").isin(used)), index.blocks.where(F.col("bucket").isin(used))
    asked.weigh(known.join(F.broadcast(words), ["bucket", "term"]).select("word", "df", "idf").toArrow())
    # Words of no query move neither lists nor heads.
    rows = blocks.join(F.broadcast(words), ["bucket", "term"]).select("run", "word", "top", "docs", "impacts")
    if visible is not None:
        shown = index.docs.join(visible.select("doc"), "doc", "left_semi").groupBy("run").agg(F.collect_list("doc").alias("docs"))
        rows = rows.unionByName(shown.select("run", F.lit(-1).alias("word"), F.lit(0.0).alias("top"), "docs", F.array().cast("array<double>").alias("impacts")))
    some = visible is not None

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(asked.need), -np.inf)
        return asked.best(_opened_runs(batches, asked, least, some), most, least)

    hits = rows.repartition("run").sortWithinPartitions("run").mapInArrow(found, out.schema)
    return hits.select("query_id", "doc", F.round("score", 6).alias("score"))


def _joined_hits(terms: DataFrame, index: StoredIndex, every: bool, most: int, visible: DataFrame | None) -> DataFrame:
    """As top_hits, by joins."""
    p, blocks = index.layout, index.blocks
    wanted = terms.withColumn("bucket", _bucket(p)).join(index.terms, ["bucket", "term"]).select("query_id", "bucket", "term", "n_terms", "idf")
    shown = lambda hits: hits if visible is None else hits.join(visible.select("doc"), "doc", "left_semi").select("query_id", "doc", "score")
    ranked = bounded_runs(wanted, blocks, every).withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("bound", "run")))
    first = shown(_opened(ranked.where(F.col("k") <= p.ahead), wanted, blocks, every))
    needed = first.withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy("score", "doc"))).where(F.col("k") == most).select("query_id", F.col("score").alias("enough"))
    rest = ranked.where(F.col("k") > p.ahead).join(needed, "query_id", "left").where("enough is null or bound <= enough + 1e-6")
    return first.unionByName(shown(_opened(rest, wanted, blocks, every)))


def search(queries: DataFrame, index: StoredIndex, visible: DataFrame | None, limit: int, offset: int = 0) -> DataFrame:
    """As search.search on a stored index: every word must be found."""
    return page(top_hits(query_terms(queries), index, True, offset + limit + 1, visible), limit, offset)


def search_any(queries: DataFrame, index: StoredIndex, stop: list[str], limit: int) -> DataFrame:
    """As search.search_any on a stored index: any of a query's first 40 words counts."""
    terms = query_terms(queries, most=40, stop=stop)
    return page(top_hits(terms, index, False, limit + 1), limit)
