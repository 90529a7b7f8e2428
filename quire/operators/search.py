"""Index and search: inverted index, BM25, fuzzy terms, snippets, catalog search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quire.functions.text import tokens

#: BM25 constants of the full-text engine whose ranking is kept.
K1, B = 1.2, 0.75
#: Most rows of query words that come to the driver and go to all tasks.
HELD = 100_000
#: Most words whose counts in a part of the documents are laid out in full; of more words only those that are there are sorted.
DENSE = 10_000


@dataclass
class Index:
    """postings(term, doc, tf), stats(doc, length), vocab(term, df), and counts(term, doc, tf, n) that they come from; sections keep title and text.

    words: doc and an array of tokens for each field, with the fields' weights. terms: the distinct tokens.
    """

    postings: DataFrame
    stats: DataFrame
    vocab: DataFrame
    terms: DataFrame
    counts: DataFrame
    words: DataFrame
    weights: list[float]


def build_index(sections: DataFrame, weights: dict[str, float] | None = None) -> Index:
    """From sections(doc, <fields>): tf is the weighted sum over the fields; length counts all tokens.

    Texts are shuffled once, by document: what follows by document, counts, lengths or hits, stays where it is.
    """
    weights = weights or {"text": 1.0}
    weighed = lambda field, w: F.transform(tokens(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(float(w)).alias("w")))
    none = F.array().cast("array<struct<term:string,w:double>>")
    words = F.concat(*[F.coalesce(weighed(field, w), none) for field, w in weights.items()])
    tf = sections.repartition("doc").select("doc", F.explode(words).alias("x")).select("doc", "x.term", "x.w")
    postings = tf.groupBy("term", "doc").agg(F.sum("w").alias("tf"), F.count("*").alias("n"))
    stats = tf.groupBy("doc").agg(F.count("*").alias("length"))
    vocab = postings.groupBy("term").agg(F.count("*").alias("df"))
    fields = sections.repartition("doc").select("doc", *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f"words_{f}") for f in weights])
    # All fields' tokens of a batch of documents are told apart before any row is made of them.
    lists = sections.select(*[tokens(F.col(f)).alias(f"words_{f}") for f in weights]).mapInArrow(_distinct_tokens, "term string")
    return Index(postings.select("term", "doc", "tf"), stats, vocab, lists.distinct(), postings, fields, [float(w) for w in weights.values()])


def _distinct_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pc.unique(pa.concat_arrays([column.flatten() for column in batch.columns]))], names=["term"])


def query_terms(queries: DataFrame, most: int | None = None, stop: list[str] | None = None) -> DataFrame:
    """query_id, term, n_terms: the distinct tokens of each query, the first `most` if that is given."""
    words = F.array_distinct(tokens(F.col("query")))
    if stop:
        words = F.array_except(words, F.array(*[F.lit(s) for s in stop]))
    if most is not None:
        words = F.slice(words, 1, most)
    rows = queries.select("query_id", words.alias("words"))
    return rows.select("query_id", F.explode("words").alias("term"), F.size("words").alias("n_terms"))


def _idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def _score_pairs(terms: DataFrame, index: Index, every: bool, visible: DataFrame | None = None) -> DataFrame:
    """As score, with a row for each query, document and word: for more query words than HELD.

    If every term counts, only documents that have the rarest word of some query are looked at.
    """
    whole = index.stats.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length"))
    held = index.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    wanted = terms.join(held.groupBy("term").agg(F.count("*").alias("df")), "term")
    postings = held if visible is None else held.join(visible.select("doc"), "doc", "left_semi")
    if every:
        rare = wanted.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term")).select("term").distinct()
        likely = postings.join(F.broadcast(rare), "term", "left_semi").select("doc").distinct()
        postings = postings.join(likely, "doc", "left_semi")
    hits = postings.join(index.stats, "doc").join(F.broadcast(wanted), "term").join(F.broadcast(whole))  # one row
    part = _idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    found = hits.groupBy("query_id", "doc").agg((-F.sum(part)).alias("score"), F.count("*").alias("n"), F.max("n_terms").alias("n_terms"))
    return (found.where("n = n_terms") if every else found).select("query_id", "doc", F.round("score", 6).alias("score"))


@dataclass
class Asked:
    """Words and queries as numbers: a query's words, their weights in it and how many it needs; words[i] is word i."""

    ids: pa.Array
    words: list[str]
    word: np.ndarray
    query: np.ndarray
    need: np.ndarray
    idf: np.ndarray
    df: np.ndarray
    every: bool

    @classmethod
    def of(cls, terms: pa.Table, every: bool) -> "Asked":
        """From rows of query_id, term, n_terms; idf and df are set by `weigh`."""
        codes = pc.dictionary_encode(terms.column("query_id").combine_chunks(), null_encoding="encode")
        words = sorted(set(terms.column("term").to_pylist()))
        word = pc.index_in(terms.column("term"), pa.array(words, pa.string())).to_numpy()
        query = codes.indices.to_numpy(zero_copy_only=False)
        need = np.zeros(len(codes.dictionary), np.int64)
        np.maximum.at(need, query, terms.column("n_terms").to_numpy())
        return cls(codes.dictionary, words, word.astype(np.int64), query.astype(np.int64), need, np.zeros(len(words)), np.zeros(len(words), np.int64), every)

    def weigh(self, found: pa.Table) -> "Asked":
        """With found(word, df, idf)."""
        at = found.column("word").to_numpy()
        self.idf[at], self.df[at] = found.column("idf").to_numpy(), found.column("df").to_numpy()
        return self

    @cached_property
    def parts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries in parts of 128: their numbers, the words that are in the index, and a weight for each word and query."""
        out = []
        for first in range(0, len(self.need), 128):
            at = (self.query >= first) & (self.query < first + 128) & (self.df[self.word] > 0)
            words, row = np.unique(self.word[at], return_inverse=True)
            weight = np.zeros((len(words), min(128, len(self.need) - first)))
            np.add.at(weight, (row, self.query[at] - first), self.idf[self.word[at]])
            out.append((np.arange(first, first + weight.shape[1]), words, weight))
        return out

    @cached_property
    def each(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Queries whose words are all in the index: number, rarest word, words and their weights."""
        order = np.argsort(self.query, kind="stable")
        cuts = np.searchsorted(self.query[order], np.arange(len(self.need) + 1))
        out = []
        for q in range(len(self.need)):
            words = self.word[order[cuts[q] : cuts[q + 1]]]
            if len(words) and len(words) == self.need[q] and (self.df[words] > 0).all():
                out.append((q, int(words[np.argmin(self.df[words])]), words, self.idf[words]))
        return out

    def scores(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, score) of the hits in x, a row of impacts by word, whose score in millionths is no less than the query's least."""
        rows, queries, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if self.every:
            for q, rare, words, weight in self.each:
                row = np.flatnonzero(x[:, rare])
                if len(row):
                    own = x[np.ix_(row, words)]
                    row, score = row[(own > 0).all(1)], own[(own > 0).all(1)] @ weight
                    good = millionths(score) >= least[q]
                    rows.append(row[good]), queries.append(np.full(good.sum(), q)), found.append(score[good])
        else:
            for numbers, words, weight in self.parts:
                score = x[:, words] @ weight
                row, q = np.nonzero((score > 0) & (millionths(score) >= least[numbers]))
                rows.append(row), queries.append(numbers[q]), found.append(score[row, q])
        return np.concatenate(rows), np.concatenate(queries), np.concatenate(found)

    def best(self, parts: Iterator[tuple[pa.Array, np.ndarray]], most: int | None, least: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """query_id, doc, score over (documents, impacts): all hits of a task or the `most` best of each query.

        least, by query, rises to the last of the best, so that its reader may leave out what can't be among them.
        """
        least = np.full(len(self.need), -np.inf) if least is None else least
        held, n = [], 0
        for docs, x in parts:
            row, query, score = self.scores(x, least)
            if len(row):
                held.append(pa.table([pa.array(query), docs.take(pa.array(row)), pa.array(score), pa.array(-millionths(score))], names=["query", "doc", "score", "rank"]))
                n += len(row)
            if most is None or n > 2 * most * len(self.need) + 1000:
                held = self._kept(held, most, least) if most is not None else held
                if most is None and held:
                    yield self._named(held)
                    held = []
                n = sum(len(t) for t in held)
        if held:
            yield self._named(self._kept(held, most, least) if most is not None else held)

    def _kept(self, held: list[pa.Table], most: int, least: np.ndarray) -> list[pa.Table]:
        rows = pa.concat_tables(held).sort_by([("query", "ascending"), ("rank", "ascending"), ("doc", "ascending")])
        query, rank = rows.column("query").to_numpy(), rows.column("rank").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == most - 1
        least[query[last]] = -rank[last]
        return [rows.filter(pa.array(place < most))]

    def _named(self, held: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(held).combine_chunks()
        query, doc, score = (rows.column(c).combine_chunks() for c in ("query", "doc", "score"))
        return pa.RecordBatch.from_arrays([self.ids.take(query), doc, pc.negate(score)], names=["query_id", "doc", "score"])


def millionths(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5)


def _asked_counts(index: Index, words: list[str]) -> DataFrame:
    """doc, length, terms, tfs: a document's number of tokens, and the numbers and weighted counts of the words asked for.

    Tokens are told apart while a document is at hand, so only a row for each document is written and read again.
    """
    weights, n_words = index.weights, len(words)
    known, step = pa.array(words, pa.string()), max(1, min(500, 2_000_000 // n_words))
    schema = index.words.select("doc", F.lit(0).cast("long").alias("length"), F.array().cast("array<int>").alias("terms"), F.array().cast("array<double>").alias("tfs")).schema

    def dense(keys: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        tf = sum(weight * np.bincount(key, minlength=size) for weight, key in zip(weights, keys))
        return (key := np.flatnonzero(tf)), tf[key]

    def sparse(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        parts = np.split(place, np.cumsum([len(key) for key in keys])[:-1])
        return found, sum(weight * np.bincount(part, minlength=len(found)) for weight, part in zip(weights, parts))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            length, found = np.zeros(n, np.int64), []
            for column in batch.columns[1:]:
                offsets = column.offsets.to_numpy()
                at = pc.index_in(column.values.slice(offsets[0], offsets[-1] - offsets[0]), known).fill_null(-1).to_numpy()
                found.append((offsets - offsets[0], at))
                length += np.diff(offsets)
            for first in range(0, n, step if n_words <= DENSE else 500):
                to = min(n, first + (step if n_words <= DENSE else 500))
                keys = []
                for offsets, at in found:
                    own = at[offsets[first] : offsets[to]].astype(np.int64)
                    keys.append((np.repeat(np.arange(to - first) * n_words, np.diff(offsets[first : to + 1])) + own)[own >= 0])
                key, tf = dense(keys, (to - first) * n_words) if n_words <= DENSE else sparse(keys)
                bounds = pa.array(np.searchsorted(key, np.arange(to - first + 1) * n_words), pa.int32())
                terms = pa.ListArray.from_arrays(bounds, pa.array(key % n_words, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, to - first), pa.array(length[first:to]), terms, pa.ListArray.from_arrays(bounds, pa.array(tf))], names=["doc", "length", "terms", "tfs"])

    rows = index.words.mapInArrow(counted, schema).where("length > 0")
    # Rows that repeat a document are one; texts have been dealt by document, so hardly anything moves.
    lists = F.collect_list(F.struct("terms", "tfs")).alias("x")
    rows = rows.groupBy("doc").agg(F.sum("length").alias("length"), lists)
    return rows.select("doc", "length", F.flatten("x.terms").alias("terms"), F.flatten("x.tfs").alias("tfs"))


def score(terms: DataFrame, index: Index, every: bool, visible: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """query_id, doc, score (smaller is better). every: all terms of the query must be in the document.

    Only visible documents are scored; document counts and lengths are those of the whole index.
    Queries are few beside the index: their words go to all tasks, and a document meets all
    queries while it is at hand. No row of a query, document and word is made, and with
    `most` a task gives no more than a query's best hits, at least as many as that.
    """
    asked = terms.select("query_id", "term", "n_terms").limit(HELD + 1).toArrow()
    if asked.num_rows > HELD:
        return _score_pairs(terms, index, every, visible)
    out = terms.select("query_id").limit(0).crossJoin(index.words.select("doc").limit(0)).select("query_id", "doc", F.lit(0.0).alias("score"))
    if not asked.num_rows:
        return out
    asked = Asked.of(asked, every)
    spark, held = terms.sparkSession, _asked_counts(index, asked.words)
    if spark.sparkContext.getCheckpointDir():
        held = held.checkpoint()  # texts are tokenized once
    whole = held.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_length")).first()
    df = held.select(F.explode(F.array_distinct("terms")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    asked.weigh(df.select("word", "df", _idf(F.lit(whole["n_docs"]), F.col("df")).alias("idf")).toArrow())
    rows = held.where("doc is not null and size(terms) > 0")
    rows = rows if visible is None else rows.join(visible.select("doc"), "doc", "left_semi")
    average, n_words = whole["avg_length"], len(asked.words)
    step = max(1, min(500, 2_000_000 // n_words))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            words, tf = batch.column("terms").flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
            sizes, length = np.diff(batch.column("terms").offsets.to_numpy()), batch.column("length").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            count = np.zeros((batch.num_rows, n_words))
            np.add.at(count, (row, words), tf)
            tf = count[row, words]
            count[row, words] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average))
            yield batch.column("doc"), count

    hits = rows.select("doc", "length", "terms", "tfs").mapInArrow(lambda batches: asked.best(parts(batches), most), out.schema)
    return hits.select("query_id", "doc", F.round("score", 6).alias("score"))


def page(hits: DataFrame, limit: int, offset: int = 0, by: str = "query_id") -> DataFrame:
    """A page of each query's hits: pos from 1 and next_offset, null at the end."""
    order = W.partitionBy(by).orderBy("score", "doc")
    ranked = hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos").between(offset + 1, offset + limit + 1))
    more = F.max("pos").over(W.partitionBy(by)) > offset + limit
    return ranked.withColumn("next_offset", F.when(more, F.lit(offset + limit))).where(F.col("pos") <= offset + limit)


def scope(docs: DataFrame, sources: list[str] | None = None, lang: str | None = None, doc_format: Column | None = None) -> DataFrame:
    """The ids that searches may show."""
    if sources is not None:
        docs = docs.where(F.col("source").isin(*sources))
    if lang is not None:
        docs = docs.where(F.col("lang") == lang)
    if doc_format is not None:
        docs = docs.where(doc_format)
    return docs


def search(queries: DataFrame, index: Index, visible: DataFrame | None, limit: int, offset: int = 0) -> DataFrame:
    """Every word must be found; filters decide visibility only."""
    return page(score(query_terms(queries), index, True, visible, offset + limit + 1), limit, offset)


def search_any(queries: DataFrame, index: Index, stop: list[str], limit: int, expansions: DataFrame | None = None) -> DataFrame:
    """Any of a query's first 40 words counts; expansions(term, extra) fill up to 40 terms, a query's own words first."""
    terms = query_terms(queries, most=40, stop=stop).select("query_id", "term")
    if expansions is not None:
        more = terms.join(expansions, "term").select("query_id", F.col("extra").alias("term"))
        both = terms.withColumn("own", F.lit(0)).unionByName(more.withColumn("own", F.lit(1))).groupBy("query_id", "term").agg(F.min("own").alias("own"))
        order = W.partitionBy("query_id").orderBy("own", "term")
        terms = both.withColumn("k", F.row_number().over(order)).where("k <= 40").select("query_id", "term")
    return page(score(terms.withColumn("n_terms", F.lit(0)), index, every=False, most=limit + 1), limit)


def passages(hits: DataFrame, texts: DataFrame, limit: int, least: int = 40) -> DataFrame:
    """Of ranked hits, those whose text has `least` characters, one per span; a new rank."""
    kept = hits.join(texts.select("doc", "span", F.length("text").alias("chars")), "doc").where(F.col("chars") >= least)
    one = kept.withColumn("k", F.row_number().over(W.partitionBy("query_id", "span").orderBy("pos", "doc"))).where("k = 1")
    order = W.partitionBy("query_id").orderBy("pos", "doc")
    return one.withColumn("passage", F.row_number().over(order)).where(F.col("passage") <= limit).select("query_id", "doc", "span", "score", "passage")


def _letters(word: str) -> Column:
    """The letters and digits of a word as bits. An edit changes two of them at most."""
    bits = [F.when(F.contains(F.col(word), F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def near_words(terms: DataFrame, vocab: DataFrame, edits: int = 2) -> DataFrame:
    """term, match, gain: for each distinct term the vocabulary words within the edits, of those that share the first letter.

    Length is blocked by explicit values, so the join is an equi-join on letter and length. Words
    whose letters differ too much are left out before edits are counted.
    """
    left = terms.select("term").distinct().select("term", F.substring("term", 1, 1).alias("head"), _letters("term").alias("bits"), F.explode(F.sequence(F.length("term") - edits, F.length("term") + edits)).alias("size"))
    right = vocab.select(F.col("term").alias("match"), F.substring("term", 1, 1).alias("head"), F.length("term").alias("size"), _letters("term").alias("own"))
    apart = F.when(F.bit_count(F.col("bits").bitwiseXOR(F.col("own"))) <= 2 * edits, F.levenshtein("term", "match", edits)).otherwise(F.lit(-1))
    near = right.join(F.broadcast(left), ["head", "size"]).withColumn("apart", apart).where("apart >= 0")
    return near.select("term", "match", (1 - F.col("apart") / F.greatest(F.length("term"), F.lit(1))).alias("gain"))


@dataclass
class Near:
    """Words of the index near the terms asked for, as numbers: words[i] is near the terms term[cut[i]:cut[i + 1]], with their gains."""

    terms: list[str]
    words: list[str]
    cut: np.ndarray
    term: np.ndarray
    gain: np.ndarray

    @classmethod
    def of(cls, terms: list[str], near: pa.Table) -> "Near":
        """From rows of term, match, gain."""
        near = near.sort_by("match")
        words = pc.unique(near.column("match"))
        cut = np.searchsorted(pc.index_in(near.column("match"), words).to_numpy(), np.arange(len(words) + 1))
        return cls(terms, words.to_pylist(), cut, pc.index_in(near.column("term"), pa.array(terms, pa.string())).to_numpy(), near.column("gain").to_numpy())

    def gains(self, counts: pa.RecordBatch) -> np.ndarray:
        """Documents by terms: the best weight * gain of a term in documents(terms, tfs), which hold numbers of words; minus infinity without any."""
        word, tf = counts.column("terms").flatten().to_numpy(), counts.column("tfs").flatten().to_numpy()
        row = np.repeat(np.arange(counts.num_rows), np.diff(counts.column("terms").offsets.to_numpy()))
        key = row * len(self.words) + word
        if (np.diff(key) <= 0).any():  # rows that repeat a document have been put together
            key, place = np.unique(key, return_inverse=True)
            row, word, tf = key // len(self.words), key % len(self.words), np.bincount(place, tf)
        n = self.cut[word + 1] - self.cut[word]
        at = np.arange(n.sum()) + np.repeat(self.cut[word] - np.cumsum(n) + n, n)
        out = np.full(counts.num_rows * len(self.terms), -np.inf)
        np.maximum.at(out, np.repeat(row, n) * len(self.terms) + self.term[at], self.gain[at] * np.repeat(tf, n))
        return out.reshape(counts.num_rows, len(self.terms))


def _near(words: list[list[str]], index: Index, edits: int) -> Near:
    """What is near the words of the queries; like these it goes to all tasks."""
    terms = sorted({w for own in words for w in own})
    asked = index.terms.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return Near.of(terms, near_words(asked, index.terms, edits).toArrow())


def _asked_words(queries: DataFrame) -> tuple[pa.Array, list[list[str]]]:
    """The ids and the distinct words of the queries that have any."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("words")).where("size(words) > 0").toArrow()
    return asked.column("query_id").combine_chunks(), asked.column("words").to_pylist()


def search_fuzzy(queries: DataFrame, index: Index, targets: DataFrame, limit: int, edits: int = 2) -> DataFrame:
    """Weighted typo-tolerant hits, one per target: the sum over terms of the best weight * (1 - edits / length).

    Ties go to the smaller target. Terms without any match are dropped. A document meets all
    queries while it is at hand, and a task gives only the best targets of each, so no row of a
    query and a document is made.
    """
    ids, words = _asked_words(queries)
    out = targets.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "target", F.lit(0.0).alias("gain")).limit(0)
    near = _near(words, index, edits) if words else None
    if near and near.words:
        number = {t: i for i, t in enumerate(near.terms)}
        pairs = np.array(sorted((number[w], q) for q, own in enumerate(words) for w in own))
        cut, query = np.searchsorted(pairs[:, 0], np.arange(len(number) + 1)), pairs[:, 1]
        n_queries, step = len(words), max(1, 2_000_000 // max(len(number), len(words)))

        def met(docs: pa.RecordBatch, least: np.ndarray) -> pa.Table:
            gains = near.gains(docs)
            row, term = np.nonzero(gains > -np.inf)
            n = cut[term + 1] - cut[term]
            key = np.repeat(row * n_queries, n) + query[np.arange(n.sum()) + np.repeat(cut[term] - np.cumsum(n) + n, n)]
            total = millionths(np.bincount(key, np.repeat(gains[row, term], n), docs.num_rows * n_queries))
            total[np.bincount(key, minlength=len(total)) == 0] = -np.inf
            row, q = np.nonzero((total := total.reshape(docs.num_rows, n_queries)) >= np.maximum(least, -1e300))
            return pa.table([pa.array(q), docs.column("target").take(pa.array(row)), pa.array(total[row, q])], names=["query", "target", "gain"])

        def kept(rows: pa.Table, least: np.ndarray) -> pa.Table:
            rows = rows.group_by(["query", "target"]).aggregate([("gain", "max")]).rename_columns({"gain_max": "gain"})
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("gain", "descending"), ("target", "ascending")], null_placement="at_start"))
            q = rows.column("query").to_numpy()
            place = np.arange(len(q)) - np.searchsorted(q, q)
            least[q[place == limit - 1]] = rows.column("gain").to_numpy()[place == limit - 1]
            return rows.filter(pa.array(place < limit)).select(["query", "target", "gain"])

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, least = None, np.full(n_queries, -np.inf)
            for docs in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
                rows = met(docs, least)
                held = kept(rows if held is None else pa.concat_tables([held, rows]), least)
            if held is not None and held.num_rows:
                columns = (held.column(c).combine_chunks() for c in ("query", "target", "gain"))
                q, target, gain = columns
                yield pa.RecordBatch.from_arrays([ids.take(q), target, pc.divide(gain, 1e6)], names=["query_id", "target", "gain"])

        rows = _asked_counts(index, near.words).where("size(terms) > 0").join(targets.select("doc", "target"), "doc")
        out = rows.select("target", "terms", "tfs").mapInArrow(fold, out.schema)
    by_target = out.groupBy("query_id", "target").agg(F.max("gain").alias("gain"))
    order = W.partitionBy("query_id").orderBy(F.desc("gain"), "target")
    return by_target.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def _first_words(found: DataFrame, ids: pa.Array, words: list[list[str]], near: Near, enough: int, kind: T.DataType) -> DataFrame:
    """query_id, words, gain and found's columns: in documents(doc, target, .., terms, tfs) the first words of each query.

    Queries, few beside the index, go to all tasks. A document meets all of them while it is at hand, so pairs of a query
    and a document are never sorted or shuffled. A task leaves out what can't be a hit: all but a target's best document, and
    those with fewer words than `enough` targets of the task have.
    """
    number = {t: i for i, t in enumerate(near.terms)}
    asked = [[number[w] for w in own] for own in words]
    kept = [c for c in found.columns if c not in ("terms", "tfs")]
    schema = found.select(F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("words"), F.lit(0.0).alias("gain"), *kept).schema
    step = max(1, 2_000_000 // len(number))

    def met(docs: pa.RecordBatch, least: np.ndarray) -> pa.Table:
        """query, words, gain and the columns of documents that have at least as many first words as a query's least."""
        gains = near.gains(docs)
        there = gains > -np.inf
        query, rows, count, gain = [], [], [], []
        for q, own in enumerate(asked):
            row = np.flatnonzero(there[:, own[0]])
            n, total = np.ones(len(row), np.int32), gains[row, own[0]]
            on = np.arange(len(row))
            for word in own[1:]:
                on = on[there[row[on], word]]
                if not len(on):
                    break
                n[on] += 1
                total[on] += gains[row[on], word]
            good = n >= least[q]
            query.append(np.full(good.sum(), q)), rows.append(row[good]), count.append(n[good]), gain.append(total[good])
        held = docs.select(kept).take(pa.array(np.concatenate(rows)))
        return pa.table([pa.array(np.concatenate(query)), pa.array(np.concatenate(count)), pa.array(millionths(np.concatenate(gain)) / 1e6), *held.columns], names=["query", "words", "gain", *kept])

    def best(rows: pa.Table, least: np.ndarray) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("words", "descending"), ("gain", "descending"), ("doc", "ascending")], null_placement="at_start"))
        first = pa.table([rows.column("query"), rows.column("target"), pa.array(np.arange(rows.num_rows))], names=["query", "target", "at"]).group_by(["query", "target"]).aggregate([("at", "min")])
        rows = rows.take(pa.array(np.sort(first.column("at_min").to_numpy())))
        q, n = rows.column("query").to_numpy(), rows.column("words").to_numpy()
        last = np.arange(len(q)) - np.searchsorted(q, q) == enough - 1
        least[q[last]] = np.maximum(least[q[last]], n[last])
        return rows.filter(pa.array(n >= least[q]))

    def named(rows: pa.Table) -> list[pa.RecordBatch]:
        rows = rows.combine_chunks()
        return rows.set_column(0, "query_id", ids.take(rows.column("query").combine_chunks())).to_batches() if rows.num_rows else []

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, least = [], 0, np.ones(len(asked), np.int64)
        for docs in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            held.append(met(docs, least))
            n += held[-1].num_rows
            if n > 50_000:
                held = [best(pa.concat_tables(held), least)]
                n = held[0].num_rows
                if n > 25_000:
                    yield from named(held[0])
                    held, n = [], 0
        if held:
            yield from named(best(pa.concat_tables(held), least))

    return found.mapInArrow(fold, schema)


def search_relaxed(
    queries: DataFrame, index: Index, units: DataFrame, limit: int, offset: int = 0, enough: int = 100, edits: int = 2, editions: list | None = None, kinds: list | None = None, candidates: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(hits, facets): typo-tolerant hits that have all words of a query, or fewer of its last words if these are too few.

    units: doc, target, edition, kind, state; only those of the editions and kinds, and no candidates unless they are asked for.
    hits: query_id, doc, target, words, gain, pos, next_offset. facets: query_id, facet, value, n.

    A document has the first k words of a query if each of them, or a word within the edits, is in it. A
    query keeps as many of its first words as leave `enough` targets, else the first alone. Hits with more of the words
    come first, then those with the larger sum of weight * (1 - edits / length), then the smaller document; each
    target has its best one. Facets count targets of all hits, not of the page. How many words are
    kept is read off the hit at place `enough`, so no query is searched twice.
    """
    shown = units if candidates else units.where(F.coalesce(F.col("state") != "candidate", F.lit(True)))
    for column, wanted in (("edition", editions), ("kind", kinds)):
        if wanted is not None:
            shown = shown.where(F.col(column).isin(*wanted))
    ids, words = _asked_words(queries)
    kind = queries.schema["query_id"].dataType
    near = _near(words, index, edits) if words else None
    if near and near.words:
        counts = _asked_counts(index, near.words).where("size(terms) > 0").select("doc", "terms", "tfs")
        scored = _first_words(counts.join(shown.select("doc", "target", "edition", "kind"), "doc").select("doc", "target", "edition", "kind", "terms", "tfs"), ids, words, near, enough, kind)
    else:
        scored = shown.select(F.lit(None).cast(kind).alias("query_id"), F.lit(0).alias("words"), F.lit(0.0).alias("gain"), "doc", "target", "edition", "kind").limit(0)
    order = [F.desc("words"), F.desc("gain"), "doc"]
    one = first_of(scored, ["query_id", "target"], order)
    ranked = one.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    least = F.max(F.when(F.col("pos") == max(enough, 1), F.col("words"))).over(W.partitionBy("query_id"))
    hits = ranked.withColumn("least", least).where(F.col("words") >= F.coalesce("least", F.lit(1)))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("edition", "kind")]))
    facets = hits.select("query_id", values.alias("f")).groupBy("query_id", "f.facet", "f.value").agg(F.count("*").alias("n"))
    ranked = hits.where(F.col("pos").between(offset + 1, offset + limit + 1))
    more = F.max("pos").over(W.partitionBy("query_id")) > offset + limit
    paged = ranked.withColumn("next_offset", F.when(more, F.lit(offset + limit))).where(F.col("pos") <= offset + limit)
    return paged.select("query_id", "doc", "target", "words", "gain", "pos", "next_offset"), facets


def search_catalog(books: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive part of title, author or tag; books of one source are aliases of one row."""
    low = F.lit(needle.lower())
    hit = F.contains(F.lower("title"), low) | F.exists("authors", lambda a: F.contains(F.lower(a), low)) | F.exists("tags", lambda t: F.contains(F.lower(t), low))
    found = books.where(hit).groupBy("source_id").agg(F.min_by("title", "book_id").alias("title"), F.array_sort(F.collect_set("book_id")).alias("book_ids"))
    return found.orderBy("title", "source_id")


def attach_aliases(hits: DataFrame, books: DataFrame, separator: str | None = None, parts: int = 200) -> DataFrame:
    """Every catalog record of a hit's source, as an array or, with a separator, as a text that is made once for each source.

    A long list is in the row of each hit, so the result may be much larger than both tables. Hits of
    a source lie together in one of the parts, where a column's dictionary holds each list once.
    """
    records = F.array_sort(F.collect_set("book_id"))
    by_source = books.groupBy("source_id").agg((records if separator is None else F.array_join(records, separator)).alias("aliases"))
    return hits.repartition(parts, "source_id").join(by_source, "source_id", "left")


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def snippets(hits: DataFrame, texts: DataFrame, terms: DataFrame, width: int = 40, most: int = 500) -> DataFrame:
    """query_id, doc, snippet: the earliest of the windows that hold the most occurrences of the query's terms."""
    words = hits.select("query_id", "doc").join(texts.select("doc", tokens(F.col("text")).alias("words")), "doc")
    placed = words.select("query_id", "doc", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
    marked = placed.join(terms.select("query_id", "term", F.lit(1).alias("hit")), ["query_id", "term"], "left")
    ahead = W.partitionBy("query_id", "doc").orderBy("at").rowsBetween(0, width - 1)
    counted = marked.withColumn("held", F.sum(F.coalesce("hit", F.lit(0))).over(ahead)).where((F.col("at") + width <= F.col("n")) | (F.col("at") == 0))
    best = counted.groupBy("query_id", "doc").agg(F.max(F.struct("held", (-F.col("at")).alias("back"))).alias("m"))
    cut = words.join(best.select("query_id", "doc", (-F.col("m.back")).alias("at")), ["query_id", "doc"])
    body = F.array_join(F.slice("words", F.col("at") + 1, width), " ")
    head = F.when(F.col("at") > 0, F.lit("…")).otherwise(F.lit(""))
    tail = F.when(F.col("at") + width < F.size("words"), F.lit("…")).otherwise(F.lit(""))
    return cut.select("query_id", "doc", F.substring(F.concat(head, body, tail), 1, most).alias("snippet"))


def units_digest(units: DataFrame, by: str, key: str, parts: list[str], buckets: int = 64) -> DataFrame:
    """A digest of each group that depends on its rows alone: of row digests by bucket, then of the buckets."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in parts]), 256)
    rows = units.select(by, F.pmod(F.col(key), F.lit(buckets)).alias("bucket"), F.struct(F.col(key).alias("k"), row.alias("d")).alias("r"))
    inner = rows.groupBy(by, "bucket").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["d"]), ""), 256).alias("d"))
    return inner.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def rank_decisions(results: DataFrame, slack: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(ranked, invalid) of (subject, probabilities map): values in 0..1 that sum to 1; larger first, then key."""
    p = F.map_values("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    sound = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= slack)
    marked = results.withColumn("sound", F.coalesce(sound, F.lit(False)))
    entries = marked.where("sound").select("subject", F.explode("probabilities").alias("choice", "probability"))
    order = W.partitionBy("subject").orderBy(F.desc("probability"), "choice")
    return entries.withColumn("pos", F.row_number().over(order)), marked.where("not sound").select("subject")
