"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.

Defined results, for every stage: only the columns of `documents` are read,
so extra columns with any name make no difference; an empty table gives an
empty table; texts of any length are handled whole. Verdicts are carried by a
key of the whole row, so a null id is a document like others and rows that
repeat an id are judged each on its own; rows that are equal in all columns
share a verdict. What each stage makes of nulls, ties and repeats beyond that
is in its docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.llm import bpe, minhash, mixing, quality_rules, substring
from quire.llm.common import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and a 128-bit key of all of them."""
    present = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in COLUMNS])
    parts = [F.xxhash64(F.lit(seed), present, *COLUMNS) for seed in (1, 2)]
    return docs.select(*COLUMNS, F.struct(parts[0].alias("one"), parts[1].alias("two")).alias("__key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject. A null or empty text has too few words and goes; a null language or source is a group of its own."""
    rows = _keyed(docs)
    kept = quality_rules.quality_rules(rows, id_col="__key").where("kept").select(F.col("doc_id").alias("__key"))
    return rows.join(kept, "__key", "left_semi").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of the smallest id of each group: five-word shingles, similarity 0.8 or more.

    Texts without words and null ids link with nothing and stay. Of rows that
    repeat the smallest id, the one with the least key stays.
    """
    rows = _keyed(docs)
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id")
    chosen = rows.join(kept, "doc_id", "left_semi").withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("__key")))
    return chosen.where("__n = 1").select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that a smaller id has; a document without a word left, or a null text, goes. A null id loses nothing."""
    cut = substring.remove_duplicates(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does; a repeated one has as many rows. Rows that are equal are separate documents of the mix."""
    rows = _keyed(docs)
    chosen = mixing.mix(rows, id_col="__key").groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    # Equal rows are interchangeable: the first one stands for all copies of them.
    first = rows.withColumn("__n", F.row_number().over(W.partitionBy("__key").orderBy("__key"))).where("__n = 1")
    return first.join(chosen, "__key").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their number, by the byte-level vocabulary: a row for each row. A null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, by_space=True)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the robust estimates, the merges or the cube's flight; tests/llm compares the pipeline's rows with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.settle(stage(spark, docs, sf_dir))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
