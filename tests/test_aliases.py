"""A source's list of records is written once, not for each of its hits."""

from pathlib import Path

from pyspark.sql import functions as F

from quire.operators import search as S


def test_lists_are_written_once(spark, tmp_path):
    books = spark.range(300_000).select(F.col("id").alias("book_id"), F.concat(F.lit("s"), F.col("id") % 400).alias("source_id"))
    hits = spark.range(8_000).select(F.col("id").alias("hit"), F.concat(F.lit("s"), F.col("id") % 401).alias("source_id"))
    S.attach_aliases(hits, books, ",").write.parquet(f"{tmp_path}/out")
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/out").glob("*.parquet")) < 6_000_000
    found = spark.read.parquet(f"{tmp_path}/out").select("hit", F.split("aliases", ",").cast("array<long>").alias("aliases"))
    assert found.count() == 8_000
    wrong = found.where((F.col("hit") % 401 < 400) & ((F.size("aliases") != 750) | (F.col("aliases")[1] != F.col("hit") % 401 + 400)))
    assert wrong.count() == 0
    assert found.where("aliases is null").count() == 19
