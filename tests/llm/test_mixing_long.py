"""Mixing with documents that are long against their source's target."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import mixing


def taken_of(spark, sizes, seed):
    rows = [(seed * 100_000 + i, "w " * n, s) for s, own in sizes.items() for i, n in enumerate(own)]
    docs = spark.createDataFrame([(i + 1000 * k, t, s) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(docs)
    return {r["target"]: (r["t"], r["m"]) for r in got.groupBy("target").agg(F.sum("taken").alias("t"), F.max("copies").alias("m")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_one_long_document(spark, seed):
    rng = np.random.default_rng(seed)
    plain = lambda n: rng.integers(5, 60, n).tolist()
    sizes = {"a": plain(300), "b": [450, *plain(270)], "c": [500, 480, 470, *plain(300)], "d": [9000]}
    for target, (words, copies) in taken_of(spark, sizes, seed).items():
        if target < 9000 / 2:  # d has nothing that could make up for its one document
            assert abs(words - target) <= 0.003 * target + 1
        assert copies <= 3


def test_shifts_keep_probabilities_on_average(spark):
    schema = "source string, mark long, row long, size long, prob double"
    small = spark.createDataFrame([("s", i, i, 10 * (i % 7 + 1), 0.3) for i in range(100)] + [("t", 1, 200, 5, 0.6), (None, 1, 300, 5, 0.6)], schema)
    moved = {}
    # Three long documents of 0.3 each: the words over or under what is expected, with their probabilities.
    for k, p in enumerate((0.343, 0.441, 0.189, 0.027)):
        off = spark.createDataFrame([("s", 200.0 * (k - 0.9)), (None, 1e9)], "source string, off double")
        for r in mixing._shifted(small, off).collect():
            moved.setdefault(r["row"], []).append((p, r["prob"], r["size"]))
    for row, parts in moved.items():
        mean = sum(p * x for p, x, _ in parts)
        assert all(0 <= x <= 1 for _, x, _ in parts)
        assert mean == pytest.approx(0.6 if row == 200 else 0.0 if row == 300 else 0.3)
    for k in range(4):
        words = sum(parts[k][1] * parts[k][2] for row, parts in moved.items() if row < 100) + 200.0 * k
        assert words == pytest.approx(sum(0.3 * parts[k][2] for row, parts in moved.items() if row < 100) + 180.0)
