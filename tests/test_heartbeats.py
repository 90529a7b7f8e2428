"""Heartbeats by timers equal their batch form, whatever the order and the files in which observations come."""

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quire.streaming import heartbeats as H, usage as S

START = datetime(2024, 3, 1, tzinfo=UTC)


def brute(rows, until, patience=120):
    out = set()
    for source in {s for s, _ in rows if s is not None}:
        own = sorted({a for s, a in rows if s == source and a is not None and a < until})
        for i, at in enumerate(own):
            if i == 0 or at - own[i - 1] > patience:
                out.add((source, at, "observed"))
            end = at + patience
            if (own[i + 1] > end) if i + 1 < len(own) else end < until:
                out.add((source, end, "overdue"))
    return out


def told(df):
    return {(r.source, int((r.at.replace(tzinfo=UTC) - START).total_seconds()), r.activity) for r in df.collect()}


def rows_of(seed=2):
    rng = random.Random(seed)
    rows = [(s, t) for s in range(5) for t in (rng.randrange(4000) for _ in range(25))]
    return rows + [rows[0], (None, 5), (3, None), (9, 3990), (8, 0), (8, 120), (8, 241)]


def test_timers_equal_the_batch_form(spark, tmp_path):
    rows = rows_of()
    until = max(t for _, t in rows if t is not None) - 600
    stamp = lambda t: None if t is None else START + timedelta(seconds=t)
    schema = "source long, at timestamp, activity string"
    batch = spark.createDataFrame([(s, stamp(t), "x") for s, t in rows], schema)
    want = brute(rows, until)
    assert told(H.heartbeats(batch, F.lit(START + timedelta(seconds=until)))) == want
    # In files by time, each shuffled within the lateness, one a batch.
    ordered = sorted(rows, key=lambda r: (r[1] or 0) + random.Random(str(r)).uniform(0, 400))
    for i in range(0, len(ordered), 40):
        spark.createDataFrame([(s, stamp(t), "x") for s, t in ordered[i : i + 40]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with H.with_timers(spark):
        got = S.available_now(H.stream_heartbeats(stream, "10 minutes"), str(tmp_path / "run"), "append")
    assert told(got) == want


def test_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "source long, at timestamp")
    assert H.heartbeats(empty, F.lit(START)).count() == 0
    empty.write.parquet(str(tmp_path / "in"))
    with H.with_timers(spark):
        stream = H.stream_heartbeats(spark.readStream.schema("source long, at timestamp").parquet(str(tmp_path / "in")))
        assert S.available_now(stream, str(tmp_path / "run"), "append").count() == 0


def test_the_store_is_put_back(spark):
    before = spark.conf.get(H.STORE)
    with H.with_timers(spark):
        assert spark.conf.get(H.STORE) == H.ROCKS
    assert spark.conf.get(H.STORE) == before
