"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest

from quire.operators import consensus as C
from quire.operators import reports as R
from quire.operators import usage as U
from quire.streaming import stateful as S
from quire.streaming import usage as SU


@pytest.fixture()
def run(spark, tmp_path):
    def go(rows, schema, build, mode):
        """The rows in five files, read one file a batch in order."""
        source = tmp_path / "in"
        for i in range(5):
            part = rows[len(rows) * i // 5 : len(rows) * (i + 1) // 5]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        return SU.available_now(build(stream), str(tmp_path / "run"), mode)

    return go


START = datetime(2024, 1, 1)
EVENTS = [(i % 3, i, START + timedelta(minutes=7 * i)) for i in range(60)]
SCHEMA = "user long, id long, at timestamp"


def test_rolling_limit(spark, run):
    want = R.rolling_limit(spark.createDataFrame(EVENTS, SCHEMA), "user", most=2)
    got = run(EVENTS, SCHEMA, lambda s: S.stream_rolling_limit(s, "user", most=2), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_personal(spark, run):
    rows = [(i % 2, i, i % 17, "remove" if i % 5 == 0 else "save", i % 7) for i in range(80)]
    schema = "owner long, seq long, op long, kind string, place long"
    want = C.fold_personal(spark.createDataFrame(rows, schema), most=4)
    got = run(rows, schema, lambda s: S.stream_personal(s, most=4), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_events_are_dropped(run):
    rows = [(1, i, START + timedelta(hours=h)) for i, h in enumerate((0, 72, 73, 74, 1))]
    got = run(rows, SCHEMA, SU.stream_daily, "update").groupBy("day").max("n")
    assert sorted((r.day.day, r["max(n)"]) for r in got.collect()) == [(1, 1), (4, 3)]


def test_dedupe(run):
    rows = [(1, i % 4, START + timedelta(minutes=i)) for i in range(30)]
    got = run(rows, SCHEMA, SU.stream_dedupe, "append")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3]


def test_sessions(spark, run):
    want = U.sessionize(spark.createDataFrame(EVENTS, SCHEMA), "user", "30 minutes")
    got = run(EVENTS, SCHEMA, lambda s: SU.stream_sessions(s, "user", "30 minutes"), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
