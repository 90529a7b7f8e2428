"""Heartbeats of sources on a stream, by event-time timers, and reports as a stream of files.

An observation starts an episode of its source unless one came within
`seconds` before it; a source whose last observation is longer ago is
overdue. The stream holds observations back until the watermark has passed
them, so the order in which they arrive within the lateness doesn't matter,
and timers wake a source when the watermark reaches its next observation or
the end of its patience. Timers follow the watermark and no clock: a stream
over what is there ends, and gives what the batch form gives for the time
before the last watermark.

State of a source: observations not yet passed, the last one, and whether the
source is overdue. It needs the RocksDB state store, as all of Spark's timers do.

Defined results: a null source or time is left out; observations of one
moment are one; an empty stream gives nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from quire.functions.islands import with_islands
from quire.sources.library import REPORT

ACTIVITY = "source long, at timestamp, activity string"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def heartbeats(observations: DataFrame, until: Column, seconds: int = 120) -> DataFrame:
    """source, at, activity of observations(source, at) before `until`: observed at the start of an episode, overdue at its end.

    Episodes are the islands between gaps, found without bringing a source's rows together.
    """
    millis = F.unix_millis("at")
    rows = observations.where("source is not null and at is not null").select("source", millis.alias("ms")).where(F.col("ms") < F.unix_millis(until))
    episodes = with_islands(rows, "source", "ms", seconds * 1000 + 1).groupBy("source", "island").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    end = F.col("last") + seconds * 1000
    over = F.when(end < F.unix_millis(until), F.struct(F.timestamp_millis(end).alias("at"), F.lit("overdue").alias("activity")))
    both = F.array_compact(F.array(F.struct(F.timestamp_millis("first").alias("at"), F.lit("observed").alias("activity")), over))
    return episodes.select("source", F.explode(both).alias("x")).select("source", "x.*")


class Heartbeats(StatefulProcessor):
    """Emits a row when a source is observed again and when it is overdue."""

    def __init__(self, seconds: int):
        self.patience = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long")
        self.last = handle.getValueState("last", "ms long, overdue boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        new = sorted({int(r["ms"]) for r in rows})
        self.pending.appendList([Row(ms=ms) for ms in new])
        self.handle.registerTimer(new[0])  # the next ones when this one fires
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now, waiting = timerValues.getCurrentWatermarkInMs(), sorted({r[0] for r in self.pending.get()})
        last, overdue = self.last.get() if self.last.exists() else (None, False)
        out = []
        for ms in (x for x in waiting if x < now):
            if last is not None and ms - last > self.patience and not overdue:
                out.append((last + self.patience, "overdue"))
                overdue = True
            if last is None or overdue:
                out.append((ms, "observed"))
            last, overdue = ms, False
        if last is not None and not overdue:
            if last + self.patience < now:
                out.append((last + self.patience, "overdue"))
                overdue = True
            else:
                self.handle.registerTimer(last + self.patience)
        if later := [x for x in waiting if x >= now]:
            self.pending.put([Row(ms=x) for x in later])
            self.handle.registerTimer(later[0])
        else:
            self.pending.clear()
        if last is not None:
            self.last.update((last, overdue))
        return iter([Row(source=key[0], at=datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None), activity=a) for ms, a in out])

    def close(self) -> None:
        pass


def stream_heartbeats(observations: DataFrame, lateness: str = "1 hour", seconds: int = 120) -> DataFrame:
    """The stream form of heartbeats, for the time before the watermark. Run it in with_timers."""
    rows = observations.where("source is not null and at is not null").select("source", "at", F.unix_millis("at").alias("ms")).withWatermark("at", lateness)
    return rows.groupBy("source").transformWithState(Heartbeats(seconds), ACTIVITY, "Append", "EventTime")


@contextmanager
def with_timers(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def stream_reports(spark: SparkSession, path: str, content_id: Column, lateness: str = "1 day", files: int = 100) -> DataFrame:
    """sources.library.read_reports as a stream of files: rows whose id is the one that their content gives, once each within the lateness."""
    rows = spark.readStream.schema(REPORT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).json(path)
    return rows.where(F.col("report_id") == content_id).withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["report_id"])
