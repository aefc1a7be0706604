"""State by key with timers in event time: switches that close when nobody touches them, and keys that are forgotten."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Run = tuple[int, int, int]  # first and last touch in microseconds, and touches


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which timers need and which is not bound by memory."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def added(runs: list[Run], first: int, last: int, n: int, idle: int) -> None:
    """Adds a run to ascending ones; those that are less than `idle` apart become one."""
    at = bisect_left(runs, first - idle + 1, key=lambda r: r[1])
    end = at
    while end < len(runs) and runs[end][0] - last < idle:
        first, last, n = min(first, runs[end][0]), max(last, runs[end][1]), n + runs[end][2]
        end += 1
    runs[at:end] = [(first, last, n)]


class _Switch(StatefulProcessor):
    """Per key the runs of touches that aren't over, few as they are however many touches they have; one timer, at the end of the first run."""

    def __init__(self, key: str, idle: int):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", "runs array<struct<first:long,last:long,n:long>>")

    def _get(self) -> list[Run]:
        return [tuple(r) for r in self.runs.get()[0]] if self.runs.exists() else []

    def _over(self, run: Run) -> int:
        return -(-(run[1] + self.idle) // 1000)  # milliseconds, rounded up

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        runs = self._get()
        before = self._over(runs[0]) if runs else None
        for row in rows:
            added(runs, row["micros"], row["micros"], 1, self.idle)
        self.runs.update((runs,))
        if self._over(runs[0]) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(self._over(runs[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        runs = self._get()
        n = sum(self._over(r) <= now for r in runs)
        if n < len(runs):
            self.runs.update((runs[n:],))
            self.handle.registerTimer(self._over(runs[n]))
        else:
            self.runs.clear()
        for first, last, touches in runs[:n]:
            yield Row(**{self.key: key[0], "first": first, "last": last, "switches": touches})

    def close(self) -> None:
        pass


def _micros(interval: dt.timedelta) -> int:
    return interval // dt.timedelta(microseconds=1)


def idle_switches(events: DataFrame, key: str, idle: dt.timedelta, late: str) -> DataFrame:
    """Each time a key's switch was used (stream with ts and key): key, opened, closed, switches and left_open.

    Every event turns the switch; when none has come for `idle`, it closes by itself, and the next
    one opens it anew.  left_open says whether it had to, that is after an odd number of turns.  Events may come in
    any order up to `late`: their times count, not their order.  A row comes when the watermark has
    passed `closed`; what is still open is kept, also for later runs from the same checkpoint.  Events without time
    or key are left out.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("micros"))
    out = rows.groupBy(key).transformWithState(_Switch(key, _micros(idle)), f"`{key}` {kind}, first long, last long, switches long", "append", "eventTime")
    return out.select(key, F.timestamp_micros("first").alias("opened"), F.timestamp_micros(F.col("last") + _micros(idle)).alias("closed"), "switches", (F.col("switches") % 2 == 1).alias("left_open"))


class _Seen(StatefulProcessor):
    """Per key the time it was seen first, until a timer forgets it."""

    def __init__(self, key: str, keep: int):
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "first long")

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        first = min(row["micros"] for row in rows)
        if not self.first.exists():
            self.first.update((first,))
            self.handle.registerTimer(-(-(first + self.keep) // 1000))
            yield Row(**{self.key: key[0], "first": first})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def seen_for(events: DataFrame, key: str, keep: dt.timedelta, late: str) -> DataFrame:
    """Keys (stream with ts and key) with the time they were seen first; a key is new again when the watermark has passed that time by `keep`.

    Unlike `once_only`, whose keys stay as long as the watermark is behind, both spans are apart: events may be late by hours and keys be kept for weeks.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).select(key, "ts", F.unix_micros("ts").alias("micros"))
    out = rows.groupBy(key).transformWithState(_Seen(key, _micros(keep)), f"`{key}` {kind}, first long", "append", "eventTime")
    return out.select(key, F.timestamp_micros("first").alias("first"))


def run_into(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Takes what has come since the last run with this folder and name, and returns all rows so far; state goes on from run to run."""
    out = f"{folder}/{name}"
    with rocks_state(stream.sparkSession):
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/{name}-state").format("parquet").start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
