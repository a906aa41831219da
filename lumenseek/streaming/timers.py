"""Trailing-edge debounce by timers: an event goes out when its key has been quiet for a while.

State of a key is its burst so far; a timer stands at the last event plus the gap and moves with every event. With the
clock `processing` it is the time of day of the cluster; with `event`, the watermark, so results depend on the events
alone. State and timers are in the checkpoint: what is pending when a query stops goes out after it starts again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Debounce(StatefulProcessor):
    """Bursts as (first_ms, last_ms, kind, n), with one timer per key. Times are milliseconds."""

    def __init__(self, names: list[str], gap_ms: int, event_clock: bool, kind: str):
        self.row, self.gap_ms, self.event_clock, self.kind = Row(*names), gap_ms, event_clock, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a key that is quiet has no state: what a timer sends out it also clears
        self.burst = handle.getValueState("burst", f"first_ms long, last_ms long, kind {self.kind}, n long")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.burst.get()
        burst = tuple(known) if known else None
        events = sorted(((r.event_ms, r.event_order is None, r.event_order, r.event_kind) for r in rows), key=lambda e: e[:2] if e[1] else e[:3])
        for ms, _, _, kind in events:
            if burst and self.event_clock and ms - burst[1] >= self.gap_ms:
                yield self.row(*key, *burst)
                burst = None
            burst = (min(burst[0], ms), max(burst[1], ms), kind if ms >= burst[1] else burst[2], burst[3] + 1) if burst else (ms, ms, kind, 1)
        self.burst.update(burst)
        self._timer(burst[1] + self.gap_ms if self.event_clock else timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        burst = self.burst.get()
        if burst:
            self.burst.clear()
            yield self.row(*key, *burst)

    def close(self) -> None: ...


def debounced_by_timers(events: DataFrame, key: str = "path", time: str = "ts", kind: str = "type", *, gap_ms: int = 500, clock: str = "processing", delay: str = "1 second", order: str | None = None) -> DataFrame:
    """key, first_at, last_at, kind, n: one row per burst of a key, that is events each less than gap_ms after the one
    before. Its kind is that of the last event; equal times go by `order`, by default the kind. With the clock `event`,
    events later than the watermark are left out; with `processing`, a burst is what comes without a pause of gap_ms
    between arrivals. Null keys are a key; events without a time are left out."""
    if clock not in ("processing", "event"):
        raise ValueError("clock is processing or event")
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ms = F.unix_millis(F.col(time).cast("timestamp"))
    rows = events.where(F.col(time).isNotNull())
    rows = rows.withWatermark(time, delay) if clock == "event" else rows
    rows = rows.select(F.col(key), F.col(time), ms.alias("event_ms"), F.col(kind).alias("event_kind"), F.col(order or kind).alias("event_order"))
    fields = StructType([StructField(key, rows.schema[key].dataType), *StructType.fromDDL("first_ms long, last_ms long"), StructField("kind", rows.schema["event_kind"].dataType), *StructType.fromDDL("n long")])
    made = rows.groupBy(key).transformWithState(_Debounce(fields.names, gap_ms, clock == "event", rows.schema["event_kind"].dataType.simpleString()), fields, "Append", "EventTime" if clock == "event" else "ProcessingTime")
    at = lambda c: F.timestamp_millis(c)
    return made.select(key, at("first_ms").alias("first_at"), at("last_ms").alias("last_at"), F.col("kind").alias(kind), "n")
