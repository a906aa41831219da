"""Keeping an index current from a stream of changes."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lumenseek.operators.changes import debounce, latest_changes
from lumenseek.plans.engine import NAMED_PATHS, Engine
from lumenseek.sources.files import covered, read_tree
from lumenseek.streaming.change_feed import ChangeFeed


def debounced_stream(events: DataFrame, key: str = "path", time: str = "ts", gap: str = "500 milliseconds", kind: str = "type", delay: str = "1 second") -> DataFrame:
    """Trailing-edge debounce in event time: one event per key and burst, once no earlier event can arrive."""
    return debounce(events.withWatermark(time, delay), key, time, gap, kind)


class _Progress(StreamingQueryListener):
    """Tells a function of each batch of one query: number, input rows, milliseconds."""

    def __init__(self, name: str, tell: Callable[[dict], None]):
        self.name, self.tell = name, tell

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name == self.name:
            self.tell({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


class Watch:
    """A running watch: polls of a folder, and the query that applies their changes to an index."""

    def __init__(self, spark: SparkSession, feed: ChangeFeed, query, every: float, listener: _Progress | None):
        self.spark, self.feed, self.query, self.listener = spark, feed, query, listener
        self._polls, self._stop = threading.Lock(), threading.Event()
        self._thread = threading.Thread(target=self._run, args=(every,), daemon=True)
        self._thread.start()

    def _run(self, every: float) -> None:
        while not self._stop.wait(every):
            self.poll()

    def poll(self) -> int:
        with self._polls:
            return self.feed.poll()

    def processAllAvailable(self) -> None:
        """Returns when all that has changed until now is in the index."""
        self.poll()
        self.query.processAllAvailable()

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()
        self.query.stop()
        if self.listener:
            self.spark.streams.removeListener(self.listener)


def watch(spark: SparkSession, root: str, engine: Engine, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, every: float = 1.0, on_progress: Callable[[dict], None] | None = None, max_files: int = 64) -> Watch:
    """Starts to poll a folder every so many seconds and to apply what changes to the index; stop() ends it. Each path
    counts once per batch, by its last event; batches are applied one after another and a repeated batch changes nothing
    more. A later watch with the same checkpoint goes on where this one ends."""

    def apply(batch: DataFrame, epoch: int) -> None:
        last = latest_changes(batch.where(covered(F.col("path"))), "path", ["version", "ts"]).persist()
        some = [r.path for r in last.where("type <> 'unlink'").select("path").limit(NAMED_PATHS + 1).collect()]
        if some or last.head():
            files = read_tree(batch.sparkSession, root, only=some) if len(some) <= NAMED_PATHS else read_tree(batch.sparkSession, root).join(last.select("path"), "path", "left_semi")
            engine.update(files, last.where("type = 'unlink'").select("path"))
            if on_change:
                on_change(last)
        last.unpersist()

    feed = ChangeFeed(spark, root, f"{checkpoint}/feed")
    name = f"watch-{abs(hash((root, checkpoint)))}"
    listener = _Progress(name, on_progress) if on_progress else None
    if listener:
        spark.streams.addListener(listener)
    query = feed.stream(max_files).writeStream.queryName(name).foreachBatch(apply).option("checkpointLocation", f"{checkpoint}/stream").trigger(processingTime="500 milliseconds").start()
    return Watch(spark, feed, query, every, listener)


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "5 minutes", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events per window and kind; late ones count until the watermark has passed."""
    return events.withWatermark(time, delay).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"))
