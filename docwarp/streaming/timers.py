"""Event-time timers per key: something starts, and unless something ends it within its grace it expires.

With documents that go missing and are seen again this is the expiry of the missing grace; with job attempts that start and finish, the
watchdog of stale jobs, where a finish of another attempt has another key and stops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, started_us long"
STATE = "since_us long, over boolean"
#: Timers and value states need this state store.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Expiry(StatefulProcessor):
    """One open timer a key: since when it runs, or that it is over and rests until the key is ended."""

    def __init__(self, grace: int) -> None:
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("timer", STATE)

    def _due(self, since: int) -> int:
        return -(-(since + self.grace) // 1000)  # timers count milliseconds

    def _keep(self, had: tuple | None, since: int | None, over: bool, timerValues) -> None:
        """Each call of the handle asks the state store, so only what changes is told."""
        old = had[0] if had else None
        if old != since:
            if old is not None:
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
            if since is not None:
                self.handle.registerTimer(max(self._due(since), timerValues.getCurrentWatermarkInMs() + 1))
        if since is None and not over:
            if had:
                self.state.clear()
        elif had != (since, over):
            self.state.update((since, over))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        had = self.state.get()  # null without a state
        had = tuple(had) if had is not None else None
        since, over = had or (None, False)
        out = []
        events = sorted((at, not starts) for part in rows for at, starts in zip(part["at"].tolist(), part["starts"].tolist(), strict=True))
        for at, ends in events:
            starts = not ends
            if since is not None and at > since + self.grace:
                out.append(since)
                since, over = None, True
            if not starts:
                since, over = None, False
            elif since is None and not over:
                since = at
        self._keep(had, since, over, timerValues)
        if out:
            yield pd.DataFrame({"key": [key[0]] * len(out), "started_us": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        since, _ = self.state.get() if self.state.exists() else (None, False)
        if since is not None and self._due(since) <= timerValues.getCurrentWatermarkInMs():
            self.state.update((None, True))
            yield pd.DataFrame({"key": [key[0]], "started_us": [since]})

    def close(self) -> None:
        pass


def expirations(events: DataFrame, grace_seconds: int, lateness: str) -> DataFrame:
    """Stream of key, started_at, expired_at for a stream of events (key, ts, starts: true begins, false ends).

    A start while one is open changes nothing. What ends after the grace comes too late. After an expiry a key rests until it is ended.
    ``lateness`` bounds how late an event may come; a key's open timer is all its state.
    """
    grace = grace_seconds * 1_000_000
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "starts").withWatermark("ts", lateness)
    found = rows.withColumn("at", F.unix_micros("ts")).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Expiry(grace), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return found.select("key", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros(F.col("started_us") + grace).alias("expired_at"))


def run(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream to its end and return what it wrote; a batch that is run again replaces its own rows."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    conf = stream.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(PROVIDER, before)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/batch=*")
