"""Streaming forms: rate limits with state per user, incremental ingest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.operators.online import LIMIT_ANONYMOUS, WINDOW_SECONDS, accepted

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Limiter(StatefulProcessor):
    """Requests of one user, judged in order of time once the watermark has passed them.

    ``waiting`` holds requests that earlier ones may still come before, ``kept`` the times accepted within the window. One timer stands
    at the next request that waits, or, when none does, where the last accepted time leaves the window: then the user's state goes.
    """

    def __init__(self, columns: list[str], limit: int, window: float):
        self.columns, self.limit, self.window = columns, limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seconds double, tie long")
        self.kept = handle.getListState("kept", "seconds double")

    def _wake(self, seconds: float) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(math.ceil(seconds * 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        user, seconds, tie = self.columns
        new = [(float(s), int(t)) for batch in rows for s, t in zip(batch[seconds], batch[tie])]
        self.waiting.appendList(new)
        self._wake(min(s for s, _ in self.waiting.get()))
        yield pd.DataFrame({user: pd.Series(dtype="int64"), tie: pd.Series(dtype="int64"), seconds: pd.Series(dtype="float64"), "accepted": pd.Series(dtype="bool")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        user, seconds, tie = self.columns
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        rows = sorted((s, t) for s, t in self.waiting.get())
        due, later = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        flags, kept = accepted([s for s, _ in due], self.limit, self.window, [s for (s,) in self.kept.get()])
        self.kept.clear()
        kept = [s for s in kept if s > passed - self.window]
        if kept:
            self.kept.put([(s,) for s in kept])
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        elif kept:
            self._wake(max(kept) + self.window)
        yield pd.DataFrame({user: [key[0]] * len(due), tie: [t for _, t in due], seconds: [s for s, _ in due], "accepted": flags}).astype({"accepted": "bool", tie: "int64", seconds: "float64", user: "int64"})

    def close(self) -> None:
        pass


def limit_stream(requests: DataFrame, user: str = "user_id", seconds: str = "s", tie: str = "event_id", limit: int = LIMIT_ANONYMOUS, window: float = WINDOW_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """(user, tie, seconds, accepted) of a stream of requests (user long, seconds double, tie long): what rate_limit() of operators.online says.

    Requests may come out of order by ``delay``; later ones are left out by the watermark. A request is judged when the watermark reaches it, so those within
    the last ``delay`` wait for others to come. The session's state store must be ROCKSDB (spark.sql.streaming.stateStore.providerClass).
    """
    timed = requests.withColumn("__time", F.timestamp_millis(F.ceil(F.col(seconds) * 1000))).withWatermark("__time", delay)
    schema = f"{user} long, {tie} long, {seconds} double, accepted boolean"
    return timed.groupBy(user).transformWithStateInPandas(Limiter([user, seconds, tie], limit, window), outputStructType=schema, outputMode="append", timeMode="EventTime")


def ingest_new(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], fmt: str = "parquet") -> None:
    """Pass files that have come since the last run, in batches, to ``handle``; what is done is remembered in ``checkpoint``."""
    query = spark.readStream.format(fmt).schema(schema).load(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
