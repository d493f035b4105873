"""Streaming forms: the rate limiter and the cache as keyed state that ends, and counts of a search log with watermarks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from mercadia.operators.state import log_query

#: Event times are this much later than t: the first watermark is at 0, and what is not behind it counts.
SHIFT_S = 1
DECISION = "client string, id long, t double, accepted boolean"


class Expiring(StatefulProcessor):
    """Keyed state that ends: `ends` says until when a key's state matters, and a timer in event time clears it once the watermark has passed that."""

    def __init__(self, span: float) -> None:
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("times", StructType([StructField("times", ArrayType(DoubleType()))]))

    def load(self) -> list[float]:
        return list(self.state.get()[0]) if self.state.exists() else []

    def keep(self, times: list[float]) -> None:
        """Stores the times and sets the one timer that clears them."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.state.update((times,))
            self.handle.registerTimer(int(math.ceil((max(times) + self.span + SHIFT_S) * 1000)) + 1)
        else:
            self.state.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class SlidingLimit(Expiring):
    """Keeps the times of a client's accepted hits within the window, never more than the limit."""

    def __init__(self, seconds: float, limit: int) -> None:
        super().__init__(seconds)
        self.limit = limit

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = self.load()
        hits = pd.concat(list(rows)).sort_values(["t", "id"])
        verdicts = []
        for t in hits["t"]:
            times = [x for x in times if x >= t - self.span]
            fits = self.limit <= 0 or len(times) < self.limit
            if fits and self.limit > 0:
                times.append(float(t))
            verdicts.append(fits)
        self.keep(times)
        yield pd.DataFrame({"client": [str(key[0])] * len(hits), "id": hits["id"], "t": hits["t"], "accepted": verdicts})


class CacheEntry(Expiring):
    """Keeps when a key's entry was written."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        written = self.load()
        requests = pd.concat(list(rows)).sort_values(["t", "id"])
        hits = []
        for t in requests["t"]:
            hits.append(bool(written) and t - written[0] <= self.span)
            written = written if hits[-1] else [float(t)]
        self.keep(written)
        yield pd.DataFrame({"key": [str(key[0])] * len(requests), "id": requests["id"], "t": requests["t"], "hit": hits})


def _timed(rows: DataFrame, key: str, late: str) -> DataFrame:
    """rows(key, t, id) with the event time of t and a watermark."""
    slim = rows.select(F.col(key).cast("string").alias(key), F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id"))
    return slim.withColumn("ts", F.timestamp_micros(((F.col("t") + SHIFT_S) * 1_000_000).cast("long"))).withWatermark("ts", late)


def rate_limited(hits: DataFrame, seconds: float, limit: int, late: str = "10 minutes") -> DataFrame:
    """A stream of hits(client, t, id), in order of t for each client, with accepted. Needs the RocksDB state store.

    A client's state goes when the watermark, `late` behind the latest hit of all, has passed the end of its window. Hits that come behind the watermark, or without t, are dropped."""
    rows = _timed(hits, "client", late).where("t IS NOT NULL")
    return rows.groupBy("client").transformWithStateInPandas(SlidingLimit(seconds, limit), outputStructType=DECISION, outputMode="Append", timeMode="EventTime")


def cached(requests: DataFrame, ttl_s: float, late: str = "10 minutes") -> DataFrame:
    """A stream of requests(key, t, id), in order of t for each key, with hit: a miss writes, a hit doesn't renew. Needs the RocksDB state store.

    A key's state goes when the watermark has passed its entry's end. Requests that come behind the watermark, or without t, are dropped."""
    rows = _timed(requests, "key", late).where("t IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(CacheEntry(ttl_s), outputStructType="key string, id long, t double, hit boolean", outputMode="Append", timeMode="EventTime")


def popular_stream(log: DataFrame) -> DataFrame:
    """Running counts of a log stream(query), for complete or update mode."""
    return log.select(log_query().alias("query")).where("query <> ''").groupBy("query").count()


def popular_windows(log: DataFrame, duration: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a log stream(query, ts) by tumbling window; rows later than the watermark are dropped."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", duration), log_query().alias("query")).count()


def session_stream(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "client").count()
