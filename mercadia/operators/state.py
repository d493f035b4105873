"""Time-based state over logs and requests: rate limits, cache simulation, popular searches, windows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.textnorm import collapsed


def attempts_in_window(hits: DataFrame, seconds: int) -> DataFrame:
    """hits(client, t, ...) with attempts: how many of the client's hits lie in the trailing window."""
    return hits.withColumn("attempts", F.count("*").over(Window.partitionBy("client").orderBy("t").rangeBetween(-int(seconds), 0)))


def _folded(rows: DataFrame, key: str, flag: str, span: float, start: Callable[[], Any], step: Callable[[Any, float], bool]) -> DataFrame:
    """rows(key, t, id) with flag: step(state, t) for each key's rows in order of t and id, with a state made anew by start() after each pause longer than span.

    Pauses are found by time slices as long as span, so a busy key, cut at its pauses, spreads over many tasks. Rows stream through
    a task sorted, so none of them holds more than one state. Rows without t come out true and change nothing.
    """
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(F.col(key).alias("k"), F.col("t").cast("double").alias("t"), F.col("id").cast("long").alias("id")).withColumn("slice", F.floor(F.col("t") / float(span)))
    slices = slim.where("t IS NOT NULL").groupBy("k", "slice").agg(F.min("t").alias("low"), F.max("t").alias("high"))
    order = Window.partitionBy("k").orderBy("slice")
    begins = F.coalesce(F.col("low") - F.lag("high").over(order) > span, F.lit(True))
    parts = slices.select(F.col("k").alias("_k"), F.col("slice").alias("_slice"), F.sum(begins.cast("long")).over(order).alias("part"))
    cut = slim.join(parts, slim["k"].eqNullSafe(parts["_k"]) & (slim["slice"] == parts["_slice"]), "left").select("k", "part", "t", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, start()
        for batch in batches:
            flags = []
            for k, part, t in zip(*(batch.column(c).to_pylist() for c in ("k", "part", "t")), strict=True):
                if (k, part) != current:
                    current, state = (k, part), start()
                flags.append(True if t is None else step(state, t))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(flags, pa.bool_())], names=[key, "id", flag])

    return cut.repartition("k", "part").sortWithinPartitions("k", "part", "t", "id").mapInArrow(walk, f"`{key}` {kind}, id long, {flag} boolean")


def rate_limit(hits: DataFrame, seconds: float, limit: int) -> DataFrame:
    """hits(client, t, id) with accepted. A hit is accepted while fewer than `limit` accepted hits lie in the trailing window, ends included; rejected hits don't count.

    The decision depends on earlier decisions, so each client's hits are folded in order. The state of the fold is
    the times of the accepted hits in the window, never more than `limit`.
    """
    if limit <= 0:
        return hits.withColumn("accepted", F.lit(True))

    def step(live: deque, t: float) -> bool:
        while live and live[0] < t - seconds:
            live.popleft()
        fits = len(live) < limit
        if fits:
            live.append(t)
        return fits

    return _folded(hits, "client", "accepted", seconds, deque, step)


def cache_hits(requests: DataFrame, ttl_s: float) -> DataFrame:
    """requests(key, t, id) with hit: a miss writes, a hit doesn't renew, and an entry serves until it is older than the ttl."""

    def step(written: list[float], t: float) -> bool:
        hit = bool(written) and t - written[0] <= ttl_s
        if not hit:
            written[:] = [t]
        return hit

    return _folded(requests, "key", "hit", ttl_s, list, step)


def log_query():
    """A logged query as it is counted: lower case, white space collapsed, accents kept."""
    return collapsed(F.lower("query"))


def popular(log: DataFrame, k: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The k most logged queries of log(query, seq), the earlier first on ties; k is held between 1 and the config's most."""
    k = max(1, min(config.popular if k is None else k, config.popular_most))
    counted = log.select(log_query().alias("query"), "seq").where("query <> ''").groupBy("query").agg(F.count("*").alias("count"), F.min("seq").alias("first"))
    return counted.orderBy(F.desc("count"), "first").limit(k).select("query", "count")


def popular_by_window(log: DataFrame, duration: str = "1 hour") -> DataFrame:
    """Counts of log(query, ts) by query and tumbling window."""
    counted = log.select(log_query().alias("query"), "ts").where("query <> ''").groupBy(F.window("ts", duration), "query").count()
    return counted.select(F.col("window.start").alias("start"), "query", "count")


def sessions(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of log(client, ts): a client's searches without a pause of `gap` or more."""
    found = log.groupBy(F.session_window("ts", gap), "client").count()
    return found.select("client", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("count").alias("searches"))
