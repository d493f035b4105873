"""Lookups as of a time and the read-through cache against plain loops."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from mercadia.config import EngineConfig
from mercadia.operators import asof


@pytest.mark.parametrize("slice_", [1, 7, 1000])
def test_as_of(spark, slice_):
    draw = random.Random(slice_)
    entries = [(draw.choice("ab"), draw.choice([draw.randint(0, 60), 30]), k, f"v{k}") for k in range(60)] + [(None, 5, 98, "null key"), ("a", None, 99, "no time")]
    asked = [(draw.choice("abc"), draw.randint(-5, 70), k, "x") for k in range(80)] + [(None, 9, 80, "x"), ("a", None, 81, "x")]
    left = spark.createDataFrame(asked, "key string, t long, id long, _slice string").repartition(3)
    right = spark.createDataFrame(entries, "key string, t long, id long, v string")
    for before in (False, True):
        got = {r["id"]: (r["v"], r["v_t"]) for r in asof.as_of(left, right, ["key"], "v", slice_, before).collect()}
        for key, t, k, _ in asked:
            seen = [(e[1], e[2], e[3]) for e in entries if key is not None and t is not None and e[0] == key and e[1] is not None and (e[1] < t or e[1] == t and (not before or e[2] < k))]
            best = max(seen, default=None)
            assert got[k] == ((best[2], best[0]) if best else (None, None))
        assert len(got) == len(asked)


def walk(requests, ttl):
    entry, out = {}, {}
    for key, t, k, ok in sorted(requests, key=lambda r: (r[1], r[2])):
        held = entry.get(key)
        hit = held is not None and t - held[0] <= ttl
        if not hit and ok:
            held = entry[key] = (t, k)
        out[k] = (hit, held[1] if hit or ok else None)
    return out


@pytest.mark.parametrize("ttl", [0, 1, 10, 100, 10_000])
def test_read_through(spark, ttl):
    draw = random.Random(ttl)
    requests = [(draw.choice("aaaab"), draw.randint(0, 2000), k, draw.random() < 0.7) for k in range(500)] + [("c", 5, 900, False), ("d", 5, 901, True)]
    frame = spark.createDataFrame(requests, "key string, t long, id long, ok boolean").repartition(4)
    got = {r["id"]: (r["hit"], r["entry"]) for r in asof.read_through(frame, ttl).collect()}
    assert got == walk(requests, ttl)
    assert asof.read_through(frame.limit(0), ttl).count() == 0


def test_one_busy_key_runs_in_several_tasks(spark):
    frame = spark.range(4000).select(F.lit("all").alias("key"), (F.col("id") * 10).alias("t"), "id", F.lit(True).alias("ok"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = asof.read_through(frame, 500).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 4000


def test_no_frame_ends_with_its_partition(spark):
    """Spark works out a frame up to the partition's end anew for every row, so a busy slice would cost its square."""
    frame = spark.range(10).select(F.lit("all").alias("key"), (F.col("id") * 10).alias("t"), "id", F.lit(True).alias("ok"))
    for found in (asof._next(frame, 500), asof.read_through(frame, 500)):
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_a_chain_goes_through_writers_only(spark):
    frame = spark.range(2000).select((F.col("id") % 2).cast("string").alias("key"), F.floor(F.col("id") / 100).alias("t"), "id", (F.col("id") % 3 > 0).alias("ok"))
    got = {r["id"]: (r["hit"], r["entry"]) for r in asof.read_through(frame, 2).collect()}
    assert got == walk([tuple(r) for r in frame.collect()], 2)


def test_resolve_plans(spark):
    plan = lambda name: json.dumps({"canonical_query": name, "search_queries": ["uno"], "source": "data"})
    s = asof.SECOND
    plans = [("TV  55", 0, 1, plan("first")), (" tv 55", 50 * s, 2, plan("second")), ("tv 55", 500 * s, 3, "[]"), ("tv 55", 700 * s, 4, None), ("radio", 0, 5, plan("radio"))]
    asked = [("tv 55", -1), ("tv 55", 0), ("Tv 55 ", 50 * s), ("tv 55", 150 * s), ("tv 55", 150 * s + 1), ("tv 55", 501 * s), ("tv 55", 701 * s), ("", 1), (None, 1), ("radio", 99 * s)]
    got = asof.resolve_plans(spark.createDataFrame([(q, t, k) for k, (q, t) in enumerate(asked)], "query string, t long, n int"), spark.createDataFrame(plans, "query string, t long, id long, body string"), EngineConfig(plan_ttl_s=100))
    found = {r["n"]: (r["plan"]["source"], r["plan"]["canonical_query"], r["plan"]["search_queries"]) for r in got.collect()}
    local = ("local", "tv 55", ["tv 55"])
    assert found == {0: local, 1: ("data", "first", ["tv 55", "uno"]), 2: ("data", "second", ["Tv 55", "uno"]), 3: ("data", "second", ["tv 55", "uno"]), 4: local, 5: local, 6: local, 7: ("local", "", []), 8: ("local", "", []), 9: ("data", "radio", ["radio", "uno"])}
