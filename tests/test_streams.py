"""State that ends, the log as a stream, the streaming top list and the cache table."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mercadia.operators import state
from mercadia.sources import landed
from mercadia.streaming import log as logs
from mercadia.streaming.stateful import cached, rate_limited


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def feed(frame, folder, batches):
    """Each batch of rows, a list of Python rows, as one file, in order of name and time."""
    import os

    for n, rows in enumerate(batches):
        path = folder / f"{n:03d}"
        frame(rows).coalesce(1).write.json(str(path))
        for part in path.glob("part-*.json"):
            target = folder / f"{n:03d}.json"
            part.rename(target)
            os.utime(target, (1_000_000 + n, 1_000_000 + n))


def watched(spark, out, name, tmp_path):
    done = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress if p["stateOperators"]]


@pytest.mark.parametrize("what", ["limit", "cache"])
def test_state_ends(spark, rocks, tmp_path, what):
    """A hundred keys in the first batch, one key an hour later: the hundred go. Rows that come behind the watermark are dropped."""
    kind = "k string, t double, id long"
    frame = lambda rows: spark.createDataFrame(rows, kind)
    first = [(f"k{n}", float(n), n) for n in range(100)]
    feed(frame, tmp_path / "in", [first, [("x", 3600.0, 200), ("x", 3601.0, 201), ("x", None, 202)], [("k1", 5.0, 300), ("x", 3700.0, 301)], [("x", 99_999.0, 400)], [("y", 200_000.0, 500)], [("z", 300_000.0, 600)]])
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = rate_limited(stream.withColumnRenamed("k", "client"), 60, 1, "1 minute") if what == "limit" else cached(stream.withColumnRenamed("k", "key"), 60, "1 minute")
    kept = watched(spark, out, f"ends_{what}", tmp_path)
    got = {r["id"]: r[-1] for r in spark.table(f"ends_{what}").collect()}
    assert set(got) == {*range(100), 200, 201, 301, 400, 500, 600}  # 202 has no time, 300 is late
    assert [got[k] for k in (200, 201, 301)] == ([True, False, True] if what == "limit" else [False, True, False])
    assert max(kept) >= 100 and kept[-1] <= 4  # the last key alone, with its timer


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    rows = [(k, f"q{k % 5}", None, k, "s") for k in range(30)]
    frame = lambda part: spark.createDataFrame(part, landed.LOG)
    feed(frame, tmp_path / "in", [rows[:10], rows[10:20], rows[20:]])
    (tmp_path / "in" / "bad.json").write_text("no json\n")
    stream = logs.log_stream(spark, str(tmp_path / "in"), 1)
    logs.log_to(stream, str(tmp_path / "log"), "a", str(tmp_path / "c"), availableNow=True).awaitTermination()
    once = sorted(map(tuple, logs.read_logged(spark, str(tmp_path / "log")).collect()))
    assert [r[:5] for r in once] == rows
    again = spark.read.schema(landed.LOG).json(str(tmp_path / "in" / "001.json"))
    batch = {r[0]: r[-1] for r in once}[10]
    logs.write_batch(again, batch, str(tmp_path / "log"), "a")  # what Spark does after a failure between sink and checkpoint
    assert sorted(map(tuple, logs.read_logged(spark, str(tmp_path / "log")).collect())) == once
    feed(frame, tmp_path / "in2", [[(99, "late", None, 1, "s")]])
    logs.log_to(logs.log_stream(spark, str(tmp_path / "in2")), str(tmp_path / "log"), "b", str(tmp_path / "c2"), availableNow=True).awaitTermination()
    assert logs.read_logged(spark, str(tmp_path / "log")).count() == 31


def test_top_list_after_each_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(f" Q{int(draw.expovariate(0.2))} ", k) for k in range(400)] + [("  ", 400), (None, 401)]
    frame = lambda part: spark.createDataFrame(part, "query string, seq long")
    path, check = str(tmp_path / "top"), str(tmp_path / "c")
    (tmp_path / "in").mkdir()
    assert logs.read_popular(spark, path).collect() == []
    for n in range(5):  # a new start from the checkpoint for each batch
        feed(frame, tmp_path / "in" / f"d{n}", [rows[n * 90 : (n + 1) * 90]])
        stream = spark.readStream.schema("query string, seq long").json(str(tmp_path / "in" / "*"))
        logs.popular_to(stream, path, check, 5, availableNow=True).awaitTermination()
        expect = state.popular(frame(rows[: (n + 1) * 90]), 5).collect()
        assert logs.read_popular(spark, path).collect() == expect and len(expect) == 5
    last = logs._lists(spark, path)
    assert len(last) <= 2
    again = spark.read.schema(logs.TOP).parquet(f"{path}/batch={last[-1]}")
    kept = again.collect()
    logs.merge_top(spark.createDataFrame(kept, logs.TOP), last[-1], path, 5)  # the same batch once more
    assert logs.read_popular(spark, path).collect() == expect


def test_cache_table_keeps_one_row_a_key(spark, tmp_path):
    draw = random.Random(7)
    path, latest = str(tmp_path / "cache"), {}
    schema = landed.CACHE
    for n in range(20):
        rows = [(f"k{draw.randint(0, 40)}", float(100 * n + draw.randint(-150, 50)), f"{n}-{k}") for k in range(12)]
        rows = list({r[0]: r for r in rows}.values())
        reader = landed.read_cache(spark, path)
        before = sorted(map(tuple, reader.collect()))
        landed.put_cache(spark.createDataFrame(rows, schema), path, 100.0 * n, 700.0, 8)
        assert sorted(map(tuple, reader.collect())) == before  # what a reader began to read stays
        for key, ts, data in rows:
            if key not in latest or ts >= latest[key][0]:
                latest[key] = (ts, data)
    got = landed.read_cache(spark, path).collect()
    assert len({r["key"] for r in got}) == len(got)
    fresh = {k: v for k, v in latest.items() if 1900 - v[0] <= 700}
    assert {r["key"]: (r["ts"], r["data"]) for r in got if 1900 - r["ts"] <= 700} == fresh
    hits = {r["key"]: r["data"] for r in landed.lookup(landed.read_cache(spark, path), 1900.0, 700.0).collect()}
    assert hits == {k: v[1] for k, v in fresh.items()}
    assert len(landed._generations(spark, path)) <= 12


def test_cache_table_of_odd_rows(spark, tmp_path):
    path = str(tmp_path / "cache")
    make = lambda *rows: spark.createDataFrame(list(rows), landed.CACHE)
    landed.put_cache(make(), path, 0.0, 10.0)
    assert landed.read_cache(spark, path).count() == 0
    landed.put_cache(make(("a", 1.0, "x"), ("a", 1.0, "x"), (None, 2.0, "n")), path, 1.0, 10.0, 2)
    landed.put_cache(make(("a", 1.0, "y"), ("b", -50.0, "old")), path, 2.0, 10.0, 2)  # of equal times the new one; expired ones go
    assert set(map(tuple, landed.read_cache(spark, path).collect())) == {("a", 1.0, "y"), (None, 2.0, "n")}


def test_configuration_is_written_beside(spark, tmp_path):
    path = str(tmp_path / "config")
    first = landed.stores(spark, [{"key": "a", "domain": "a.example"}])
    defaults = landed.stores(spark, [{"key": "b", "domain": "b.example"}]).withColumn("replaces", F.lit(None).cast("string"))
    landed.write_config(first, defaults, path)
    again = landed.write_config(landed.read_config(spark, path), defaults, path)  # read from where it is written
    assert [r["key"] for r in again.orderBy("store_ord").collect()] == ["a", "b"]
    (tmp_path / "config").rename(tmp_path / "config.old")  # a failure between the two renames
    assert [r["key"] for r in landed.read_config(spark, path).orderBy("store_ord").collect()] == ["a", "b"]
