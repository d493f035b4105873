"""Stores, query lists, search logs and cached payloads: what is read besides payloads, and what is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.functions.scalars import cache_file
from mercadia.shared import on, spool

STORE = "key string, name string, domain string, kind string, enabled boolean, search_path string"
LOG = "ts long, query string, store string, stores_with_price long, cheapest string"


def stores(spark: SparkSession, config: list[dict]) -> DataFrame:
    """The store dimension from a list of settings; name defaults to the key, kind to vtex, enabled to true. Keeps their order in store_ord."""
    rows = [(c["key"], c.get("name", c["key"]), c["domain"], c.get("kind", "vtex"), c.get("enabled", True), c.get("search_path"), k) for k, c in enumerate(config)]
    return spark.createDataFrame(rows, f"{STORE}, store_ord int")


def select_stores(dimension: DataFrame, only: str | None = None) -> DataFrame:
    """The enabled stores; with `only` that one store, enabled or not."""
    return dimension.where(F.col("enabled")) if only is None else dimension.where(F.col("key") == only)


def merge_config(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """User stores first, as they are, then defaults whose key is missing. A disabled store of an outdated kind takes the default's row, where the default names the kind it replaces (column replaces)."""
    d = defaults.select(F.col("key").alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("name", "domain", "kind", "enabled", "search_path", "replaces")])
    joined = user.join(d, (F.col("key") == F.col("_key")), "left")
    old = (F.col("domain") == F.col("_domain")) & (F.coalesce("kind", F.lit("vtex")) == F.col("_replaces")) & ~F.col("enabled")
    old = F.coalesce(old, F.lit(False))
    kept = joined.select("key", *[F.when(old, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("name", "domain", "kind", "enabled", "search_path")], F.lit(0).alias("part"), "store_ord")
    added = defaults.join(user, "key", "left_anti").select("key", "name", "domain", "kind", "enabled", "search_path", F.lit(1).alias("part"), "store_ord")
    return kept.unionByName(added)


def merge_settings(user: DataFrame, defaults: DataFrame) -> DataFrame:
    """name, value: the default settings(name, value) under the user's; a user's null counts, and names that only the user has stay."""
    known = user.select("name", F.struct("value").alias("own"))
    return defaults.select("name", F.struct("value").alias("given")).join(known, "name", "full").select("name", F.coalesce("own", "given")["value"].alias("value"))


def batch_items(lines: DataFrame) -> DataFrame:
    """Lines(value, ...) of a query list that are neither blank nor comments, trimmed."""
    text = F.trim(F.col("value"))
    return lines.withColumn("value", text).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    return batch_items(spark.read.text(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The search log; lines that are no JSON are dropped."""
    return spark.read.schema(f"{LOG}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def latest(cache: DataFrame) -> DataFrame:
    """The last written entry of each key of cache(key, ts, data)."""
    return cache.groupBy("key").agg(F.max_by("data", "ts").alias("data"), F.max("ts").alias("ts"))


def lookup(cache: DataFrame, now, ttl_s: float) -> DataFrame:
    """Entries that are hits at `now`: at most ttl_s old, and not JSON null; an empty list is a hit."""
    fresh = latest(cache).where((F.lit(now) - F.col("ts") <= ttl_s) & (F.trim("data") != "null"))
    return fresh.withColumn("file", cache_file(F.col("key")))


def append_cache(rows: DataFrame, path: str) -> None:
    """Adds entries(key, ts, data); readers take the latest of each key."""
    rows.write.mode("append").parquet(path)


CACHE = "key string, ts double, data string"


def _generations(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The complete generations of a cache table and their buckets."""
    at, files = on(spark, path)
    found: dict[int, list[int]] = {}
    for folder in files.listStatus(at) if files.exists(at) else []:
        if folder.getPath().getName().startswith("gen=") and files.exists(on(spark, f"{folder.getPath().toString()}/_SUCCESS")[0]):
            names = [x.getPath().getName() for x in files.listStatus(folder.getPath())]
            found[int(folder.getPath().getName().removeprefix("gen="))] = [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]
    return found


def _current(found: dict[int, list[int]]) -> dict[int, int]:
    """The newest generation of each bucket."""
    return {bucket: gen for gen in sorted(found) for bucket in found[gen]}


def read_cache(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """key, ts, data of a cache table (of some buckets), one row for each key."""
    now = _current(_generations(spark, path))
    folders = [f"{path}/gen={gen}/bucket={bucket}" for bucket, gen in now.items() if buckets is None or bucket in buckets]
    return spark.read.schema(CACHE).parquet(*folders) if folders else spark.createDataFrame([], CACHE)


def put_cache(rows: DataFrame, path: str, now: float, ttl_s: float, buckets: int = 64) -> None:
    """Writes entries(key, ts, data) over those of the same keys; of one key the latest stays, of equal times the new one. Entries older than ttl_s at `now` are dropped from the buckets that are touched.

    The touched buckets, by the key's hash, are written anew as a generation that counts once it is complete; what a reader has begun to read stays for one more round. One writer at a time.
    """
    spark = rows.sparkSession
    cut = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    new = spool(rows.select("key", F.col("ts").cast("double").alias("ts"), "data", cut.alias("bucket")), "entries")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # buckets at most
    if not touched:
        return
    found = _generations(spark, path)
    old = read_cache(spark, path, touched).withColumns({"bucket": cut, "_new": F.lit(0)})
    both = old.unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy("bucket", "key").agg(F.max_by(F.struct("ts", "data"), F.struct("ts", "_new")).alias("e"))
    kept = best.select("bucket", "key", "e.*").where(F.lit(now) - F.col("ts") <= ttl_s)
    kept.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/gen={max(found, default=0) + 1}")
    live = _current(found)  # as readers saw it until now
    for gen, held in found.items():
        for bucket in held:
            if live[bucket] != gen:
                at, files = on(spark, f"{path}/gen={gen}/bucket={bucket}")
                files.delete(at, True)
        if held and all(live[bucket] != gen for bucket in held):
            at, files = on(spark, f"{path}/gen={gen}")
            files.delete(at, True)


def write_config(user: DataFrame, defaults: DataFrame, path: str) -> DataFrame:
    """Merges the user's stores with the defaults, writes the result as the user's next configuration, and gives it back as read. It is written beside the old folder and renamed, so a failure leaves one of the two."""
    rows = merge_config(user, defaults).orderBy("part", "store_ord").collect()  # a store dimension, as it comes from a config
    spark = user.sparkSession
    merged = spark.createDataFrame([(*r[:6], k) for k, r in enumerate(rows)], f"{STORE}, store_ord int")
    (at, files), (new, _), (old, _) = (on(spark, x) for x in (path, f"{path}.new", f"{path}.old"))
    merged.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}.new")
    files.delete(old, True)
    if files.exists(at):
        files.rename(at, old)
    files.rename(new, at)
    files.delete(old, True)
    return read_config(spark, path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    (at, files), (old, _) = on(spark, path), on(spark, f"{path}.old")
    found = path if files.exists(at) or not files.exists(old) else f"{path}.old"  # between two renames
    return spark.read.schema(f"{STORE}, store_ord int").json(found)
