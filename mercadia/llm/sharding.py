"""Sharding by a two-pass external shuffle (operator 9).

Pass one scatters the records into buckets that fit in memory, by a seeded hash of doc_id. Pass two orders each bucket
by a second seeded hash and permutes it by Fisher-Yates (the `shuffle` function on the bucket's positions, whose
outcome is written before use). A record's place in the whole order is the number of records in earlier buckets plus
its permuted position; shard s of S takes places from ceil(s * N / S) on, so the law is `rows`: counts differ by one at
most. Everything runs in DataFrame functions.

A task takes buckets that follow each other, so its places lie in one or two shards where tasks are no fewer than shards,
and all tasks together write at most one file for each task and each shard.

The order depends on doc_id, the seed and the rows' number only, not on the files they came in.

Skew: the scatter takes no notice of text or source, so groups of equal texts spread evenly. Rows that repeat one
doc_id fall in one bucket, whose sort spills; equal rows there may swap places, which changes no result.

Defined results: a null text has size 16 and crc32 0. Rows with null doc_id are spread by their text's checksum. An
empty table gives no rows. Columns beside doc_id and text are carried by `sharded` and `write_shards`; the added
columns bear the names shard and slot, and columns of these names in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import fresh_path, spool, table

SHARDS = 40
SEED = 20_240_917
#: A bucket fits in memory many times over; a task takes several that follow each other.
BUCKET_BYTES, TASK_BYTES = 4 << 20, 32 << 20
#: Buckets at least, so that small inputs use all executors.
LEAST_BUCKETS = 96
#: Tasks among which the permutations are drawn; fixed, as the draw depends on it.
DRAWS = 64


def size_of(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 16).cast("long")


def crc_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def _draw(salt: int) -> Column:
    return F.xxhash64(F.lit(SEED + salt), F.coalesce(F.col("doc_id").cast("long"), crc_of()))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with shard and slot: a seeded uniform permutation, cut into shards of equal counts."""
    at = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size_of()), F.lit(0)).alias("b")).first()
    buckets = max(LEAST_BUCKETS, -(-at["b"] // BUCKET_BYTES))
    bucket = F.pmod(_draw(0), F.lit(buckets))
    counted = spool(docs.groupBy(bucket.alias("_bucket")).agg(F.count("*").cast("int").alias("_n")), "bucket-counts")
    # one row for each bucket: a task may hold them all
    start = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    started = spool(counted.select("_bucket", "_n", F.coalesce(start, F.lit(0)).cast("long").alias("_start")), "bucket-starts")
    drawn = started.repartition(DRAWS, "_bucket").sortWithinPartitions("_bucket").withColumn("_order", F.shuffle(F.sequence(F.lit(0), F.col("_n") - 1), seed=SEED))
    drawn = spool(drawn, "bucket-orders")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-at["b"] // TASK_BYTES))
    # buckets follow each other in a task; both sides of the join are dealt so, and the texts move once
    task = F.expr(f"cast(_bucket * {tasks} div {buckets} as int)")
    within = Window.partitionBy("_task", "_bucket").orderBy("_draw", "_doc", "_crc")
    whole = F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("_all")
    dealt = docs.select(whole, bucket.alias("_bucket"), _draw(1).alias("_draw"), F.col("doc_id").alias("_doc"), crc_of().alias("_crc")).withColumn("_task", task)
    ranked = dealt.repartitionById(tasks, "_task").withColumn("_rank", F.row_number().over(within) - 1)
    orders = drawn.withColumn("_task", task).repartitionById(tasks, "_task")
    placed = ranked.join(orders, ["_task", "_bucket"]).withColumn("_place", F.col("_start") + F.get("_order", F.col("_rank")))
    placed = placed.withColumn("shard", F.expr(f"(_place * {shards}) div {at['n'] or 1}").cast("int"))
    first = F.expr(f"(shard * {at['n']} + {shards - 1}) div {shards}")
    return placed.select("_all.*", "shard", (F.col("_place") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Parquet files under path/shard=k; within a file the rows stand in slot order."""
    sharded(docs, shards).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "shards")
    write_shards(docs, path)
    schema = docs.withColumns({"slot": F.lit(0).cast("long"), "shard": F.lit(0)}).schema
    back = spark.read.schema(schema).parquet(path)
    return back.select("doc_id", size_of().alias("size"), crc_of().alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
