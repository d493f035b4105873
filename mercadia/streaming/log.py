"""The search log as a stream: a source, a sink that takes each batch once, and a list of popular searches that is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from mercadia.config import DEFAULT, EngineConfig
from mercadia.operators.state import log_query
from mercadia.shared import on, spool
from mercadia.sources.landed import LOG

TOP = "query string, count long, first long"


def log_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """New lines of the search log, as its files arrive, `files` at most in a batch; lines that are no JSON are dropped."""
    reader = spark.readStream.schema(f"{LOG}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path).where("_bad IS NULL").drop("_bad")


def write_batch(rows: DataFrame, number: int, path: str, name: str) -> None:
    """One batch of the stream `name`, in a folder of its own: written again, it replaces itself."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/stream={name}/batch={number}")


def log_to(stream: DataFrame, path: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of log rows to the log at path, each batch once, however often it is run. name: one for each checkpoint, as batches are numbered by it."""
    return stream.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path, name)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_logged(spark: SparkSession, path: str) -> DataFrame:
    """The log that log_to has written, with stream and batch."""
    return spark.read.schema(f"{LOG}, stream string, batch long").json(path)


def _lists(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose lists are complete."""
    at, files = on(spark, path)
    if not files.exists(at):
        return []
    names = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith("batch=")]
    return sorted(int(x.getName().removeprefix("batch=")) for x in names if files.exists(on(spark, f"{x.toString()}/_SUCCESS")[0]))


def merge_top(updated: DataFrame, number: int, path: str, k: int) -> None:
    """The list after batch `number`: of the list before it and the batch's updated counts the k best.

    Counts grow and first places stay, so what is neither in the list before nor updated can't have risen. The lists of earlier batches but the last are deleted; a batch that runs again starts from the same list as before.
    """
    spark = updated.sparkSession
    before = [n for n in _lists(spark, path) if n < number]
    rows = spool(updated.select("query", "count", "first"), "updated")
    if before:
        last = spark.read.schema(TOP).parquet(f"{path}/batch={before[-1]}")
        rows = rows.unionByName(last.join(rows.select("query"), "query", "left_anti"))
    rows.orderBy(F.desc("count"), "first").limit(k).write.mode("overwrite").parquet(f"{path}/batch={number}")
    for n in before[:-1]:
        at, files = on(spark, f"{path}/batch={n}")
        files.delete(at, True)


def popular_to(log: DataFrame, path: str, checkpoint: str, k: int | None = None, config: EngineConfig = DEFAULT, **trigger) -> StreamingQuery:
    """Keeps the k most logged queries of a stream log(query, seq) at path, the earlier first on ties, as operators.state.popular gives them for the whole log. State: a count and a first place for each query; the list has k rows."""
    k = max(1, min(config.popular if k is None else k, config.popular_most))
    counted = log.select(log_query().alias("query"), "seq").where("query <> ''").groupBy("query").agg(F.count("*").alias("count"), F.min("seq").alias("first"))
    return counted.writeStream.outputMode("update").foreachBatch(lambda rows, number: merge_top(rows, number, path, k)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_popular(spark: SparkSession, path: str) -> DataFrame:
    """query, count: the last complete list, in order."""
    done = _lists(spark, path)
    rows = spark.read.schema(TOP).parquet(f"{path}/batch={done[-1]}") if done else spark.createDataFrame([], TOP)
    return rows.orderBy(F.desc("count"), "first").select("query", "count")
