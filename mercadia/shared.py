"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where a local test session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='mercadia-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def on(spark: SparkSession, path: str):
    """The path as Hadoop has it, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, size and time of the files at path, a file or a folder of files: the same as long as nobody has changed them."""
    at, files = on(spark, path)
    return [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(at)]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/mercadia-{spark.sparkContext.applicationId}"
    if path not in _made:
        at, files = on(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _made.add(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs only a re-read."""
    return respool(df, name, None)[0]


def respool(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
    """spool for the rounds of a loop: the table and its path; the table at `old`, which df was made of and nothing else needs, is deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if old is not None:
        at, files = on(spark, old)
        files.delete(at, True)
    return spark.read.schema(df.schema).parquet(path), path
