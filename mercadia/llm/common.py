"""What the corpus operators share: joins that spread crowds, and byte-level tokenising in numpy. Intermediate tables are mercadia.shared's."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.shared import fresh_path, respool, shared_dir, spool

__all__ = ["fresh_path", "respool", "shared_dir", "spool"]

#: White space of the contracts: a word is a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint where the counted rows are within the limit; beyond it df stays as it is and the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def salted_join(many: DataFrame, few: DataFrame, rows: int, limit: int, keys: list[str], by: Column, salts: int) -> DataFrame:
    """many joined with few, which has each key once. Beyond `limit` counted rows few goes to each of `salts` parts of a key, so a crowd of one key spreads over as many tasks."""
    if rows <= limit:
        return many.join(F.broadcast(few), keys)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


#: Crowds whose keys may be broadcast, and parts that a crowd is spread over where its rows of few may not.
HOT_KEYS, HOT_SALTS = 1_000_000, 32


def hot_join(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame, limit: int) -> DataFrame:
    """many joined with few, which has each key once; hot(keys) are the keys that a crowd of many's rows share.

    Their rows of few are broadcast if they are within the limit, so that a crowd stays where it lies; beyond it they go to HOT_SALTS parts of each crowd. All other keys meet by a shuffle.
    """
    n = hot.count()
    if n == 0 or n > HOT_KEYS:
        return many.join(few, keys)
    hot = F.broadcast(hot)
    rest, crowds, theirs = many.join(hot, keys, "left_anti").join(few, keys), many.join(hot, keys, "left_semi"), few.join(hot, keys, "left_semi")
    if n <= limit:
        return rest.unionByName(crowds.join(F.broadcast(theirs), keys))
    part = F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), F.lit(HOT_SALTS)).cast("int")
    spread_out = theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))))
    return rest.unionByName(crowds.withColumn("_part", part).join(spread_out, [*keys, "_part"]).drop("_part"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where a few files of few row groups, each of which is one task, leave cores idle; larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if 0 < busy < cores else df


def byte_table(pattern: str) -> np.ndarray:
    """256 flags: does the byte, as a Latin-1 character, match the pattern? Bytes from 0x80 on count as letters of UTF-8 text."""
    return np.array([bool(re.match(pattern, chr(b))) for b in range(256)], dtype=bool)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and where each row starts and ends in them; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int):
    """Ranges of rows of about `most` bytes each; a longer row comes alone and whole."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in `data`, and the number of the first word of each row (with the total at the end). No word goes beyond a row."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)
