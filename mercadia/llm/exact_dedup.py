"""Exact dedup (operator 12), by DataFrame functions alone.

Texts are equal when they are identical after their white space is deleted. Rows are grouped by a 128-bit hash of that text; in each group the
row with the longest original text stays, then the one with the smallest doc_id. The hash only proposes: where rows share one, their texts
themselves are grouped, byte by byte, and a hash that stands for several texts is taken apart by the texts.

What moves: hashes, lengths and ids of all rows, written once; of the texts only those whose hash repeats, and of these each task sends a text
once, however often it read it. Groups of more than CROWD rows are few; their rows meet the group where they lie, by broadcast, and
all other rows by a shuffle, so that no copied text makes a heavy task.

Defined results: a null text counts as empty, and empty or blank texts are equal to each other. A null doc_id comes last in the choice of the
row that stays; keep_id is null where such a row stays. Of repeated rows one stays. An empty table gives no rows.
Other columns are ignored by `exact_groups` and carried by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import spool, table

WHITE = " \t\n\x0b\f\r"
#: Rows of a group from which on it is met by broadcast, and keys broadcast at most.
CROWD, KEYS_BROADCAST = 4096, 500_000
Digest = Callable[[Column], Column]


def normalised(text: str = "text") -> Column:
    """The text without white space; each replacement is a pass over bytes."""
    found = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for space in WHITE:
        found = F.replace(found, F.lit(space), F.lit(""))
    return found


def md5_bits(norm: Column) -> Column:
    """128 bits of content hash, as 16 bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows joined with groups(keys, n, ...), which has each key once. n is how many of the rows share a key; crowds stay where they lie."""
    if groups.count() <= KEYS_BROADCAST:
        return rows.join(F.broadcast(groups), keys, how)
    crowds = groups.where(F.col("n") > CROWD)
    if crowds.count() > KEYS_BROADCAST:
        return rows.join(groups, keys, how)
    crowds = F.broadcast(crowds)
    rest = rows.join(crowds.select(keys), keys, "left_anti")
    return rows.join(crowds, keys, "inner" if how == "left" else how).unionByName(rest.join(groups.where(F.col("n") <= CROWD), keys, how))


def _first() -> Column:
    """Longest original text, then smallest doc_id, then a row of its own."""
    return F.min(F.struct((-F.col("chars")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row")).alias("first")


def _told(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 of rows; groups are those of several rows."""
    alone = F.col("n").isNull()
    return meet(rows, groups, keys, "left").select(
        "doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, row: Column | None = None, digest: Digest = md5_bits) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text). row: a key of each row, where docs has one."""
    read = docs.select("doc_id", (F.monotonically_increasing_id() if row is None else row).alias("row"), F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("chars"), normalised().alias("norm"))
    hashed = read.withColumn("hash", digest(F.col("norm"))).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    slim = spool(hashed.drop("norm"), "hashes")
    groups = spool(slim.groupBy("hash").agg(F.count("*").alias("n"), _first()).where("n > 1"), "groups")

    again = meet(docs.select(normalised().alias("norm")).withColumn("hash", digest(F.col("norm"))), groups.select("hash", "n"), ["hash"], "left_semi")
    texts = again.groupBy("hash", "norm").agg(F.count("*").alias("m"))
    collided = spool(texts.groupBy("hash").agg(F.count("*").alias("texts"), F.sum("m").alias("n")).where("texts > 1"), "collided")
    if collided.isEmpty():
        return _told(slim, groups, ["hash"])
    apart = spool(meet(hashed, collided, ["hash"], "left_semi"), "apart")
    of_texts = spool(apart.groupBy("hash", "norm").agg(F.count("*").alias("n"), _first()).where("n > 1"), "text-groups")
    plain = F.broadcast(collided.select("hash")) if collided.count() <= KEYS_BROADCAST else collided.select("hash")
    return _told(slim.join(plain, "hash", "left_anti"), groups.join(plain, "hash", "left_anti"), ["hash"]).unionByName(_told(apart, of_texts, ["hash", "norm"]))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keyed = spool(docs.select(F.struct("*").alias("_all"), F.monotonically_increasing_id().alias("_row")), "keyed")
    gone = exact_groups(keyed.select("_row", "_all.doc_id", "_all.text"), F.col("_row")).where("not kept").select(F.col("row").alias("_row"))
    return keyed.join(gone, "_row", "left_anti").select("_all.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
