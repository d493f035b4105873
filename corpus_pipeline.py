"""A corpus pipeline over `documents`: quality rules, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and reread as the next
stage's docs. The first three return the columns of documents; the last returns one row of tokens for each row it gets.

Defined results: null and repeated doc_ids, repeated rows, null and empty texts, empty tables and further columns of any name lose or multiply
no row but those that a stage rejects, and each column comes out as it came in. The quality stage drops null and blank texts (too few words). Rows
with a null doc_id are nobody's near duplicate. The mix takes each row on its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.bpe import encoded
from mercadia.llm.common import broadcast_if, spool, table
from mercadia.llm.mixing import mixed
from mercadia.llm.near_dedup import ID_BROADCAST, near_duplicates
from mercadia.llm.quality_rules import judgements

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return judgements(docs, table(spark, sf_dir, "labels"), F.struct("*")).where("kept").select("_all.*")


def keyed(docs: DataFrame) -> DataFrame:
    """_all, a struct of docs' columns, with a key of each row, _row, written once so that every use sees the same keys."""
    return spool(docs.select(F.struct("*").alias("_all"), F.monotonically_increasing_id().alias("_row")), "keyed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows one row with the smallest doc_id; rows with a null doc_id stay. Rows that share a doc_id are told apart."""
    rows = keyed(docs)
    named = rows.where("_all.doc_id is not null").select("_row", "_all.doc_id", "_all.text")
    grouped = near_duplicates(named.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_comp"))
    grouped = spool(grouped.join(named.select("_row", "doc_id"), "_row"), "grouped")
    stays = grouped.groupBy("_comp").agg(F.min(F.struct("doc_id", "_row")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_comp", F.col("_first._row").alias("_stays"))
    stays = spool(stays, "stays")
    gone = grouped.join(broadcast_if(stays, stays.count(), ID_BROADCAST), "_comp").where("_row <> _stays").select("_row")
    gone = spool(gone, "gone")
    return rows.join(broadcast_if(gone, gone.count(), ID_BROADCAST), "_row", "left_anti").select("_all.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 rows, whatever its doc_id."""
    rows = keyed(docs)
    copies = mixed(rows.select("_row", "_all.doc_id", "_all.source", "_all.text"), ("_row",)).where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    taken = rows.join(copies, "_row")
    return taken.select("_all", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).select("_all.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text, for each row."""
    out = encoded(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_dedup), ("mixing", mix), ("bpe", tokens)]

#: The hashed likelihood ratios and the backtracking encoder have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir), name)
    return docs
