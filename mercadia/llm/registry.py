"""The queries of this subpackage, by the names they have in __spark_entry__.py, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercadia.llm import exact_dedup, hard_negatives, licenses, merkle, topk, warc
from mercadia.llm.bpe import op5_bpe
from mercadia.llm.html_text import op8_html_text
from mercadia.llm.lm_score import op10_lm_score
from mercadia.llm.mixing import op7_mixing
from mercadia.llm.near_dedup import op4_near_dedup
from mercadia.llm.quality_rules import op3_quality_rules
from mercadia.llm.sharding import op9_sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": topk.op1_top_k,
    "op2_licenses": licenses.op2_licenses,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_warc": warc.op6_warc,
    "op7_mixing": op7_mixing,
    "op8_html_text": op8_html_text,
    "op9_sharding": op9_sharding,
    "op10_lm_score": op10_lm_score,
    "op11_merkle": merkle.op11_merkle,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_top_k": topk.ORACLE,
    "op2_licenses": licenses.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
