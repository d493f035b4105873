"""Mixing sources to target weights by entropy balancing (operator 7).

Targets: the sources share 150 % of all words by their weights; none gets more than twice its own words, and the excess
goes to the others by weight. That is a water level: target = min(2 * words, level * weight).

Rates: each document gets the rate r in [0, 2] that, source by source, is closest to 1 in entropy (sum of r ln r - r)
among those whose words meet the target. The dual has one multiplier for each source, and its solution is an
exponential tilt of the documents' sizes: r = min(2, exp(m * size / mean size)). Newton steps on the dual run for
all sources at once, as aggregations over the table of (source, size, documents), each bracketed so that it converges.

Copies: a document is taken 0, 1 or 2 times. Going from long to short documents, each size takes as many copies as
its rates and the words still owed ask for, so a source ends within half the size of its shortest documents
of its target, where its sizes allow; which documents of one size get the extra copy is decided by a seeded hash.

Skew: after one aggregation to (source, size) counts nothing depends on a source's share. Copies are dealt in
(source, size, bin of the hash) groups, so that a crowd of equal sizes is ranked by many tasks.

Defined results: a null text has size 0 and is never taken. Null sources are a source of their own, the last. Repeated
rows are documents of their own. A source without words has target 0. Empty tables give no rows. Columns that clash
with those added are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import WORD, respool, spool, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
SEED = 77_003
BINS = 64
#: Each step halves the gap or the bracket, so this many are never needed.
STEPS = 400
CLOSE = 1e-9
SLIM = ["doc_id", "source", "size"]


def words_in(text: str = "text") -> Column:
    """How many words the text has: places where a word starts."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """_s (null-safe source key), source_size, target of each source. One row for each source: a task may hold them all."""
    by = sizes.groupBy("_s").agg(F.sum("_words").alias("source_size"))
    order = Window.orderBy(F.col("_s.missing"), F.col("_s.name"))
    weight = F.array(*map(F.lit, WEIGHTS))
    by = by.withColumn("weight", F.get(weight, F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("_s.missing"), F.col("_s.name"))
    rest, before = ratio.rowsBetween(0, Window.unboundedFollowing), ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_words = F.sum("source_size").over(Window.partitionBy())
    # with the sources of smaller ratio at their caps, the level that the others would share; the true level is the highest of these
    level = (SHARE * all_words - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(Window.partitionBy()))
    return by.select("_s", "source_size", F.least(MOST * F.col("source_size"), F.col("level") * F.col("weight")).cast("double").alias("target"))


def multipliers(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """_s, unit, m: the dual's solution for each source whose target lies between 0 and twice its words."""
    mean = sizes.groupBy("_s").agg((F.sum("_words") / F.sum("docs")).alias("unit"))
    state = wanted.join(mean, wanted["_s"].eqNullSafe(mean["_s"])).select(wanted["_s"], "target", "unit").where("target > 0 and unit > 0")
    state = spool(state.withColumns({"m": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "gap": F.lit(1e300)}), "newton")
    path = None
    for _ in range(STEPS):
        joined = sizes.join(state, "_s")
        rate = F.exp(F.least(F.col("m") * F.col("size") / F.col("unit"), F.lit(float(700))))
        value = F.sum(F.col("_words") * F.least(F.lit(MOST), rate)).alias("value")
        slope = F.sum(F.when(rate < MOST, F.col("_words") * rate * F.col("size") / F.col("unit")).otherwise(0.0)).alias("slope")
        now = joined.groupBy("_s", "target", "unit", "m", "low", "high", F.col("gap").alias("before")).agg(value, slope)
        now = now.withColumns({
            "gap": F.abs(F.col("value") - F.col("target")) / F.col("target"),
            "low": F.when(F.col("value") < F.col("target"), F.greatest("low", "m")).otherwise(F.col("low")),
            "high": F.when(F.col("value") > F.col("target"), F.least("high", "m")).otherwise(F.col("high")),
            "step": F.when(F.col("slope") > 0, F.col("m") + (F.col("target") - F.col("value")) / F.col("slope")),
        })
        # a step that leaves the bracket, or after one that did not halve the gap: the bracket's middle, or twice as far where it has no end yet
        middle = F.when(F.col("high") >= 1e6, F.greatest(2 * F.col("low"), F.lit(1.0))).when(F.col("low") <= -1e6, F.least(2 * F.col("high"), F.lit(-1.0))).otherwise((F.col("low") + F.col("high")) / 2)
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("low")) & (F.col("step") < F.col("high")) & (F.abs(F.col("step") - F.col("m")) < 20) & (F.col("gap") <= F.col("before") / 2)
        moved = F.when(F.col("gap") <= CLOSE, F.col("m")).when(inside, F.col("step")).otherwise(middle)
        state, path = respool(now.select("_s", "target", "unit", moved.alias("m"), "low", "high", "gap"), "newton", path)
        if not state.where((F.col("gap") > CLOSE) & (F.col("high") - F.col("low") > 1e-14 * F.greatest(F.abs("m"), F.lit(1.0)))).limit(1).count():
            return state.select("_s", "unit", "m")
    raise RuntimeError(f"the rates of some sources have not converged in {STEPS} steps")


def _dealt(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for each size of one source, long to short: what the rates ask for and what is owed so far. One row for each distinct size."""
    cells = cells.sort_values("size", ascending=False)
    owed, copies = 0.0, []
    for size, docs, rate in zip(cells["size"], cells["docs"], cells["rate"], strict=True):
        asked = docs * rate * size + owed
        k = min(max(round(asked / size), 0), 2 * docs) if size else 0
        owed = asked - k * size if size else owed
        copies.append(k)
    return cells.assign(copies=copies)[["name", "missing", "size", "copies"]]


def mixed(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken and the columns `keys` for each row of docs(doc_id, source, text, keys)."""
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    sized = spool(docs.select("doc_id", key.alias("_s"), words_in().alias("size"), F.xxhash64(F.col("text").cast("string")).alias("_text"), *keys), "sizes")
    sizes = spool(sized.groupBy("_s", "size").agg(F.count("*").alias("docs")).withColumn("_words", F.col("size") * F.col("docs")), "size-counts")
    wanted = spool(targets(sizes), "targets")
    tilt = multipliers(sizes, wanted.where(f"target < source_size * {MOST} * (1 - 1e-12)"))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("m").isNull(), MOST).otherwise(F.least(F.lit(MOST), F.exp(F.least(F.col("m") * F.col("size") / F.col("unit"), F.lit(700.0)))))
    rated = sizes.join(wanted, "_s").join(tilt, "_s", "left").select("_s.name", "_s.missing", "size", "docs", rate.alias("rate"))
    cells = rated.groupBy("name", "missing").applyInPandas(_dealt, "name string, missing boolean, size long, copies long")
    cells = spool(sizes.join(cells.select(F.struct("missing", "name").alias("_s"), "size", "copies"), ["_s", "size"]).join(wanted, "_s"), "cells")

    # the rank of each document among those of its source and size, by a seeded hash, bin by bin
    draw = F.xxhash64(F.lit(SEED), "doc_id", "size")
    binned = sized.withColumn("_draw", draw).withColumn("_bin", F.pmod(F.shiftright("_draw", 20), F.lit(BINS)).cast("int"))
    bins = binned.groupBy("_s", "size", "_bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_s", "size").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("before", before).join(cells, ["_s", "size"])
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_bin").orderBy("_draw", "doc_id", "_text", *keys))  # of rows that share a doc_id the text decides, not the order they came in
    ranked = binned.withColumn("_rank", rank).join(bins, ["_s", "size", "_bin"])
    extra = (F.col("before") + F.col("_rank") <= F.col("copies") % F.col("docs")).cast("long")
    each = F.expr("copies div docs") + extra
    return ranked.select("doc_id", "size", "source_size", "target", each.alias("copies"), (each * F.col("size")).alias("taken"), *keys)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("copies")
