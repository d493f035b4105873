"""Quality rules (operator 3): heuristics of the text, and a hashed n-gram log-likelihood ratio.

Words and word pairs of every document are hashed into buckets. Two multinomials over the buckets, one of
trusted documents and one of the whole corpus, give each bucket a log-likelihood ratio; a document's score
is the mean ratio over its n-grams, and one threshold decides on every document, without sampling. Half of the
trusted documents fit the ratios; the scores of the other half, which the fit hasn't seen, and those of the documents
labelled bad that pass the heuristics set the threshold where it parts them best, so it follows how sharp the ratios are
at any corpus size. The fewer scores there are, the lower it lies. Everything runs in DataFrame functions.

Trusted documents are all those that the labels call good and not toxic, bad ones all those that a label calls bad. Their ids are
broadcast up to a bound and shuffled beyond it, and the threshold is found among all their scores, which stay in Spark. Corpus
counts cover all rows.

Defined results: a null or blank text has no words, so base_failed and not kept; without n-grams the score is 0.
Without labels, or with none that fits, the ratio is 0 everywhere and the heuristics alone decide. Repeated rows
each get the same result. A null doc_id is neither trusted nor bad. Conflicting labels of one document count as the worst.
Columns of docs pass through `judged` untouched, but for those that bear the name of a verdict, which it replaces; `judgements` keeps all of them.
The verdicts pass through a generator of one row each: a filter on them can't be pushed into their nested array expressions, which would
be evaluated anew for each word.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import broadcast_if, spool, spread, table

BUCKETS = 1 << 14
#: Ids of labelled documents that are broadcast at most.
BROADCAST_IDS = 4_000_000
SMOOTHING = 1.0
#: Without bad documents to part from, the bar lies this many times the trusted documents' spread (median less 5th percentile) under their median score.
SPREADS = 3.0
#: A share of trusted documents lost weighs as much as this many times that share of bad ones rejected.
LOSS = 10.0
#: The share of bad documents rejected is taken of their number plus this, so that a few count for little.
FEW = 20
#: The bar is lowered by this many times its distance to the median, divided by the number of trusted documents.
WIDEN = 10.0
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
BASE_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _indexes(count: Column) -> Column:
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def with_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _words and _hashes: the words of the text and a 64-bit hash of each."""
    words = F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), "")
    return docs.withColumn("_words", words).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _buckets() -> Column:
    h = F.col("_hashes")
    pairs = F.transform(_indexes(F.size(h) - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1)))
    return F.transform(F.concat(h, pairs), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))


def with_base(hashed: DataFrame, text: str = "text") -> DataFrame:
    """Adds the heuristics to what with_hashes returns, and drops the text and its words: each layer of array functions copies what it carries."""
    t, h, o = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col("_hashes"), F.col("_ordered")
    kept = [c for c in hashed.columns if c not in (text, "_words")]
    out = hashed.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.select(
        *kept, F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
    )
    out = out.withColumn("_windows", F.transform(_indexes(F.size(h) - 2), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    # only texts with a window found twice go on; equal windows then lie side by side
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_ordered", F.when(twice, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop("_windows")
    out = out.withColumn("_same", F.when(o.isNotNull(), F.filter(_indexes(F.size(o) - 1), lambda k: F.get(o, k)["x"] == F.get(o, k + 1)["x"])))
    places = F.concat(F.transform("_same", lambda k: F.get(o, k)["i"]), F.transform("_same", lambda k: F.get(o, k + 1)["i"]))
    out = out.withColumn("_places", F.array_distinct(places)).drop("_ordered", "_same")
    covered = F.size(F.array_distinct(F.concat("_places", F.transform("_places", lambda i: i + 1), F.transform("_places", lambda i: i + 2))))
    out = out.withColumn("n_repeat_words", F.when(F.col("_places").isNull(), 0).otherwise(covered).cast("long")).drop("_places")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(_trusted, _fits): the documents that all their labels call good and not toxic; half of them fit, half set the bar."""
    fit = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and t = 0")
    ids = fit.select(F.col("doc_id").cast("long").alias("_trusted"))
    return spool(ids.withColumn("_fits", F.xxhash64("_trusted", F.lit("half")) % 2 == 0), "trusted")


def bad_ids(labels: DataFrame) -> DataFrame:
    """(_trusted, _fits): the documents that a label calls bad, none of which fits."""
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 0")
    return bad.select(F.col("doc_id").cast("long").alias("_trusted"), F.lit(False).alias("_fits"))


def _lowered(bar: float, median: float, n_good: int) -> float:
    return float(bar - WIDEN / n_good * max(median - bar, abs(median)))


def bar_of(good: np.ndarray, bad: np.ndarray) -> float:
    """The least score to keep, by held-out scores of trusted documents and scores of bad ones; without the former nothing can set it. bar_over is the same over tables."""
    if not len(good):
        return float("-inf")
    median, low = np.percentile(good, [50, 5])
    bar = median - SPREADS * (median - low)
    places = np.unique(np.concatenate([good, bad]))
    lost, gone = (np.searchsorted(np.sort(x), places) / n for x, n in ((good, len(good)), (bad, len(bad) + FEW)))
    best = int(np.argmax(gone - LOSS * lost))
    if best:  # otherwise no place parts them
        bar = (places[best - 1] + places[best]) / 2
    return _lowered(bar, median, len(good))


def bar_over(seen: DataFrame) -> float:
    """bar_of over seen(score, _good), a row for each document: places are ranked within ranges of scores, to which the numbers of the ranges below are added; only numbers leave Spark."""
    counted = seen.groupBy("score").agg(F.count_if("_good").alias("g"), F.count_if(~F.col("_good")).alias("b"))
    places = spool(counted.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "places")
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = spool(places.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b")), "ranges")
    n_good, n_bad = parts.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    if not n_good:
        return float("-inf")
    offsets = parts.select("part", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_below") for c in "gb"])
    inside = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = places.join(F.broadcast(offsets), "part").select("score", "g", *[(F.col(f"{c}_below") + F.sum(c).over(inside) - F.col(c)).alias(f"{c}_less") for c in "gb"])
    gain = F.col("b_less") / F.lit(float(n_bad + FEW)) - F.lit(LOSS) * (F.col("g_less") / F.lit(float(n_good)))
    ranked = spool(ranked.withColumn("gain", gain), "ranked")
    spots = [(n_good - 1) * q for q in (0.5, 0.05)]
    ranks = [int(x) + up for x in spots for up in (0, 1)]
    held = [F.max(F.when((F.col("g_less") <= k) & (F.col("g_less") + F.col("g") > k), F.col("score"))) for k in ranks]
    *at, least, (_, back) = ranked.agg(*held, F.min("score"), F.max(F.struct("gain", -F.col("score")))).first()  # the least of the best places
    median, low = (a if b is None else a + (b - a) * (x - int(x)) for x, a, b in zip(spots, at[::2], at[1::2], strict=True))
    bar, best = median - SPREADS * (median - low), -back
    if best > least:  # otherwise no place parts them
        bar = (ranked.where(F.col("score") < best).agg(F.max("score")).first()[0] + best) / 2
    return _lowered(bar, median, n_good)


def _marked(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return with_hashes(slim.join(broadcast_if(trusted, trusted.count(), BROADCAST_IDS), F.col("_id") == F.col("_trusted"), how))


def ratio_model(docs: DataFrame, trusted: DataFrame) -> Column:
    """The BUCKETS log-likelihood ratios, fitting documents against all, as one array literal."""
    counted = (
        _marked(docs, trusted, "left")
        .select(F.coalesce("_fits", F.lit(False)).cast("long").alias("good"), F.explode(_buckets()).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("good").alias("good"))
    )
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, k in counted.collect():  # BUCKETS rows at most, whatever the corpus
        raw[bucket], good[bucket] = n, k
    ratios = np.zeros(BUCKETS)
    if good.sum():
        ratios = np.log((good + SMOOTHING) / (good.sum() + SMOOTHING * BUCKETS)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS))
    return F.from_json(F.lit(json.dumps(ratios.tolist())), "array<double>")


def with_score(hashed: DataFrame, ratios: Column) -> DataFrame:
    """Adds score: the mean ratio over the words and word pairs."""
    out = hashed.withColumn("_buckets", _buckets())
    total = F.aggregate("_buckets", F.lit(0.0), lambda acc, b: acc + F.get(ratios, b))
    return out.withColumn("score", F.when(F.size("_buckets") > 0, total / F.size("_buckets")).otherwise(0.0)).drop("_buckets")


def judgements(docs: DataFrame, labels: DataFrame, carried: Column) -> DataFrame:
    """_all (the column `carried`), the heuristics, score and kept for each row of docs(doc_id, text): one pass counts n-grams, one scores the trusted documents, one all."""
    trusted = trusted_ids(labels)
    ratios = ratio_model(docs, trusted)
    known = trusted.where("not _fits").withColumn("_good", F.lit(True)).union(bad_ids(labels).withColumn("_good", F.lit(False)))
    seen = with_score(with_base(_marked(docs, spool(known, "known"), "inner")), ratios)
    seen = seen.groupBy("_trusted", "_good").agg(F.min("score").alias("score"), F.max("base_failed").alias("failed"))
    bar = bar_over(spool(seen.where("not failed").select("score", "_good"), "known-scores"))
    out = with_score(with_base(with_hashes(docs.select(carried.alias("_all"), F.col("text").cast("string").alias("text")))), ratios)
    kept = ~F.col("base_failed") & (F.col("score") >= F.lit(bar))
    verdict = F.struct(*BASE_NAMES, "score", kept.alias("kept"))
    return out.select("_all", F.explode_outer(F.array(verdict)).alias("_verdict")).select("_all", "_verdict.*")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the heuristics, score and kept added."""
    added = [*BASE_NAMES, "score", "kept"]
    whole = F.struct(*[c for c in docs.columns if c not in added])
    return judgements(docs, labels, whole).select("_all.*", *added)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judgements(docs, table(spark, sf_dir, "labels"), F.col("doc_id")).select(F.col("_all").alias("doc_id"), *BASE_NAMES, "kept", "score")
