"""Language-model scoring (operator 10).

A log-bilinear model predicts each token's class from the two tokens before it: the context's word vectors, each through a matrix
of its place, sum to a vector whose products with the classes' vectors, plus biases, are the logits. It is trained by
noise-contrastive estimation in numpy, on all training tokens: a hash of doc_id and text deals the documents into lots of about
LOT tokens, as many as the corpus needs. In each of ROUNDS rounds its share of the lots starts from the common parameters, each
lot in an order fixed by the hash, and the results are averaged by training tokens, in a tree of a fixed order. So neither the files
nor the partitions nor a lost executor change the scores. The normaliser of every context is one entry of a product of two matrices,
so probabilities are exact.

Classes: the end token, the WORDS commonest words one by one, and for all other words TAILS classes by their last three
characters. A word of a tail class has the class's probability times its add-one share of the class, where one further
share is for words never seen; so the model is a distribution over words. What the neural part learns has a fixed size; counts and
shares within the tail classes grow with the corpus.

Counts: every word is counted, in tasks first, then by a shuffle, with its places in training and in held-out texts. The KNOWN words
with the most places are broadcast (their number is fixed); the rarer words of each document meet their counts in a join, and only
sums return to the documents. So no word of the join has more than one KNOWN-th of all places.

Defined results: a null or blank text is one end token. A null doc_id counts as training (its text form is empty).
Repeated rows are documents of their own in training; in the result each comes out. Without training documents N and
V are 0, every known count is 0, and the model is uniform over classes. Other columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import spool, spread, table

WORDS, TAILS, KNOWN = 1023, 256, 65_536
CLASSES = 1 + WORDS + TAILS
DEPTH, NOISE, BATCH, STEP, ROUNDS = 16, 20, 4096, 0.15, 2
#: Training tokens of a lot, and how many lots' parameters meet in one sum.
LOT, FAN = 1 << 20, 32
FLUSH = 400_000
SEED = 11
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SHAPES = {"words": (CLASSES, DEPTH), "place_1": (DEPTH, DEPTH), "place_2": (DEPTH, DEPTH), "classes": (CLASSES, DEPTH), "bias": (CLASSES,)}


def tail_class(word: str) -> int:
    return 1 + WORDS + zlib.crc32(word[-3:].encode()) % TAILS


def tokens_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case; bytes.split cuts at the contract's white space."""
    return (text or "").encode().translate(_LOWER).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        for k, found in enumerate(seen):
            none, n = pa.array(np.zeros(len(found), np.int64)), pa.array(list(found.values()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), none if k else n, n if k else none], names=["word", "c", "held"])
            found.clear()

    for batch in batches:
        for text, held in zip(batch.column("text"), batch.column("held_out").to_pylist(), strict=True):
            seen[held].update(tokens_of(text.as_py()))
            if len(seen[held]) > FLUSH:
                yield from flush()
    yield from flush()


class Lexicon:
    """The words with the most places, those commonest in training first, with class, count and tail shares."""

    def __init__(self, words: list[tuple[str, int]], tails: dict[int, tuple[int, int]], docs: int, total: int, distinct: int) -> None:
        self.number = {w.encode(): k for k, (w, _) in enumerate(words)}
        self.docs, self.total, self.distinct = docs, total, distinct
        self.logs = np.log10(np.array([c for _, c in words], float) + 1)
        self.kind = np.array([1 + k if k < WORDS else tail_class(w) for k, (w, _) in enumerate(words)], np.int32)
        self.tail_norm = np.zeros(CLASSES)
        counts = np.zeros(CLASSES)
        counts[0] = docs
        for k, (_, c) in enumerate(words[:WORDS]):
            counts[1 + k] = c
        for k in range(1 + WORDS, CLASSES):
            c, v = tails.get(k, (0, 0))
            counts[k] = c
            self.tail_norm[k] = np.log10(c + v + 1)
        self.share = (counts + 1) / (counts + 1).sum()
        self.norm = float(np.log10(total + distinct + 1))

    def numbers(self, text: str | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words, their places among the commonest (-1: not there) and their classes."""
        words = tokens_of(text)
        get = self.number.get
        at = np.array([get(w, -1) for w in words], np.int32)
        kinds = self.kind[at] if len(self.kind) else np.zeros(len(at), np.int32)
        for k in np.flatnonzero(at < 0).tolist():
            kinds[k] = tail_class(words[k].decode())
        return words, at, kinds


def fresh(lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Parameters to begin with: the classes' shares as biases, small random vectors."""
    draw = np.random.default_rng(SEED)
    out = {k: draw.normal(0, 0.1, s) for k, s in _SHAPES.items()}
    out["place_1"], out["place_2"] = np.eye(DEPTH) * 0.5, np.eye(DEPTH)
    out["classes"] = draw.normal(0, 0.01, _SHAPES["classes"])
    out["bias"] = np.log(lexicon.share)
    return out


def trained(params: dict[str, np.ndarray], share: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[dict[str, np.ndarray], int]:
    """The parameters after one run over chunks of (token two before, token before, token), by noise-contrastive estimation with Adagrad steps; and how many tokens."""
    p = {k: v.astype(np.float32) for k, v in params.items()}
    past = {k: np.full(v.shape, 0.1, np.float32) for k, v in p.items()}
    draw = np.random.default_rng(seed)
    steps = np.cumsum(share)
    odds = np.log(NOISE * share).astype(np.float32)
    n = 0
    for far, near, target in chunks:
        n += len(target)
        noise = np.minimum(np.searchsorted(steps, draw.random(NOISE)), CLASSES - 1)
        a, b = p["words"][far], p["words"][near]
        context = a @ p["place_2"] + b @ p["place_1"]
        goal, other = p["classes"][target], p["classes"][noise]
        right = 1 / (1 + np.exp((context * goal).sum(axis=1) + p["bias"][target] - odds[target]))  # 1 - P(data)
        wrong = -1 / (1 + np.exp(-(context @ other.T + p["bias"][noise] - odds[noise])))  # -P(data)
        back = right[:, None] * goal + wrong @ other
        slope = {k: np.zeros_like(v) for k, v in p.items()}
        np.add.at(slope["classes"], target, right[:, None] * context)
        np.add.at(slope["classes"], noise, wrong.T @ context)
        slope["bias"] = (np.bincount(target, right, CLASSES) + np.bincount(noise, wrong.sum(axis=0), CLASSES)).astype(np.float32)
        slope["place_1"], slope["place_2"] = b.T @ back, a.T @ back
        np.add.at(slope["words"], near, back @ p["place_1"].T)
        np.add.at(slope["words"], far, back @ p["place_2"].T)
        for k, g in slope.items():
            g /= np.sqrt(len(target))
            past[k] += g * g
            p[k] += STEP * g / np.sqrt(past[k])
    return p, n


def _contexts(texts: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of (token two before, token before, token) of texts, each given by the classes of its words."""
    held, n = [], 0
    for kinds in texts:
        held.append(np.concatenate([[0, 0], kinds, [0]]))
        n += len(kinds) + 1
        if n >= BATCH:
            row = [np.concatenate([h[k : len(h) - 2 + k] for h in held]) for k in range(3)]
            for low in range(0, n, BATCH):
                yield tuple(x[low : low + BATCH] for x in row)
            held, n = [], 0
    if held:
        yield tuple(np.concatenate([h[k : len(h) - 2 + k] for h in held]) for k in range(3))


PREPARED = "doc_id long, held_out boolean, lot int, draw long, n_tokens long, n_known long, base double, within double, rare array<string>, kinds array<short>"


def prepared(docs: DataFrame, lexicon, lots: int) -> DataFrame:
    """PREPARED and _row, a key of the row: all that the lexicon says of each document, so that texts are cut into words once.

    kinds are the classes of its words, within the part of its score that lies inside tail classes, rare the words outside the lexicon.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        end_log = np.log10(known.docs + 1)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                n_tokens, n_known, base, inside, rare, ends, classes = [], [], [], [], [], [0], []
                for text in part.column("text"):
                    words, at, kinds = known.numbers(text.as_py())
                    seen = at >= 0
                    logs = known.logs[at[seen]]
                    n_tokens.append(len(words) + 1)
                    n_known.append(int((logs > 0).sum()) + (known.docs > 0))
                    base.append(float(logs.sum() + end_log - known.norm * (len(words) + 1)))
                    inside.append(float(logs[kinds[seen] > WORDS].sum() - known.tail_norm[kinds].sum()))
                    rare += [words[k].decode() for k in np.flatnonzero(~seen).tolist()]
                    ends.append(len(rare))
                    classes.append(kinds.astype(np.int16))
                missing = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.string()))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, classes)]), pa.int32()), pa.array(np.concatenate(classes), pa.int16()))
                arrays = [*(part.column(c) for c in ("doc_id", "held_out", "lot", "draw")), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base), pa.array(inside), missing, lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lot", "draw", "n_tokens", "n_known", "base", "within", "rare", "kinds"])

    draw = F.xxhash64(F.lit(SEED), "doc_id", "text")
    slim = docs.withColumn("draw", draw).withColumn("lot", F.pmod("draw", F.lit(lots)).cast("int")).select("doc_id", "held_out", "lot", "draw", "text")
    return spool(slim.mapInArrow(run, PREPARED).withColumn("_row", F.monotonically_increasing_id()), "prepared")


def _averaged(group: pa.Table) -> pa.Table:
    """One row of parameters for those of up to FAN lots, averaged by tokens in the order of the lots."""
    group = group.sort_by("lot")
    n = group.column("n").to_numpy()
    total = sum(k * np.frombuffer(x.as_py(), np.float32).astype(np.float64) for k, x in zip(n, group.column("params"), strict=True))
    return pa.table({"lot": pa.array([group.column("lot")[0].as_py() // FAN], pa.int32()), "n": pa.array([n.sum()], pa.int64()), "params": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def fit(ready: DataFrame, lexicon, lots: int) -> dict[str, np.ndarray]:
    """ROUNDS rounds of training lot by lot and averaging; ready is what `prepared` gave, lots a multiple of ROUNDS."""
    spark = ready.sparkSession
    params = fresh(lexicon.value)
    ends = np.cumsum([0, *(int(np.prod(s)) for s in _SHAPES.values())])
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple[int, np.ndarray]]:
                for batch in batches:
                    kinds = batch.column("kinds")
                    at, flat = kinds.offsets.to_numpy(), kinds.values.to_numpy()
                    for lot, a, b in zip(batch.column("lot").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        yield lot, flat[a:b]

            for lot, group in itertools.groupby(rows(), lambda r: r[0]):
                p, n = trained(sent.value, lexicon.value.share, _contexts(r[1] for r in group), SEED + lot)
                flat = np.concatenate([p[k].ravel() for k in _SHAPES]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([lot // ROUNDS], pa.int32()), pa.array([n], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["lot", "n", "params"])

        schema, left = "lot int, n long, params binary", lots // ROUNDS
        mine = ready.where(~F.col("held_out") & (F.col("lot") % ROUNDS == turn)).select("lot", "draw", "doc_id", "kinds").repartition(left, "lot").sortWithinPartitions("lot", "draw", "doc_id", "kinds")
        found = mine.select("lot", "kinds").mapInArrow(run, schema)
        while left > 1:
            found, left = found.groupBy(F.expr(f"lot div {FAN}").alias("g")).applyInArrow(_averaged, schema), -(-left // FAN)
        for row in found.select("params").collect():  # one row, or none without training documents
            flat = np.frombuffer(row["params"], np.float32).astype(np.float64)
            params = {k: flat[a:b].reshape(s) for (k, s), a, b in zip(_SHAPES.items(), ends[:-1], ends[1:], strict=True)}
    return params


def normalised(params: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 tables: near[i, w] + far[j, w] - norm[i, j] is the log-probability of class w after j and i."""
    near = params["words"] @ params["place_1"] @ params["classes"].T
    far = params["words"] @ params["place_2"] @ params["classes"].T + params["bias"]
    top_near, top_far = near.max(axis=1, keepdims=True), far.max(axis=1, keepdims=True)
    norm = np.log(np.exp(near - top_near) @ np.exp(far - top_far).T) + top_near + top_far.T
    return tuple((x / np.log(10)).astype(np.float32) for x in (near, far, norm))


def commonest(counts: DataFrame, most: int = KNOWN) -> list[tuple[str, int]]:
    """(word, c) of the `most` words of counts(word, c, held) with the most places, those with the greatest c first.

    A histogram of the places, in steps of a sixteenth of a power of two, tells where to cut before anything is sorted.
    """
    step = F.floor(F.log2(F.col("c") + F.col("held")) * 16).cast("int")
    steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 1,024 steps at most
    held, cut = 0, -1
    for s, n in steps:
        held, cut = held + n, s
        if held >= most:
            break
    first = spool(counts.where(step >= cut).orderBy(F.desc(F.col("c") + F.col("held")), "word").limit(most).select("word", "c"), "commonest")
    return sorted(((r["word"], r["c"]) for r in first.collect()), key=lambda x: (-x[1], x[0]))


def learned(docs: DataFrame) -> tuple[DataFrame, DataFrame, Lexicon, dict[str, np.ndarray]]:
    """Counts (word, c, held), what `prepared` gives, lexicon and parameters of docs(doc_id, text, held_out)."""
    spark = docs.sparkSession
    counts = spool(docs.mapInArrow(_count, "word string, c long, held long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("held").alias("held")), "counts")
    n_docs = docs.where("not held_out").count()
    sums = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = commonest(counts)
    lone = spark.createDataFrame([(w,) for w, _ in common[:WORDS]], "word string")
    tail = (F.crc32(F.right("word", F.lit(3)).cast("binary")) % TAILS + 1 + WORDS).cast("int")
    rest = counts.where("c > 0").join(F.broadcast(lone), "word", "left_anti")
    tails = {r["k"]: (r["c"], r["v"]) for r in rest.groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}  # TAILS rows at most
    lexicon = Lexicon(common, tails, n_docs, sums["n"] + n_docs, sums["v"] + (n_docs > 0))
    lots = ROUNDS * max(1, -(-lexicon.total // (ROUNDS * LOT)))
    sent = spark.sparkContext.broadcast(lexicon)
    ready = prepared(docs, sent, lots)
    return counts, ready, lexicon, fit(ready, sent, lots)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (code % 7 == 2).alias("held_out"))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    counts, ready, lexicon, params = learned(marked(docs))
    tables = docs.sparkSession.sparkContext.broadcast(normalised(params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, norm = tables.value
        for batch in batches:
            score = []
            for kinds, within in zip(batch.column("kinds"), batch.column("within").to_pylist(), strict=True):
                row = np.concatenate([[0, 0], kinds.values.to_numpy(), [0]])
                j, i, w = row[:-2], row[1:-1], row[2:]
                score.append(within + float((near[i, w] + far[j, w] - norm[i, j]).sum(dtype=np.float64)))
            arrays = [*(batch.column(c) for c in ("_row", "doc_id", "held_out", "n_tokens", "n_known", "base")), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    schema = "_row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    partly = ready.select("_row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "kinds").mapInArrow(run, schema)
    found = ready.select("_row", F.explode("rare").alias("word")).join(counts.where("c > 0"), "word").groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count("*").alias("more"))
    whole = partly.join(found, "_row", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    total = F.lit(lexicon.total).cast("long").alias("train_tokens")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), total, (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spread(table(spark, sf_dir, "documents")))
