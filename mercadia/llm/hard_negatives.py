"""Hard negatives by a multiway hyperplane tree of distance ranges (operator 13).

A tree is fitted on a sample of at most SAMPLE rows: a node has up to FAN split points, far from each other, and a row goes to the nearest one.
Every row descends to a leaf. Then, over all rows, each node gets for each split point and each child the least and the greatest distance from
the point to the rows below that child, and the range of their lengths. The tree and its ranges are of a size that depends on FAN and
the depth alone, so the driver holds them and ships them with the functions.

A search asks for rows whose inner product with the anchor lies in a window. With the lengths of a child's rows the window is an annulus of
distances round the anchor, hence by the triangle inequality one round each split point; a child whose range misses one of them is eliminated, as is
one whose hyperplanes lie beyond the annulus. What is left meets the anchor in exact leaves.

Each search goes twice: the anchor's own leaf gives a score that k rows reach for certain, which narrows the window from below; then the tree.
The positives are such a search among rows of the label with an open window, the negatives among the others, with a window for each positive.

Anchors and rows meet in groups of a leaf's block of rows and a lot of anchors, both of bounded size, so copies of one vector, whether rows or
anchors, spread. The answer depends on neither sample, tree nor blocks.

Defined results: rows with null vec_id, label or vector, an empty vector, or null or non-finite components take no part. Vectors of different lengths
are not compared: of the sample's commonest length the tree is made, every other is a leaf of its own. Rows that repeat a vec_id are candidates each; as
an anchor a vec_id counts once, with its smallest vector. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import spool, table
from mercadia.llm.topk import integers

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: The window of a negative's score, in percent of the positive's.
LOW, HIGH = 50, 95
#: Rows that the tree is fitted on, split points of a node, depths, and rows of a leaf for which it grows deeper.
SAMPLE, FAN, DEPTHS, LEAF_ROWS = 16_384, 8, (2, 4), 32_768
#: Rows of a block and anchors of a lot, and scores held at a time.
BLOCK_ROWS, LOT_ROWS, SCORES = 65_536, 16_384, 1 << 22
WINDOWS = "array<struct<wid:long,lo:long,hi:long>>"
#: An open end of a window.
OPEN = 1 << 62


@dataclass
class Node:
    """Split points, and for each the child: a node's number, or ~leaf. near and far: the distances from point i to the rows below child j; short and long: the squares of their lengths."""

    points: np.ndarray
    kids: list[int]
    near: np.ndarray = field(init=False)
    far: np.ndarray = field(init=False)
    short: np.ndarray = field(init=False)
    long: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        m = len(self.points)
        self.near, self.far = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        self.short, self.long = np.full(m, np.inf), np.full(m, -np.inf)


def distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * rows @ points.T
    return np.sqrt(np.maximum(squares, 0))


def split_points(rows: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Up to FAN different rows of a few drawn ones, each the farthest from those before."""
    drawn = rows[draw.choice(len(rows), min(len(rows), 4 * FAN), replace=False)]
    chosen = [0]
    away = distances(drawn, drawn[:1])[:, 0]
    while len(chosen) < FAN and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(drawn, drawn[chosen[-1:]])[:, 0])
        away[chosen] = 0
    return drawn[chosen]


def grow(sample: np.ndarray, depth: int) -> list[Node]:
    """The tree, its root first; without nodes all rows are leaf 0."""
    draw, nodes, leaves = np.random.default_rng(13), [], 0

    def add(rows: np.ndarray, left: int) -> int:
        nonlocal leaves
        points = split_points(rows, draw) if left and len(rows) > 4 * FAN else rows[:0]
        if len(points) < 2:
            leaves += 1
            return ~(leaves - 1)
        at = len(nodes)
        nodes.append(Node(points, []))
        nearest = distances(rows, points).argmin(axis=1)
        nodes[at].kids = [add(rows[nearest == j], left - 1) for j in range(len(points))]
        return at

    if len(sample):
        add(sample, depth)
    return nodes


def descend(nodes: list[Node], rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Each node and child with the numbers of the rows that go there, and their distances from the node's points."""
    waiting = [(0, np.arange(len(rows)))] if nodes else []
    while waiting:
        at, which = waiting.pop()
        if len(which):
            away = distances(rows[which], nodes[at].points)
            nearest = away.argmin(axis=1)
            for j, kid in enumerate(nodes[at].kids):
                mine = nearest == j
                yield at, j, which[mine], away[mine]
                if kid >= 0:
                    waiting.append((kid, which[mine]))


def leaves_of(nodes: list[Node], rows: np.ndarray) -> np.ndarray:
    found = np.zeros(len(rows), np.int64)
    for at, j, which, _ in descend(nodes, rows):
        if nodes[at].kids[j] < 0:
            found[which] = ~nodes[at].kids[j]
    return found


def surviving(nodes: list[Node], anchors: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each leaf with the numbers of the windows that may have rows there. Window k is of anchor of[k] and has the scores low[k] to high[k]."""
    squares = (anchors * anchors).sum(axis=1)
    low, high = (np.where(np.abs(x) >= OPEN, np.sign(x) * np.inf, x.astype(float)) for x in (low, high))
    if not nodes:
        yield 0, np.arange(len(of))
        return
    waiting = [(0, np.arange(len(of)))]
    while waiting:
        at, which = waiting.pop()
        if not len(which):
            continue
        node = nodes[at]
        away = distances(anchors, node.points)[of[which]]
        size = squares[of[which]]
        widest = (node.points * node.points).sum(axis=1).max()
        for j, kid in enumerate(node.kids):
            if not np.isfinite(node.short[j]):
                continue  # no rows there
            slack = 1e-6 * np.sqrt(size + node.long[j] + widest)  # well above what rounding does to a distance
            inner = size + node.short[j] - 2 * high[which]
            outer = size + node.long[j] - 2 * low[which]
            fits = outer >= -slack * slack
            inner, outer = np.sqrt(np.maximum(inner, 0)) - slack, np.sqrt(np.maximum(outer, 0)) + slack
            least = np.maximum(np.maximum(away - outer[:, None], inner[:, None] - away), 0)
            fits &= ((least <= node.far[:, j] + slack[:, None]) & (away + outer[:, None] >= node.near[:, j] - slack[:, None])).all(axis=1)
            fits &= away[:, j] - away.min(axis=1) <= 2 * outer
            if kid < 0:
                yield ~kid, which[fits]
            else:
                waiting.append((kid, which[fits]))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as integers: by floating point where all sums are exact in it."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    return (anchors.astype(float) @ rows.T.astype(float)).astype(np.int64) if most < 2.0**53 else anchors.astype(np.int64) @ rows.T.astype(np.int64)


def _flat(asked: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The windows of all rows end to end: the row, wid, lo and hi of each."""
    windows = asked.column("windows")
    windows = windows.combine_chunks() if isinstance(windows, pa.ChunkedArray) else windows
    lengths = np.array([len(x) for x in windows], dtype=np.int64)
    parts = windows.flatten()
    return (np.repeat(np.arange(len(lengths)), lengths), *(parts.field(c).to_numpy(zero_copy_only=False) for c in ("wid", "lo", "hi")))


def _best(k: int, same: bool):
    """The k best rows of a block in each window of a lot of anchors, ties to the smaller vec_id."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(rows) and len(asked):
            rows = rows.sort_by("vec_id")
            ids, labels, vectors = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows.column("v"))
            own, mine, anchors = asked.column("query_id").to_numpy(), asked.column("label").to_numpy(), matrix(asked.column("v"))
            of, wid, low, high = _flat(asked)
            step = max(1, SCORES // len(ids))
            for first in range(0, len(own), step):
                scores = scores_of(anchors[first : first + step], vectors)
                for w in np.flatnonzero((of >= first) & (of < first + step)):
                    q = of[w]
                    s = scores[q - first]
                    at = np.flatnonzero((s >= low[w]) & (s <= high[w]) & ((labels == mine[q]) == same) & (ids != own[q]))
                    if len(at) > k:
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                        at = at[np.argsort(-s[at], kind="stable")[:k]]
                    out.append((np.full(len(at), own[q]), np.full(len(at), wid[w]), ids[at], s[at]))
        return pa.table(dict(zip(("query_id", "wid", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


@dataclass
class Tree:
    """rows(leaf, vec_id, label, v), written, and the tree over those of length dim. sizes: the rows of each leaf; those of other lengths have the leaf -length."""

    nodes: list[Node]
    dim: int
    rows: DataFrame
    sizes: dict[int, int]

    def leaf(self, batch: pa.RecordBatch) -> np.ndarray:
        """The leaf of each row of a batch with v."""
        length = np.array([len(x) for x in batch.column("v")], np.int64)
        leaf, inside = -length, np.flatnonzero(length == self.dim)
        leaf[inside] = leaves_of(self.nodes, matrix(batch.column("v").take(pa.array(inside))).astype(float))
        return leaf


def _ranges(nodes: list[Node], dim: int):
    """For each node, child and split point the distances of a task's rows; point -1 has the squares of their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int, int], tuple[float, float]] = {}
        for batch in batches:
            rows = matrix(batch.column("v").filter(pa.array([len(x) == dim for x in batch.column("v")], pa.bool_()))).astype(float) if len(batch) else np.zeros((0, dim))
            for at, j, which, away in descend(nodes, rows):
                if len(which):
                    size = (rows[which] ** 2).sum(axis=1)[:, None]
                    for i, values in enumerate(np.concatenate([size, away], axis=1).T, start=-1):
                        low, high = seen.get((at, j, i), (np.inf, -np.inf))
                        seen[at, j, i] = min(low, values.min()), max(high, values.max())
        keys = np.array(list(seen), np.int32).reshape(-1, 3)
        ends = np.array(list(seen.values()), float).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([*map(pa.array, keys.T), *map(pa.array, ends.T)], names=["node", "child", "point", "low", "high"])

    return run


def plant(rows: DataFrame) -> Tree:
    """The tree over rows(vec_id, label, v)."""
    n = rows.count()
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).select("v").collect()]
    dim = Counter(map(len, sample)).most_common(1)[0][0] if sample else 0
    depth = next((d for d in range(DEPTHS[0], DEPTHS[1]) if n <= LEAF_ROWS * FAN**d), DEPTHS[1])
    tree = Tree(grow(np.array([v for v in sample if len(v) == dim], float), depth), dim, rows, {})

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place.leaf(batch)), *batch.columns], names=["leaf", *batch.schema.names])

    place = Tree(tree.nodes, dim, None, {})  # what a task needs
    kind = rows.schema["v"].dataType.simpleString()
    tree.rows = spool(rows.select("vec_id", "label", "v").mapInArrow(settle, f"leaf long, vec_id long, label long, v {kind}"), "leaves")
    tree.sizes = {r["leaf"]: r["n"] for r in tree.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # leaves of the tree, and lengths
    ends = tree.rows.mapInArrow(_ranges(tree.nodes, dim), "node int, child int, point int, low double, high double")
    for r in ends.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # a fixed number for a tree
        node, j, i = tree.nodes[r["node"]], r["child"], r["point"]
        if i < 0:
            node.short[j], node.long[j] = r["low"], r["high"]
        else:
            node.near[i, j], node.far[i, j] = r["low"], r["high"]
    return tree


def _meet(tree: Tree, pairs: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, wid, vec_id, score: the k best rows of each block for pairs(leaf, query_id, label, v, windows)."""
    pairs = spool(pairs, "pairs")
    asked = {r["leaf"]: r["n"] for r in pairs.groupBy("leaf").agg(F.count("*").alias("n")).collect() if r["leaf"] in tree.sizes}
    spark = pairs.sparkSession
    deal = F.broadcast(spark.createDataFrame([(leaf, -(-tree.sizes[leaf] // BLOCK_ROWS), -(-n // LOT_ROWS)) for leaf, n in asked.items()], "leaf long, blocks int, lots int"))
    one = lambda by, parts: F.pmod(F.xxhash64(by), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rows = tree.rows.join(deal, "leaf").withColumn("block", one("vec_id", "blocks")).withColumn("lot", each("lots")).drop("blocks", "lots")
    wanted = pairs.join(deal, "leaf").withColumn("lot", one("query_id", "lots")).withColumn("block", each("blocks")).drop("blocks", "lots")
    by = ["leaf", "block", "lot"]
    found = rows.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(_best(k, same), "query_id long, wid long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id", "wid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def search(tree: Tree, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """query_id, wid, rank, vec_id, score: for asked(query_id, label, v, windows) the k best rows in each window, of the anchor's label or of others, the anchor's own vec_id out."""
    place = Tree(tree.nodes, tree.dim, None, {})
    kind = asked.schema["v"].dataType.simpleString()
    shape, names = f"leaf long, query_id long, label long, v {kind}, windows {WINDOWS}", ["leaf", "query_id", "label", "v", "windows"]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place.leaf(batch)), *batch.columns], names=names)

    def sent(to: np.ndarray, part: pa.RecordBatch, flat: tuple[np.ndarray, ...], which: np.ndarray) -> pa.RecordBatch:
        """The rows of part that have the windows `which`, with these alone; `to` has each row's leaf."""
        which = np.sort(which)
        rows, starts = np.unique(flat[0][which], return_index=True)
        inner = pa.StructArray.from_arrays([pa.array(x[which]) for x in flat[1:]], ["wid", "lo", "hi"])
        windows = pa.ListArray.from_arrays(pa.array([*starts, len(which)], pa.int32()), inner)
        kept = part.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(to[rows]), kept.column("query_id"), kept.column("label"), kept.column("v"), windows], names=names)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = place.leaf(batch)
            flat = _flat(batch)
            yield sent(leaf, batch, flat, np.flatnonzero(leaf[flat[0]] < 0))
            part = batch.take(pa.array(np.flatnonzero(leaf >= 0)))
            flat = _flat(part)
            for to, which in surviving(place.nodes, matrix(part.column("v")).astype(float), flat[0], *flat[2:]) if len(part) else ():
                yield sent(np.full(len(part), to), part, flat, which)

    slim = asked.select("query_id", "label", "v", "windows")
    first = _meet(tree, slim.mapInArrow(home, shape), k, same)
    floors = first.groupBy("query_id", "wid").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).where("floor IS NOT NULL")
    floors = floors.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("wid", "floor"))).alias("floors"))  # one for each window of an anchor
    raised = F.transform("windows", lambda w: F.struct(w["wid"].alias("wid"), F.greatest(w["lo"], F.coalesce(F.try_element_at("floors", w["wid"]), w["lo"])).alias("lo"), w["hi"].alias("hi")))
    narrowed = slim.join(floors, "query_id", "left").withColumn("windows", raised).drop("floors")
    return _meet(tree, narrowed.mapInArrow(through, shape), k, same)


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v of the rows that take part; v is of ints where all components fit."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), integers(F.col("embedding"), scale).alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    most = rows.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()[0] or 0
    return rows.withColumn("v", F.col("v").cast("array<int>")) if most < 2**31 else rows


def hard_negatives(vectors: DataFrame, label: Column | None = None, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors with vec_id % every = 0, against all rows of vectors(vec_id, label, embedding)."""
    tree = plant(usable(vectors, F.col("label") if label is None else label))
    anchors = tree.rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct(F.size("v"), "v", "label")).alias("s")).select(F.col("vec_id").alias("query_id"), "s.label", "s.v")
    anchors = spool(anchors, "anchors")
    window = lambda wid, lo, hi: F.struct(wid.cast("long").alias("wid"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    near = search(tree, anchors.withColumn("windows", F.array(window(F.lit(0), F.lit(-OPEN), F.lit(OPEN)))), positives, True)
    near = spool(near.select("query_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    score = F.col("positive_score")
    bands = near.where("positive_score >= 0").groupBy("query_id").agg(F.array_sort(F.collect_set(window(score, F.expr(f"(positive_score * {LOW} + 99) div 100"), F.expr(f"positive_score * {HIGH} div 100")))).alias("windows"))
    far = search(tree, spool(anchors.join(bands, "query_id"), "asked"), negatives, False)
    far = far.select("query_id", F.col("wid").alias("positive_score"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["query_id", "positive_score"]).select(F.col("query_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), moved)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_inner_product(a.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, r) AS k FROM s WHERE same) WHERE k <= 5)
SELECT * FROM (
  SELECT p.a AS anchor_id, p.r AS positive_id, row_number() OVER (PARTITION BY p.a, p.r ORDER BY n.score DESC, n.r)::INTEGER AS rank, n.r AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
) WHERE rank <= 3
"""
