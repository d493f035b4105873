"""Exact top-k search with vector-approximation files (operator 1).

Vectors become integers, floor(1024 * x), and the score is their inner product. The rows are dealt into blocks, which are written once:
every component is quantised to one of CELLS cells of a byte, cut at the block's own quantiles, beside the exact vector. The
cells' edges bound each score from above and below, by two matrix products.

A first scan reads the cells alone and gives each query the k greatest lower bounds of all rows; the least of them is a score that the
k-th best row reaches for certain. A second scan over the cells keeps the rows whose upper bound reaches it. Only their exact vectors are
then fetched, and read in the order of their upper bounds until the k-th best score can no longer be reached by what is left.

Queries and rows meet in groups of one block of rows and one lot of queries, both of bounded size; a
shuffle brings them together, and nothing is collected on the driver. Blocks are dealt by the hash of a row's number and vector, so
copies of one vector spread. The answer does not depend on the blocks.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows with null
vec_id. Vectors of different lengths are not compared. Ties go to the smaller vec_id. Rows that repeat a vec_id are
candidates each; as a query, a vec_id counts once, with its smallest vector. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import spool, table

K = 10
EVERY = 100
SCALE = 1024
CELLS = 64
#: Rows of a block: an N-th of all for small tables, at most MOST_ROWS for large ones.
LEAST_ROWS, MOST_ROWS, SPREAD = 1024, 65_536, 48
QUERY_ROWS = 16_384
#: Queries whose bounds are held at a time, components widened at a time, and rows read at a time in bound order.
QUERIES, WIDEN, READ = 64, 1 << 20, 32


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


APPROXIMATION = "dim int, block int, at int, vec_id long, v array<long>, cell binary, box binary"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(column), -1)


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each component, a byte, and the box: the least and the greatest value in each cell of each dimension."""
    edges = np.quantile(rows, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0, method="lower")
    cells = np.stack([np.searchsorted(edges[:, d], rows[:, d], side="right") for d in range(rows.shape[1])], axis=1).astype(np.uint8)
    box = np.stack([np.full((CELLS, rows.shape[1]), np.iinfo(np.int64).max), np.full((CELLS, rows.shape[1]), np.iinfo(np.int64).min)])
    for d in range(rows.shape[1]):
        np.minimum.at(box[0, :, d], cells[:, d], rows[:, d])
        np.maximum.at(box[1, :, d], cells[:, d], rows[:, d])
    return cells, box


def bounds(cells: np.ndarray, box: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A lower and an upper bound of each query's score with each row, from the cells; rows are widened a few at a time."""
    part = queries.astype(np.float64)
    plus, minus = np.maximum(part, 0), np.minimum(part, 0)
    below, above = np.empty((2, len(part), len(cells)))
    across, step = np.arange(cells.shape[1]), max(1, WIDEN // cells.shape[1])
    for first in range(0, len(cells), step):
        low, high = (box[side][cells[first : first + step], across].astype(np.float64) for side in (0, 1))
        above[:, first : first + step] = plus @ high.T + minus @ low.T
        below[:, first : first + step] = plus @ low.T + minus @ high.T
    seen = np.where(box[0] <= box[1], np.maximum(np.abs(box[0].astype(float)), np.abs(box[1].astype(float))), 0).max(axis=0)
    size = np.abs(part) @ seen  # sums below 2**53 are exact
    slack = np.where(size < 2.0**52, 0, size * 2.0**-50 * cells.shape[1])[:, None]
    return below - slack, above + slack


def _approximated(group: pa.Table) -> pa.Table:
    cells, box = quantised(_matrix(group.column("v")))
    first = [box.tobytes(), *[None] * (len(group) - 1)]
    return pa.table({
        "dim": group.column("dim"), "block": group.column("block"), "at": pa.array(np.arange(len(group)), pa.int32()), "vec_id": group.column("vec_id"), "v": group.column("v"),
        "cell": pa.array([c.tobytes() for c in cells], pa.binary()), "box": pa.array(first, pa.binary()),
    })


def _scan(rows: pa.Table, asked: pa.Table):
    """For some queries of a block and lot at a time: their positions, the rows' vec_id and place, and the bounds, with a query's own rows out of reach."""
    if not len(rows) or not len(asked):
        return
    ids, at = rows.column("vec_id").to_numpy(), rows.column("at").to_numpy()
    cells = np.frombuffer(b"".join(rows.column("cell").to_pylist()), np.uint8).reshape(len(rows), -1)
    box = np.frombuffer(next(x for x in rows.column("box").to_pylist() if x is not None), np.int64).reshape(2, CELLS, -1)
    queries, own = _matrix(asked.column("v")), asked.column("query_id").to_numpy()
    for first in range(0, len(queries), QUERIES):
        below, above = bounds(cells, box, queries[first : first + QUERIES])
        mine = own[first : first + QUERIES, None] == ids[None, :]
        below[mine] = above[mine] = -np.inf
        yield range(first, first + len(below)), own, at, below, above


def _floors(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        query, floor = [np.zeros(0, np.int64)], [np.zeros(0)]
        for part, own, _, below, _ in _scan(rows, asked):
            best = np.partition(below, max(0, below.shape[1] - k), axis=1)[:, -k:]
            real = np.isfinite(best)
            query.append(np.repeat(own[part.start : part.stop], best.shape[1])[real.ravel()])
            floor.append(best[real])
        return pa.table({"query_id": np.concatenate(query), "floor": np.concatenate(floor)})

    return run


def _passing(rows: pa.Table, asked: pa.Table) -> pa.Table:
    certain = asked.column("certain").to_numpy()
    query, place, upper = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
    for part, own, at, _, above in _scan(rows, asked):
        q, r = np.nonzero((above >= certain[part.start : part.stop, None]) & np.isfinite(above))
        query.append(own[part.start : part.stop][q])
        place.append(at[r])
        upper.append(above[q, r])
    n, one = sum(map(len, query)), lambda name: asked.column(name)[0].as_py() if len(asked) else 0
    keys = {name: pa.array(np.full(n, one(name)), pa.int32()) for name in ("dim", "block", "lot")}
    return pa.table(keys | {"query_id": np.concatenate(query), "at": np.concatenate(place), "upper": np.concatenate(upper)})


def read_in_order(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """ids and scores of the k best rows, ties to the smaller id, and how many rows were read: in the order of their upper bounds, READ at a time, until the k-th best is certain."""
    order = np.argsort(-upper, kind="stable")
    scores, at = np.zeros(0, np.int64), 0
    while at < len(order):
        scores = np.concatenate([scores, rows[order[at : at + READ]] @ query])
        at += READ
        if len(scores) >= k and at < len(order) and np.partition(scores, len(scores) - k)[len(scores) - k] > upper[order[at]]:
            break
    best = np.lexsort((ids[order[: len(scores)]], -scores))[:k]
    return ids[order[best]], scores[best], len(scores)


def _read(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(rows) and len(asked):
            place = rows.column("at").to_numpy()
            by = np.argsort(place)
            ids, exact, place = rows.column("vec_id").to_numpy()[by], _matrix(rows.column("v"))[by], place[by]
            asked = asked.sort_by([("query_id", "ascending"), ("at", "ascending")])
            query, at, upper = (asked.column(c).to_numpy() for c in ("query_id", "at", "upper"))
            starts = np.flatnonzero(at < 0)  # each query's own row, with its vector, comes before its candidates
            vectors = _matrix(asked.column("v").take(pa.array(starts)))
            for own, first, last, vector in zip(query[starts], starts + 1, [*starts[1:], len(query)], vectors, strict=True):
                near = np.searchsorted(place, at[first:last])
                found, scores, _ = read_in_order(vector, ids[near], exact[near], upper[first:last], k)
                out.append((np.full(len(found), own), found, scores))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the queries with vec_id % every = 0 against all rows of vectors(vec_id, embedding)."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    n = vectors.count()
    blocks = max(1, min(SPREAD, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS))
    lots = max(1, -(-n // (every * QUERY_ROWS)))
    dealt = usable.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    file = spool(dealt.groupBy("dim", "block").applyInArrow(_approximated, APPROXIMATION), "approximation")

    asked = file.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select(F.col("vec_id").alias("query_id"), "s.dim", "s.v")
    asked = spool(asked.withColumn("lot", F.pmod(F.xxhash64("query_id"), F.lit(lots)).cast("int")), "asked")
    by = ["dim", "block", "lot"]
    cells = file.select("dim", "block", "at", "vec_id", "cell", "box").withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    floors = cells.groupBy(*by).cogroup(asked.select("*", everywhere).groupBy(*by)).applyInArrow(_floors(k), "query_id long, floor double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("floor")))
    certain = floors.withColumn("place", place).where(F.col("place") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("floor")).alias("certain"))
    bound = asked.join(certain, "query_id", "left").withColumn("certain", F.coalesce("certain", F.lit(float("-inf"))))
    passing = cells.groupBy(*by).cogroup(bound.select("*", everywhere).groupBy(*by)).applyInArrow(_passing, "dim int, block int, lot int, query_id long, at int, upper double")
    passing = spool(passing, "passing")

    exact = file.select("dim", "block", "at", "vec_id", "v").join(passing.select(*by, "at").distinct(), ["dim", "block", "at"])
    exact = exact.select(*[F.col(c).alias(c) for c in exact.columns])  # columns of its own, as wanted comes from passing too
    heads = passing.select(*by, "query_id").distinct().join(asked.select("query_id", "v"), "query_id")
    wanted = passing.withColumn("v", F.lit(None).cast("array<long>")).unionByName(heads.select(*by, "query_id", F.lit(-1).alias("at"), F.lit(None).cast("double").alias("upper"), "v"))
    found = exact.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(_read(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
