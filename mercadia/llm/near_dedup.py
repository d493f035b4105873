"""MinHash near-dedup with SetSketch registers (operator 4).

A document's set holds its distinct 5-word shingles. Its sketch holds, for each of m registers, the
exponentially spaced, truncated minimum of an exponential variate over the set: merging two sketches is
the register-wise maximum, and equal registers become likelier with Jaccard similarity. Bands of registers
give the candidates; the two sketches and the known set sizes give a likelihood whose maximum estimates the
similarity; what passes is confirmed on the full sets. Only then are links turned into components.

Large groups: documents with equal sets become one class before any pair is made; a bucket first holds its
members against two pivots (its smallest and its largest member); only buckets whose members are then still in
several components are compared pair by pair, inside tasks, in blocks of bounded size: first on the sketches,
which leaves the members that have a likely partner in another component, then those on their full sets. Such
a task returns a spanning forest of the links it has found, never the pairs.

Defined results: a null or blank text has an empty set (n_shingles 0), links with nothing and is its own
component. Repeated rows have equal sets and so one component; each comes out. Rows that share a doc_id are
one node, which has the links of each. A null doc_id keeps null component and kept. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import broadcast_if, byte_table, hot_join, respool, slices, spool, spread, table, utf8_of, word_spans

SHINGLE = 5
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.1, 20.0, 254
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pairs whose estimate is this far below the threshold are not verified: five standard errors of 140 registers.
SLACK = 0.15
#: Members of a bucket that one task compares with one another come in blocks of about this many, or of about this many bytes of full sets.
BLOCK, BLOCK_BYTES = 1024, 64 << 20
CHUNK = 4 << 20
ID_BROADCAST = 1_000_000
#: Rows of one key that make a crowd; so many crowds' registers, or full sets, may be broadcast.
CROWD, CROWD_BROADCAST, CROWD_SETS = 4096, 100_000, 64

_IS_WORD = ~byte_table(r"[\x20\x09-\x0D]")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_weights() -> np.ndarray:
    at = np.arange(256, dtype=np.uint64)
    at[65:91] += np.uint64(32)  # A-Z count as a-z
    return _mixed((at + np.uint64(1)) * _GOLD)


_WEIGHTS = _byte_weights()
_STEP = 0x5851F42D4C957F2D
_BACK = pow(_STEP, -1, 1 << 64)
_PAD = np.uint64(0x2545F4914F6CDD1D)
_PLACES = [np.uint64(int(v) | 1) for v in _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _GOLD)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of the distinct shingles of each row, 64 bits each, chunk by chunk."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= len(data):
            self.up, self.down = _powers(_STEP, len(data) + 1), _powers(_BACK, len(data) + 1)
        starts, ends, first = word_spans(data, at, _IS_WORD)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_WEIGHTS[data] * self.up[: len(data)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)), first

    def rows(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """For each row its distinct shingle hashes in ascending order."""
        hashes, first = self.words(data, at)
        padded = np.concatenate([hashes, np.full(SHINGLE, _PAD)])
        n = len(hashes)
        whole = np.zeros(n, np.uint64)
        for j in range(SHINGLE):
            whole += padded[j : j + n] * _PLACES[j]
        whole = _mixed(whole)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                yield np.unique(whole[a : b - SHINGLE + 1])
            elif b > a:  # fewer words: the whole sequence as one shingle, filled up with a value no word has
                short = np.concatenate([hashes[a:b], np.full(SHINGLE - (b - a), _PAD)])
                yield _mixed((short * np.array(_PLACES)).sum(keepdims=True))
            else:
                yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set. Points of a Poisson process with marks: an element's next point falls on a random register; its first on each is exponential."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.inf)
    row = np.repeat(np.arange(len(sets)), sizes)
    state = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    at = np.zeros(len(state))
    while len(state):
        state = state + _GOLD
        drawn = _mixed(state)
        at = at - np.log(((drawn >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / (RATE * REGISTERS)
        register = (_mixed(drawn ^ _PAD) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(least.reshape(-1), row * REGISTERS + register, at)
        alive = np.unique(row)
        bound = np.zeros(len(sets))
        bound[alive] = least[alive].max(axis=1)
        keep = at < bound[row]
        state, at, row = state[keep], at[keep], row[keep]
    with np.errstate(divide="ignore"):
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isfinite(least), level, 0), 0, TOP).astype(np.uint8)


def _mass(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The similarity of greatest likelihood, on a grid, given the set sizes and how many registers of a are above and below b's."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    best, score = np.zeros(len(u)), np.full(len(u), -np.inf)
    for step in np.linspace(0, 1, 101):
        j = step * np.minimum(u / v, v / u)
        p, q = _mass(u - v * j), _mass(v - u * j)
        tiny = 1e-300
        like = above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + (REGISTERS - above - below) * np.log(np.maximum(1 - p - q, tiny))
        better = like > score
        best, score = np.where(better, j, best), np.where(better, like, score)
    return best


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        data, at = utf8_of(batch.column("text"))
        for a, b in slices(at, CHUNK):
            sets = list(shingler.rows(data[at[a] : at[b]], at[a : b + 1] - at[a]))
            regs = sketches(sets)
            with np.errstate(over="ignore"):
                one = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                two = [int(np.bitwise_xor.reduce(_mixed(s * _GOLD))) if len(s) else 0 for s in sets]
            signed = lambda xs: pa.array(np.array(xs, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), signed(one), signed(two), pa.array([r.tobytes() for r in regs], pa.binary())],
                names=["doc_id", "n_shingles", "print_a", "print_b", "registers"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        data, at = utf8_of(batch.column("text"))
        for a, b in slices(at, CHUNK):
            sets = [s.tobytes() for s in shingler.rows(data[at[a] : at[b]], at[a : b + 1] - at[a])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _reaches(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray, bound: float) -> np.ndarray:
    """Whether the similarity of greatest likelihood is at least `bound`: the log-likelihood is concave, so its slope there tells. The bound lies under both size ratios."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    c = (BASE - 1) / BASE
    x, y = u - v * bound, v - u * bound
    p, q = _mass(x), _mass(y)
    dp, dq = -v * c / ((1 - c * x) * np.log(BASE)), -u * c / ((1 - c * y) * np.log(BASE))
    return above * dp / p + below * dq / q - (REGISTERS - above - below) * (dp + dq) / (1 - p - q) >= 0


def _fits(left: np.ndarray, right: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which pairs can be links, by their sizes and the estimate."""
    fits = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    left, right = left[fits], right[fits]
    above, below = ((x.sum(axis=1, dtype=np.uint8)).astype(float) for x in (left > right, left < right))
    fits[fits] = _reaches(n_a[fits], n_b[fits], above, below, PERCENT / 100 - SLACK)
    return fits


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            n_a, n_b = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            fits = _fits(_registers(batch.column("registers_a")), _registers(batch.column("registers_b")), n_a, n_b)
            yield batch.select(["a", "b"]).filter(pa.array(fits))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column("shingles_a"), batch.column("shingles_b")
        fits = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(left, right, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))


def _flagged(group: pa.Table) -> pa.Table:
    """Of one block pair of a bucket, the members with a likely partner in another component. Pairs of two members already flagged need no look."""
    sizes = group.column("n_shingles").to_numpy().astype(float)
    comps = group.column("comp").to_numpy()
    keep = np.zeros(len(sizes), bool)
    if (comps != comps[0]).any():
        registers = _registers(group.column("registers"))
        for i in range(len(sizes) - 1):
            there = i + 1 + np.flatnonzero((comps[i + 1 :] != comps[i]) & ~(keep[i] & keep[i + 1 :]))
            if len(there):
                there = there[_fits(np.broadcast_to(registers[i], (len(there), REGISTERS)), registers[there], np.full(len(there), sizes[i]), sizes[there])]
            if len(there):
                keep[i] = True
                keep[there] = True
    return group.select(["key", "i", "j", "rep", "comp"]).filter(pa.array(keep))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: products of slices of the incidence matrix."""
    n = len(sets)
    shingles, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    common = np.zeros((n, n), np.float32)  # counts under 2**24 are exact
    width = max(256, (4 << 20) // n)
    for low in range(0, len(shingles), width):
        a, b = np.searchsorted(column, [low, low + width])
        has = np.zeros((n, min(width, len(shingles) - low)), np.float32)
        has[row[a:b], column[a:b] - low] = 1
        common += has @ has.T
    return common


def _forest(group: pa.Table) -> pa.Table:
    """Links that join the components of one block pair of a bucket: all its members of different components are compared on full sets, and a spanning forest of the links is returned."""
    reps, comps = (group.column(c).to_numpy() for c in ("rep", "comp"))
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    common = _common(sets)
    link = 100.0 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    out_a, out_b = [], []
    seen = {int(c): int(c) for c in comps}

    def root(c: int) -> int:
        while seen[c] != c:
            seen[c] = c = seen[seen[c]]
        return c

    for i, j in zip(*np.nonzero(np.triu(link & (comps[:, None] != comps[None, :]), 1)), strict=True):
        a, b = root(int(comps[i])), root(int(comps[j]))
        if a != b:
            seen[max(a, b)] = min(a, b)
            out_a.append(int(reps[i]))
            out_b.append(int(reps[j]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node that links (a, b) reach. Alternating large-star and small-star steps; each round is written to the shared folder, until nothing changes."""
    edges, path = respool(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", None)
    last = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        edges, path = respool(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges", path)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    roots = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp")
    return roots.union(roots.select(F.col("comp").alias("node"), "comp").distinct())


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents whose id is in ids(doc_id): their full sets, made from the text anew."""
    wanted = broadcast_if(ids, ids.count(), ID_BROADCAST)
    return spool(docs.join(wanted, "doc_id", "left_semi").mapInArrow(_set_batches, "rep long, shingles binary"), "sets")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = spool(docs.mapInArrow(_sketch_batches, "doc_id long, n_shingles long, print_a long, print_b long, registers binary"), "sketches")

    # classes of equal sets
    prints = ["n_shingles", "print_a", "print_b"]
    grouped = sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*prints)
    classes = spool(grouped.agg(F.min(F.struct("doc_id", "registers")).alias("r"), F.count("*").alias("copies")).select(*prints, F.col("r.doc_id").alias("rep"), F.col("r.registers").alias("registers"), "copies"), "classes")

    # buckets of classes that agree in a band
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    members = classes.select("rep", F.explode(bands).alias("key"), "n_shingles")
    buckets = members.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("size"), (8 * F.sum("n_shingles")).alias("bytes")).where("low < high")
    buckets = spool(buckets, "buckets")
    crowded = spool(hot_join(members.drop("n_shingles"), buckets, ["key"], buckets.where(F.col("size") > CROWD).select("key"), CROWD_BROADCAST), "crowded")

    # members against the pivots
    pairs = crowded.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.a", "p.b").where("a < b").distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
    pairs = spool(pairs, "pairs")
    crowds = {x: spool(pairs.groupBy(x).count().where(F.col("count") > CROWD).select(x), "crowds") for x in ("a", "b")}
    sided = hot_join(hot_join(pairs, side("a"), ["a"], crowds["a"], CROWD_BROADCAST), side("b"), ["b"], crowds["b"], CROWD_BROADCAST)
    likely = spool(sided.select("a", "b", "n_a", "n_b", "registers_a", "registers_b").mapInArrow(_likely, "a long, b long"), "likely")
    ids = spool(likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct(), "ids")
    sets = _sets_of(docs, ids)
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"shingles_{x}"))
    whole = hot_join(hot_join(likely, of("a"), ["a"], crowds["a"], CROWD_SETS), of("b"), ["b"], crowds["b"], CROWD_SETS)
    links = spool(whole.select("a", "b", "shingles_a", "shingles_b").mapInArrow(_confirmed, "a long, b long"), "links")

    # doc_ids that rows with different sets share: one node, linked with the class of each
    prints_of = F.struct(*prints)
    several = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.min(prints_of).alias("p0"), F.max(prints_of).alias("p1")).where("p0 < p1")
    shared = spool(several.select("doc_id"), "shared")
    shared = broadcast_if(shared, shared.count(), ID_BROADCAST)
    own = sketched.join(shared, "doc_id", "left_semi").join(classes.drop("registers", "copies"), prints).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    links = spool(links.union(own.distinct()), "all-links")
    first = spool(components(links), "first")

    # buckets that still hold several components
    placed = spool(crowded.join(first, crowded["rep"] == first["node"], "left").select("key", "size", "bytes", "rep", F.coalesce("comp", "rep").alias("comp")), "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = placed.join(mixed, "key").withColumn("mine", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "rep", "comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    sketch = classes.select("rep", "n_shingles", "registers")
    flagged = dealt.join(sketch, "rep").select("key", "i", "j", "rep", "comp", "n_shingles", "registers").groupBy("key", "i", "j").applyInArrow(_flagged, "key long, i int, j int, rep long, comp long")
    flagged = spool(flagged, "flagged")
    late = flagged.select(F.col("rep").alias("doc_id")).distinct().join(ids, "doc_id", "left_anti")
    sets = sets.union(_sets_of(docs, spool(late, "late")))
    more = spool(flagged.join(sets, "rep").select("key", "i", "j", "rep", "comp", "shingles").groupBy("key", "i", "j").applyInArrow(_forest, "a long, b long"), "more")

    final = spool(components(links.union(more)), "final")
    named = classes.join(final, classes["rep"] == final["node"], "left").select(*prints, F.coalesce("comp", "rep").alias("comp"))
    placed = shared.join(final, shared["doc_id"] == final["node"]).select(F.col("doc_id").alias("_shared"), F.col("comp").alias("_comp"))
    slim = sketched.drop("registers").where("n_shingles > 0 and doc_id is not null")
    joined = hot_join(slim, named, prints, classes.where(F.col("copies") > CROWD).select(prints), CROWD_BROADCAST).select(*slim.columns, "comp")
    joined = joined.unionByName(sketched.where("n_shingles = 0 or doc_id is null").select(*slim.columns, F.lit(None).cast("long").alias("comp")))
    joined = joined.join(broadcast_if(placed, placed.count(), ID_BROADCAST), joined["doc_id"] == F.col("_shared"), "left")  # a shared doc_id's empty rows too
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "comp", "doc_id"))
    return joined.select("doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id") == found).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
