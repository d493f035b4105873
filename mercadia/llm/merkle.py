"""A Merkle manifest of a dataset with a proof for each row (operator 11).

Each row is a leaf: the hash of its columns, each with its length before it. The leaves of a language, in order of doc_id, make a tree whose runs of FAN
neighbours become a node, and the languages' subroots make the tree above. Leaves get their positions by a range shuffle that is written
once: a leaf's position is its place in its file plus the leaves of the same tree in earlier files.

A tree is cut into superblocks of BLOCK leaves, whole subtrees. Each is reduced in one group to a node of the tree of superblocks, which is cut
likewise, until one superblock is left; so no task holds more than BLOCK nodes, whatever a tree's size. Back downwards, the leaves of a superblock
and what they need from outside it (the siblings on the way from the superblock's node to the root, the subroot and the root) are
cogrouped, and one function finishes it: it reduces the superblock again, joins inner and outer siblings to each leaf's proof and folds the
leaf as it is found now up to the root.

Tampering is a function of the row: `manifest` hashes each row as it was and as it is found, and the fold tells whether the
manifest's root still comes out.

Defined results: null columns are hashed as `-`. Rows with a null doc_id come first in their language, ordered by their leaves, as do repeated doc_ids;
whole repeated rows are leaves each. Null language is a tree of its own, before all others. Texts are hashed whole.
An empty table gives no rows. Columns of the input beside COLUMNS are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.llm.common import broadcast_if, spool, table

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 8
#: Nodes of a superblock, a power of FAN.
BLOCK = FAN**4
#: Rows of (file, tree) counts, and of languages, that are broadcast at most.
COUNTS_BROADCAST = 200_000
#: A way up: on each level the node's place in its run, and its siblings, left to right.
WAY = "array<struct<at:int,others:array<string>>>"


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 of the columns as texts, each with its length in bytes and a colon before it; null is `-`."""
    texts = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def plain_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(every: int = 3) -> Column:
    """The rows that are tampered with: `every` divides the checksum of their doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes(tree, ...) with pos, their place in their tree by `order`, and total, the tree's size. A range shuffle, then sizes of (file, tree)."""
    ranged = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_row").sortWithinPartitions("tree", *order, "_row")
    ranged = spool(ranged.drop("_row").withColumns({"_file": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranged")
    counted = ranged.groupBy("_file", "tree").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("tree").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    sizes = counted.groupBy("tree").agg(F.sum("_n").alias("total"))
    offsets = spool(counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(sizes, "tree").drop("_n"), "offsets")
    placed = ranged.join(broadcast_if(offsets, offsets.count(), COUNTS_BROADCAST), ["_file", "tree"])
    return placed.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_file", "_at", "_first", "_before")


def h(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def levels(nodes: list[str], total: int, block: int = BLOCK) -> list[list[str]]:
    """The levels of one superblock of at most `block` nodes, from its nodes up to its single node. A tree of one superblock ends at its root, a larger one goes up by the superblock's whole height."""
    found, height = [nodes], 1
    while height < block and (total > block or len(found[-1]) > 1):
        last = found[-1]
        found.append([h(last[k : k + FAN]) for k in range(0, len(last), FAN)])
        height *= FAN
    return found


def way_up(found: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """The way of the node `at` of the lowest level to the top."""
    way = []
    for level in found[:-1]:
        first = at - at % FAN
        way.append((at % FAN, level[first:at] + level[at + 1 : first + FAN]))
        at //= FAN
    return way


def fold(digest: str, way: list[tuple[int, list[str]]]) -> str:
    for at, others in way:
        digest = h([*others[:at], digest, *others[at:]])
    return digest


_WAY = pa.list_(pa.struct([("at", pa.int32()), ("others", pa.list_(pa.string()))]))


def _superblock(group: pa.Table, digest: str, block: int) -> tuple[pa.Table, list[list[str]]]:
    """A superblock's nodes in order, and its levels."""
    group = group.sort_by("pos")
    return group, levels(group.column(digest).to_pylist(), group.column("total")[0].as_py(), block)


def _outer(group: pa.Table) -> list[tuple[int, list[str]]]:
    return [(x["at"], x["others"]) for x in group.column("way")[0].as_py()]


def reduced(nodes: DataFrame, block: int = BLOCK, digest: str = "digest") -> DataFrame:
    """tree, pos, digest, total of the superblocks of nodes(tree, pos, digest, total)."""

    def run(group: pa.Table) -> pa.Table:
        group, found = _superblock(group, digest, block)
        total = -(-group.column("total")[0].as_py() // block)
        return pa.table({"tree": group.column("tree").slice(0, 1), "pos": group.column("block").slice(0, 1), "digest": found[-1], "total": pa.array([total], pa.int64())})

    return nodes.withColumn("block", F.expr(f"pos div {block}")).groupBy("tree", "block").applyInArrow(run, "tree string, pos long, digest string, total long")


def ways(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """tree, pos, way, top for nodes(tree, pos, digest, total): each node's way to its tree's root, and the root. One round for each factor `block` of the largest tree."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    if most <= 1:
        return nodes.select("tree", "pos", F.array().cast(WAY).alias("way"), F.col("digest").alias("top"))
    blocks = spool(reduced(nodes, block), "superblocks")
    outer = ways(blocks, block).withColumnRenamed("pos", "block")

    def run(inner: pa.Table, outer: pa.Table) -> pa.Table:
        inner, found = _superblock(inner, "digest", block)
        beyond = _outer(outer)
        found_ways = [[{"at": at, "others": others} for at, others in way_up(found, k) + beyond] for k in range(len(inner))]
        return pa.table({"tree": inner.column("tree"), "pos": inner.column("pos"), "way": pa.array(found_ways, _WAY), "top": pa.array(outer.column("top").to_pylist() * len(inner), pa.string())})

    inner = nodes.withColumn("block", F.expr(f"pos div {block}"))
    return inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInArrow(run, f"tree string, pos long, way {WAY}, top string")


def finished(leaves: DataFrame, outer: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of leaves(tree, pos, total, doc_id, leaf, found): each superblock with its outer(tree, block, way, subroot, top), reduced, joined and folded in one go."""

    def run(inner: pa.Table, outer: pa.Table) -> pa.Table:
        inner, levels_ = _superblock(inner, "leaf", block)
        digests, beyond = levels_[0], _outer(outer)
        proofs, folds = [], []
        for k, now in enumerate(inner.column("found").to_pylist()):
            way = way_up(levels_, k) + beyond
            proofs.append(h([x for _, others in way for x in others]))
            folds.append(fold(digests[k] if now is None else now, way))
        same = lambda name: pa.array(outer.column(name).to_pylist() * len(inner), pa.string())
        return pa.table({"doc_id": inner.column("doc_id"), "leaf": digests, "subroot": same("subroot"), "root": same("top"), "proof_sha256": proofs, "folded_root": folds})

    kind = leaves.schema["doc_id"].dataType.simpleString()
    inner = leaves.withColumn("block", F.expr(f"pos div {block}"))
    return inner.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInArrow(run, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, found: Column | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs. found: the leaf as it is found now, null where nothing changed."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree")
    now = F.lit(None).cast("string") if found is None else found
    hashed = spool(docs.select("doc_id", tree, leaf_hash([F.col(c) for c in COLUMNS]).alias("leaf"), now.alias("found")), "hashed")  # before the range shuffle, which reads its input twice
    leaves = spool(numbered(hashed, ["doc_id", "leaf"]), "leaves")
    within = spool(ways(spool(reduced(leaves, block, "leaf"), "superblocks"), block).withColumnRenamed("pos", "block"), "ways")

    subroots = within.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"))
    subroots = spool(numbered(subroots, ["of"]), "subroots")
    above = ways(subroots, block).select("pos", F.col("way").alias("above"), "top")
    above = spool(above.join(subroots.select("pos", F.col("of").alias("tree"), F.col("digest").alias("subroot")), "pos").drop("pos"), "above")
    outer = within.select("tree", "block", "way").join(broadcast_if(above, above.count(), COUNTS_BROADCAST), "tree").select("tree", "block", F.concat("way", "above").alias("way"), "subroot", "top")
    done = finished(leaves, outer, block)
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    changed = [plain_lower(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    return manifest(docs, F.when(tampered(), leaf_hash(changed)))


def _oracle(height: int = 8) -> str:
    """DuckDB SQL of op11_merkle, for trees of up to FAN ** height leaves: the levels one by one, then each row's way up."""
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(v) || ':' || v, '-')".replace("v", text if c == "text" else f"{c}::VARCHAR") for c in COLUMNS) + ")"  # noqa: E731, F541
    bits = f"list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ord(substr(doc_id::VARCHAR, k, 1)), {', '.join(['-1'] * 8)}]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d AS (SELECT *, {hashed('text')} AS leaf, CASE WHEN xor({bits}, 4294967295) % 3 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS now FROM documents)",
        "e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM d)",
        "a0 AS (SELECT lang AS tree, p AS pos, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM e)",
        *_levels("a", height),
        f"s AS (SELECT tree, d, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS p FROM a{height})",
        "b0 AS (SELECT 0 AS tree, p AS pos, d, count(*) OVER () AS n FROM s)",
        *_levels("b", height),
        "f0 AS (SELECT e.doc_id, e.leaf, e.now, e.p, s.p AS q, e.lang, s.d AS subroot, '' AS proof FROM e JOIN s ON e.lang IS NOT DISTINCT FROM s.tree)",
    ]
    for k in range(2 * height):
        name, level, at, tree = ("a", k, "p", "f.lang") if k < height else ("b", k - height, "q", "0")
        node = f"x.tree IS NOT DISTINCT FROM {tree} AND x.pos = f.{at} // {FAN**level}"
        parts.append(f"f{k + 1} AS (SELECT f.* REPLACE (f.proof || x.l || x.r AS proof, CASE WHEN x.n > 1 THEN sha256(x.l || f.now || x.r) ELSE f.now END AS now) FROM f{k} f JOIN {name}w{level} x ON {node})")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT d FROM b{height}) AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT d FROM b{height}) AS verified FROM f{2 * height}"


def _levels(name: str, height: int) -> list[str]:
    """SQL of the levels above {name}0, and of each level with what stands left and right of a node in its run."""
    parts = []
    for k in range(height):
        run = f"PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
        parts.append(f"{name}w{k} AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        parts.append(f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d, (any_value(n) + {FAN - 1}) // {FAN} AS n FROM {name}{k} GROUP BY tree, pos // {FAN})")
    return parts


ORACLE = _oracle()
