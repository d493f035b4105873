"""Operators 11 to 13 against SQL, brute force and odd inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mercadia.llm import exact_dedup, hard_negatives, merkle

NAN, INF = float("nan"), float("inf")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, row long, n long, tree string, hash string"


def rows(frame):
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 9)
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize(("run", "sql"), [(merkle.op11_merkle, merkle.ORACLE), (exact_dedup.op12_exact_dedup, exact_dedup.ORACLE), (hard_negatives.op13_hard_negatives, hard_negatives.ORACLE)])
def test_against_sql(spark, small, run, sql):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    assert rows(run(spark, small).toPandas()) == rows(con.sql(sql).df())


def frame(spark, records):
    """documents(doc_id, source, lang, n_chars, text) with further columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in records], SCHEMA).repartition(3)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(record):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in record))


def up(nodes, way, at):
    """The levels of a tree; the siblings of node `at` go to way."""
    while len(nodes) > 1:
        first = at // 8 * 8
        way.append((at - first, [n for k, n in enumerate(nodes[first : first + 8]) if k != at - first]))
        nodes, at = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], at // 8
    return nodes[0]


def brute_manifest(records):
    langs = sorted({r[2] for r in records}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in records if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    subroots = [up([leaf(r) for r in t], [], 0) for t in trees]
    out = []
    for q, tree in enumerate(trees):
        for p, r in enumerate(tree):
            way = []
            up([leaf(x) for x in tree], way, p)
            root = up(subroots, way, q)
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                now = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for at, others in way:
                now = sha(*others[:at], now, *others[at:])
            out.append((r[0], leaf(r), subroots[q], root, sha(*(x for _, o in way for x in o)), now, now == root))
    return sorted(map(repr, out))


RECORDS = [(k, f"s{k % 3}", "en", k % 7, f"Text {k} É" * (k % 4)) for k in range(150)]
RECORDS += [(200, None, None, None, None), (201, "s", None, 1, "ABC"), (202, "s", "de", 1, "A"), (203, "s", "", 1, ""), (204, "s", "é", 1, "x" * 300_000)]
RECORDS += [(None, "s", "en", 1, "null id"), (None, "s", "en", 1, "Another"), (7, "s", "en", 1, "same id"), (8, "r", "en", 1, "Copy"), (8, "r", "en", 1, "Copy")]
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("block", [8, 64, merkle.BLOCK])
def test_manifest(spark, block):
    changed = [merkle.plain_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.COLUMNS]
    docs = frame(spark, RECORDS)
    got = merkle.manifest(docs, F.when(merkle.tampered(), merkle.leaf_hash(changed)), block).select(*COLUMNS).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_manifest(RECORDS)


def test_manifest_of_little(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    one = merkle.manifest(frame(spark, RECORDS[:1])).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == sha() and one["verified"]


def test_a_changed_sibling_is_found_out():
    nodes = [sha(str(k)) for k in range(70)]
    levels = merkle.levels(nodes, 70, 512)
    way = merkle.way_up(levels, 69)
    assert merkle.fold(nodes[69], way) == levels[-1][0] != merkle.fold(sha("other"), way)
    assert [len(x) for x in levels] == [70, 9, 2, 1] and [len(o) for _, o in way] == [5, 0, 1]


# Exact dedup


def brute_groups(records):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for doc, text in records:
        groups.setdefault(norm(text), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for text, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


TEXTS = [(1, "a b"), (2, "ab"), (3, " a\tb\r\n"), (3, " a\tb\r\n"), (4, None), (5, ""), (6, " \n"), (None, "c  d"), (8, "c d"), (9, "A b"), (10, "a b"), (11, "é"), (12, "é"), (13, "é "), (None, "q"), (None, "q"), (15, "x" * 400_000), (14, "x " * 400_000), (16, "c\x0bd")]


@pytest.mark.parametrize("digest", [exact_dedup.md5_bits, lambda n: F.md5(F.substring(n, 1, 1).cast("binary")), lambda n: F.lit("one")])
def test_exact_groups(spark, digest, monkeypatch):
    docs = frame(spark, [(i, "s", "l", 1, t) for i, t in TEXTS])
    show = lambda df: sorted(repr(tuple(r)) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert show(exact_dedup.exact_groups(docs, digest=digest)) == brute_groups(TEXTS)
    for limit, crowd in ((1, 2), (0, 100)):  # crowds by broadcast and the rest by shuffle; everything by shuffle
        monkeypatch.setattr(exact_dedup, "KEYS_BROADCAST", limit)
        monkeypatch.setattr(exact_dedup, "CROWD", crowd)
        assert show(exact_dedup.exact_groups(docs, digest=digest)) == brute_groups(TEXTS)


def test_deduplicated(spark):
    docs = frame(spark, [(i, "s", "l", 1, t) for i, t in TEXTS])
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    kept = [x.split(",")[0][1:] for x in brute_groups(TEXTS) if ", True, " in x]
    assert sorted(repr(r["doc_id"]) for r in got.collect()) == sorted(kept)
    assert exact_dedup.deduplicated(docs.limit(0)).count() == 0 == exact_dedup.exact_groups(docs.limit(0)).count()


def test_no_python_in_exact_dedup(spark, small):
    plan = exact_dedup.op12_exact_dedup(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Hard negatives


def brute_negatives(vectors, every=50):
    usable = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in vectors if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for a in {i for i, _, _ in usable if i % every == 0}:
        _, own, label = min((len(v), v, y) for i, y, v in usable if i == a)
        scored = sorted((-sum(p * q for p, q in zip(own, v, strict=True)), i, y) for i, y, v in usable if i != a and len(v) == len(own))
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out |= {(a, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(fits[:3])}
    return out


def test_hard_negatives(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 6))
    vectors = [(i, int(draw.integers(4)), (centres[i % 12] + draw.normal(size=6) * 0.4).astype(np.float32).tolist()) for i in range(1500)]
    vectors += [(3000 + i, i % 2, [0.5, -0.5, 0.25, 0.0, 1.0, -1.0]) for i in range(400)]  # copies of one vector, anchors among them
    vectors += [(5000 + i, i % 2, [float(i % 5), 1.0]) for i in range(60)]  # another length
    vectors += [(6000, 1, None), (6001, 1, []), (6050, 1, [NAN] * 6), (6003, 1, [INF, 0.0, 0.0, 0.0, 0.0, 0.0]), (6004, 1, [None, 0.0, 0.0, 0.0, 0.0, 0.0]), (None, 1, [1.0] * 6), (6006, None, [1.0] * 6), (6100, 3, [0.0] * 6)]
    docs = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, y, v in vectors], "vec_id long, embedding array<float>, label int, leaf string, block int, v int").repartition(3)
    plain = [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in vectors]
    expect = brute_negatives(plain)
    for block, lot in ((hard_negatives.BLOCK_ROWS, hard_negatives.LOT_ROWS), (100, 7)):
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
        monkeypatch.setattr(hard_negatives, "LOT_ROWS", lot)
        got = hard_negatives.hard_negatives(docs).collect()
        assert {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got} == expect and len(got) == len(expect) > 100
    assert hard_negatives.hard_negatives(docs.limit(0)).count() == 0


def test_the_tree_eliminates_and_loses_nothing():
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 16)) * 200
    data = np.floor(centres[draw.integers(40, size=4000)] + draw.normal(size=(4000, 16)) * 12)
    nodes = hard_negatives.grow(data[:800], 2)
    leaf_ = hard_negatives.leaves_of(nodes, data)
    for at, j, which, away in hard_negatives.descend(nodes, data):
        if len(which):
            size = (data[which] ** 2).sum(axis=1)
            nodes[at].short[j], nodes[at].long[j] = size.min(), size.max()
            nodes[at].near[:, j], nodes[at].far[:, j] = away.min(axis=0), away.max(axis=0)
    anchors = data[:100]
    scores = anchors @ data.T
    best = np.sort(scores, axis=1)[:, -6]
    for low, high in ((best, np.full(100, hard_negatives.OPEN)), (best * 0.5, best * 0.95)):
        met = np.zeros((100, leaf_.max() + 1), bool)
        for to, which in hard_negatives.surviving(nodes, anchors, np.arange(100), low, high):
            met[which, to] = True
        q, r = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]))
        assert met[q, leaf_[r]].all() and len(q) > 500
    met = [len(w) for _, w in hard_negatives.surviving(nodes, anchors, np.arange(100), best, np.full(100, hard_negatives.OPEN))]
    assert sum(met) < 0.2 * 100 * (leaf_.max() + 1)  # the nearest rows are in few leaves


# Joins that spread crowds


def test_hot_join(spark):
    from mercadia.llm.common import hot_join

    many = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    few = spark.createDataFrame([(k, f"v{k}") for k in range(45)], "k long, v string")
    hot = spark.createDataFrame([(0,), (7,)], "k long")
    plain = sorted(map(tuple, many.join(few, ["k"]).select("k", "id", "v").collect()))
    for limit in (2, 1, 0):
        assert sorted(map(tuple, hot_join(many, few, ["k"], hot, limit).select("k", "id", "v").collect())) == plain
    assert sorted(map(tuple, hot_join(many, few, ["k"], hot.limit(0), 5).select("k", "id", "v").collect())) == plain


def test_the_mix_takes_the_same_text_however_rows_come(spark):
    from mercadia.llm.mixing import mixed

    rows_ = [(k % 7, "s" if k % 4 else "t", f"{'w ' * (3 + k % 5)}{k // 7}") for k in range(140)]
    seen = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows_[::parts] + [r for k, r in enumerate(rows_) if k % parts], "doc_id long, source string, text string").repartition(parts).withColumn("_row", F.monotonically_increasing_id())
        taken = docs.join(mixed(docs, ("_row",)).select("_row", "copies"), "_row")
        seen.add(tuple(sorted((r["doc_id"], r["text"], r["copies"]) for r in taken.collect())))
    assert len(seen) == 1
