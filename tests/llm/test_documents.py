"""The operators on documents against brute force, on the smallest tables and on a table of odd cases."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mercadia.llm import bpe, licenses, lm_score, mixing, near_dedup, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
ODD = [
    (1, None, None), (2, "", "b"), (3, " \n\t ", "b"), (4, "one two", "b"), (5, "ONE  two", "a"), (6, LONG, "b"), (7, LONG + " tail", "c"),
    (8, "a b c d e f g", None), (8, "a b c d e f g", None), (9, "a b c d e f g", ""), (None, "a b c d e f g", "a"), (10, "x" * 50_000, "a"),
    (11, "été <|endoftext|> ñ\x1c 漢字 😀\n\n", "a"), (12, "Under the MIT-License. SPDX-License-Identifier: (MIT OR GPL-3.0) AND Apache-2.0 WITH LLVM-exception", "d"),
    (13, "l\nl\nl\n m \nm", "d"), (14, "apache license, version 2.0 apache license version 20 CC BY-NC under the mit license", "d"),
]
SCHEMA = "doc_id long, text string, source string"
CLASH = "n_words kept shard slot size key rep comp word c score rank taken copies ids target doc".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns named like those that operators add."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def collected(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def shingles(text):
    w = WORD.findall(text.translate(FOLD))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


def check_near(df):
    expect = brute_components([(i, t) for i, t in pairs_of(df) if i is not None])
    got = collected(near_dedup.near_duplicates(df))
    assert len(got) == df.count()
    for r in got:
        assert r["component_id"] == expect.get(r["doc_id"]) and r["kept"] == (None if r["doc_id"] is None else r["doc_id"] == r["component_id"])
    return got


def test_near_dedup(docs):
    got = check_near(docs)
    by = dict(pairs_of(docs))
    assert all(r["n_shingles"] == len(shingles(by[r["doc_id"]])) for r in got)


def test_near_dedup_variants(spark):
    """A crowd of near copies whose links form chains, beside exact copies."""
    base = [f"t{k}" for k in range(120)]
    rows = [(k, " ".join(base[: 120 - k] + [f"u{j}" for j in range(k)])) for k in range(40)] + [(100 + k, " ".join(base)) for k in range(50)]
    rows += [(200 + k, " ".join([f"v{k}"] + base[1:])) for k in range(30)]
    check_near(spark.createDataFrame(rows, "doc_id long, text string"))


def test_near_dedup_odd(odd, empty):
    check_near(odd)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_shared_ids(spark):
    """Rows that share a doc_id join the groups of their texts, also where one is empty."""
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(5, x), (3, x), (5, y), (7, y), (8, z), (1, z), (8, ""), (6, z + " more"), (6, ""), (9, ""), (9, None), (9, "solo")]
    got = check_near(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got} == {5: 3, 3: 3, 7: 3, 8: 1, 1: 1, 6: 1, 9: 9}


def test_sketch_estimates():
    draw = np.random.default_rng(3)
    for j in (0.5, 0.7, 0.85, 0.95):
        seen = []
        for _ in range(40):
            n = 400
            common = round(2 * n * j / (1 + j))
            a = draw.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64)
            x, y = near_dedup.sketches([a[:n], a[n - common :]])
            seen.append(near_dedup.estimate(np.array([n]), np.array([n]), np.array([(x > y).sum()]), np.array([(x < y).sum()]))[0])
        assert abs(np.mean(seen) - j) < 0.03
    n_a, n_b = draw.uniform(90, 100, (2, 3000))
    above, below = draw.integers(0, 50, (2, 3000)).astype(float)
    exact, reaches = near_dedup.estimate(n_a, n_b, above, below), near_dedup._reaches(n_a, n_b, above, below, 0.7)
    assert (reaches == (exact >= 0.7))[abs(exact - 0.7) > 0.011].all()
    a = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    whole, left, right = near_dedup.sketches([a, a[:300], a[200:]])
    assert (np.maximum(left, right) == whole).all()  # sketches merge by the greater register


@pytest.mark.parametrize("size", [20, 200, 2000])
def test_candidates_near_the_bound(size):
    """Pairs of two sets of one size, at the least similarity that links and a little above: how many the bands and the likelihood let through. The README has the figures."""
    draw, seen = np.random.default_rng(size), []
    for aim in (0.85, 0.87, 0.90):
        common = next(c for c in range(size + 1) if c >= aim * (2 * size - c))
        for _ in range(60):
            both = draw.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64)
            a, b = near_dedup.sketches([np.unique(both[:size]), np.unique(both[size - common :])])
            meets = (a == b).reshape(near_dedup.BANDS, near_dedup.ROWS).all(axis=1).any()
            seen.append(bool(meets and near_dedup._fits(a[None], b[None], np.array([float(size)]), np.array([float(size)]))[0]))
    assert np.mean(seen) >= 0.99


def base_of(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark, small, docs):
    got = {r["doc_id"]: r for r in quality_rules.op3_quality_rules(spark, small).collect()}
    for i, t in pairs_of(docs):
        assert tuple(got[i][c] for c in quality_rules.BASE_NAMES) == base_of(t)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    plain = [i for i, t in pairs_of(docs) if not base_of(t)[5] and base_of(t)[2] < 0.2 * base_of(t)[0]]
    assert sum(got[i]["kept"] for i in plain) == len(plain)


def spark_hash(*parts):
    """Spark's xxhash64 of texts and longs: each one's seed is the hash of those before it."""
    h = 42
    for x in parts:
        h = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else (x % (1 << 64)).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def brute_quality(rows, labels):
    """(doc_id, text) -> (score, kept), from plain counts; labels: (doc_id, quality, toxic)."""
    worst = {}
    for i, q, t in labels:
        if i is not None:
            worst[i] = (min(q, worst.get(i, (9, 0))[0]), max(t, worst.get(i, (0, 0))[1]))
    good, bad = {i for i, x in worst.items() if x == (1, 0)}, {i for i, x in worst.items() if x[0] == 0}
    fits = {i for i in good if spark_hash(i, "half") % 2 == 0}

    def grams(text):
        h = [spark_hash(w) for w in WORD.findall(text)]
        return [x % quality_rules.BUCKETS for x in h + [spark_hash(a, b) for a, b in itertools.pairwise(h)]]

    raw, fit = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in fits:
            fit.update(grams(t))
    n, k, size = sum(raw.values()), sum(fit.values()), quality_rules.BUCKETS
    ratio = {b: math.log((fit[b] + 1) / (k + size)) - math.log((raw[b] + 1) / (n + size)) if k else 0.0 for b in raw}
    score = {(i, t): sum(ratio[b] for b in grams(t)) / max(1, len(grams(t))) for i, t in rows}
    known = {}
    for i, t in rows:
        if i in (good - fits) | bad:
            s, f = known.get(i, (math.inf, False))
            known[i] = min(s, score[i, t]), f or base_of(t)[5]
    bar = quality_rules.bar_of(*(np.array([known[i][0] for i in ids & known.keys() if not known[i][1]]) for ids in (good - fits, bad)))
    return {x: (s, not base_of(x[1])[5] and s >= bar) for x, s in score.items()}


def test_quality_against_brute_force(spark, docs, odd, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality", "toxic")
    some = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (7, 1, 0), (10, 1, 0), (None, 1, 0), (14, 1, 0), (13, 0, 0)], labels.schema)
    for df, given in ((docs, labels), (odd, some)):
        expect = brute_quality(pairs_of(df), [tuple(r) for r in given.collect()])
        got = quality_rules.judged(df, given)
        assert got.where("kept").count() == sum(expect[x][1] for x in pairs_of(df))  # a filter on the verdicts ends
        for r in got.collect():
            score, kept = expect[r["doc_id"], r["text"] or ""]
            assert math.isclose(r["score"], score, abs_tol=1e-9) and r["kept"] == kept


def test_quality_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (7, 1, 0), (None, 1, 0)], none.schema)
    for labels in (none, some):
        got = quality_rules.judged(odd, labels).collect()
        assert Counter((r["doc_id"], tuple(r[c] for c in quality_rules.BASE_NAMES)) for r in got) == Counter((i, base_of(t)) for i, t in pairs_of(odd))
        assert {r["doc_id"] for r in got if r["kept"]} == {6, 7}
    assert quality_rules.judged(empty, some).count() == 0


def test_quality_rejects_what_labels_call_bad(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    got = [r for r in quality_rules.op3_quality_rules(spark, folder).join(labels, "doc_id").collect() if not r["base_failed"]]
    bad, good = ([r["kept"] for r in got if (r["q"], r["t"] * r["q"]) == x] for x in ((0, 0), (1, 0)))
    assert len(bad) == 27 and sum(bad) <= 4 and len(good) > 250 and sum(good) >= 0.99 * len(good)


def test_quality_bar():
    draw = np.random.default_rng(2)
    good, bad = draw.normal(0.5, 0.1, 1000), draw.normal(-0.5, 0.1, 300)
    assert bad.max() < quality_rules.bar_of(good, bad) < good.min()
    assert (good < quality_rules.bar_of(good, good[:1])).sum() <= 1  # one wrong label moves little
    none = np.zeros(0)
    bars = [quality_rules.bar_of(good[:n], none) for n in (1, 5, 19, 20, 1000)]
    assert quality_rules.bar_of(none, bad) == float("-inf") and all(math.isfinite(x) for x in bars) and bars[0] < bars[1] < bars[2] < bars[4]
    assert abs(bars[2] - bars[3]) < 0.2  # no step at 20


def test_quality_bar_over_tables(spark):
    draw = np.random.default_rng(3)
    some = lambda mean, n: np.round(draw.normal(mean, 0.3, n), 2)  # noqa: E731  equal scores among them
    for good, bad in ((some(0.5, 400), some(-0.5, 90)), (some(0.1, 31), some(0.0, 30)), (some(0, 1), some(0, 0)), (some(0, 2), some(3, 2)), (some(1, 40), some(0, 0)), (some(0, 0), some(0, 3)), (some(0, 0), some(0, 0))):
        seen = spark.createDataFrame([(float(x), y) for xs, y in ((good, True), (bad, False)) for x in xs], "score double, _good boolean").repartition(3)
        assert math.isclose(quality_rules.bar_over(seen), quality_rules.bar_of(good, bad), rel_tol=1e-12, abs_tol=1e-12)


def test_quality_takes_every_label(spark, monkeypatch):
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert quality_rules.trusted_ids(labels).count() == 30_000
    assert quality_rules.bad_ids(labels.withColumn("quality", F.lit(0))).count() == 30_000
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.concat(F.lit("w"), F.col("id") % 7), 60), F.col("id").cast("string")).alias("text"))
    given = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3 > 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    verdicts = lambda: sorted(map(tuple, quality_rules.judged(rows, given).drop("text").collect()))
    near = verdicts()
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)  # ids beyond the bound are shuffled
    assert verdicts() == near


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe(docs, odd, empty, tokenizer):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for df in (docs, odd):
        texts = pairs_of(df)
        expect = Counter()
        for i, t in texts:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            back = tokenizer.decode(ids, skip_special_tokens=False)
            expect[i, tuple(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back] += 1
        got = bpe.encoded(df, path, texts=True).collect()
        assert Counter((r["doc_id"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"], r["decoded"]) for r in got) == expect
    assert bpe.encoded(empty, path).count() == 0


def test_bpe_random_strings(tokenizer):
    import random

    draw = random.Random(9)
    own = bpe.Bpe(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    letters = "aAbB zZ  \n\t'sté漢\x1c\x85​😀019²½—…\x7f́ingtheroan"
    plain = [*map(chr, range(128)), *"  'stdremvl  "]
    for k in range(8000):
        t = "".join(draw.choice(letters if k % 2 else plain) for _ in range(draw.randrange(40)))
        assert own.encode(t)[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", "CECILL-B CECILL-C CDLA-Permissive-2.0 OLDAP-2.8 Python-2.0.1 GFDL-1.3-no-invariants-only CERN-OHL-S-2.0 PolyForm-Noncommercial-1.0.0 MIT-open-group Parity-7.0.0 Hippocratic-2.1 BitTorrent-1.1 NPOSL-3.0 SISSL GPL-2.0-or-later CC-BY-NC-SA-4.0 BSD-3-Clause".split())
def test_listed_identifiers(name):
    for text in (f"SPDX-License-Identifier: {name}", f"# SPDX-License-Identifier: ({name} OR Zlib) AND MIT\nprose"):
        found = licenses.scan(text, licenses.automaton())
        assert name.lower() in found[5].split(",") and found[7] == ""


@pytest.mark.parametrize(("text", "labels", "unlisted"), [("LTSL-9", "ltsl-9", "ltsl-9"), ("Apache-7.7 OR MIT", "apache-7.7,mit", "apache-7.7"), ("Zend-9 WITH Foo-exception", "zend-9-with-foo-exception", "zend-9-with-foo-exception"), ("TCG", "tcg", "tcg"), ("NONE", "", ""), ("NOASSERTION", "", ""), ("see the file", "", ""), ("2024", "", ""), ("MIT AND later", "mit", "")])
def test_unlisted_identifiers(text, labels, unlisted):
    found = licenses.scan(f"SPDX-License-Identifier: {text}", licenses.automaton())
    assert (found[5], found[7]) == (labels, unlisted)


def test_licenses_odd(odd, empty):
    got = {r["doc_id"]: r for r in licenses.scanned(odd).collect()}
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["base_labels"], got[1]["score"]) == (0, None, "", 0.0)
    assert (got[12]["n_base"], got[12]["first_word"], got[12]["base_labels"]) == (1, 0, "mit")
    assert got[12]["labels"] == "apache-2.0-with-llvm-exception,gpl-3.0,mit"
    assert (got[14]["n_base"], got[14]["first_word"], got[14]["last_word"], got[14]["base_labels"]) == (3, 0, 12, "apache-2,cc-by-nc,mit")
    assert licenses.scanned(odd).count() == len(ODD) and licenses.scanned(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "postfix", "labels", "good"),
    [
        ("MIT", ["mit"], {"mit"}, True),
        ("MIT OR GPL-2.0 AND EPL-2.0", ["mit", "gpl-2.0", "epl-2.0", "and", "or"], {"mit", "gpl-2.0", "epl-2.0"}, True),
        ("(MIT OR GPL-2.0) AND LicenseRef-x.", ["mit", "gpl-2.0", "or", "licenseref-x", "and"], {"mit", "gpl-2.0", "licenseref-x"}, False),
        ("Apache-2.0 WITH LLVM-exception */", ["apache-2.0", "llvm-exception", "with"], {"apache-2.0-with-llvm-exception"}, True),
        ("MIT OR", ["mit"], {"mit"}, True),
        ("MIT ) x", ["mit"], {"mit"}, True),
    ],
)
def test_expressions(text, postfix, labels, good):
    assert licenses.postfix(text) == postfix and licenses.evaluate(postfix) == (labels, good)


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT ... SPDX-License-Identifier: GPL-2.0", "gpl-2.0,mit", 0.5),
        ("SPDX-License-Identifier: MIT AND spdx license identifier ISC\nSPDX-License-Identifier:\nZlib", "isc,mit", 1.0),
        ("SPDX-License-Identifier: MIT xSPDX-License-Identifier: A SPDX-License-Identifiers: B", "mit", 1.0),
        ("SPDX-License-Identifier: " * 3 + "MIT", "mit", 1.0),
        ("x SPDX-License-Identifier: MIT " * 20_000, "mit", 1.0),
    ],
)
def test_tags_of_one_line(text, labels, score):
    assert licenses.scan(text, licenses.automaton())[5:7] == (labels, score)


def test_many_places_and_terms_take_linear_time():
    import time

    find, began = licenses.automaton(), time.perf_counter()
    n, found, first, last, *_ = licenses.scan("cc by nc " * 200_000, find)
    assert (n, found, first, last) == (600_000, 200_000, 0, 599_997)
    long = "SPDX-License-Identifier: " + " OR ".join(f"LicenseRef-{k}" for k in range(100_000)) + " AND MIT"
    assert len(licenses.scan(long, find)[5].split(",")) == 100_001
    assert licenses.scan("SPDX-License-Identifier: " + "(" * 50_000 + "MIT" + ")" * 50_000, find)[5] == "mit"
    assert time.perf_counter() - began < 20


def random_expression(draw, depth=0):
    """An expression, its labels and whether it is allowed, built from the leaves up and so never parsed."""
    if depth > 3 or draw.random() < 0.35:
        name = draw.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "EPL-2.0", "LicenseRef-Own", "BSD-3-Clause", "AGPL-3.0+"])
        if draw.random() < 0.2:
            return f"{name} WITH Classpath-exception-2.0", {f"{name.lower()}-with-classpath-exception-2.0"}, name.lower() in licenses.ALLOWED, 3
        return name, {name.lower()}, name.lower() in licenses.ALLOWED, 3
    a, b = random_expression(draw, depth + 1), random_expression(draw, depth + 1)
    op, rank = draw.choice([("AND", 2), ("or", 1)])
    shown = [f"({x[0]})" if x[3] < rank or draw.random() < 0.2 else x[0] for x in (a, b)]
    return f"{shown[0]} {op} {shown[1]}", a[1] | b[1], a[2] and b[2] if op == "AND" else a[2] or b[2], rank


def test_tags_against_brute_force(spark):
    import random

    draw = random.Random(12)
    rows, expect = [], {}
    for k in range(400):
        parts, labels, found = [], set(), []
        for _ in range(draw.randrange(4)):
            text, names, good, _ = random_expression(draw)
            tag, end = draw.choice(["SPDX-License-Identifier:", "// spdx-license-identifier :", "é SPDX License\nIdentifier"]), draw.choice(["\n", "\r\n", " */\n", " ) trailing words\n", " this file is free "])
            parts.append(f"words before {tag} {text}{end}")
            labels |= names
            found.append(good)
        if draw.random() < 0.3:
            parts.append("SPDX-License-Identifier: this file is free")
        rows.append((k, "".join(parts)))
        expect[k] = ",".join(sorted(labels)), sum(found) / len(found) if found else 0.0
    got = licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got} == expect


@pytest.mark.parametrize("text", ["", "AND MIT", "(", "( MIT", "this file", "MITx", "Classpath-exception-2.0"])
def test_bad_expressions(text):
    assert licenses.postfix(text) is None


def check_mix(df):
    got = mixing.mixed(df).collect()
    sizes = Counter()
    for r in df.select("doc_id", "text", "source").collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8")) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, active, target = 1.5 * sum(sizes.values()), set(order), {}
    while active:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        active -= over
    return got, sizes, target


def test_mixing(docs):
    got, sizes, target = check_mix(docs)
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], target[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 20 for s in sizes)
    again = mixing.mixed(docs.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}


def test_mixing_odd(odd, empty):
    got, sizes, target = check_mix(odd)
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted({round(t, 6) for t in target.values()}) == sorted({round(r["target"], 6) for r in got})
    assert mixing.mixed(empty).count() == 0


def check_shards(df, n):
    out = sharding.sharded(df, n).collect()
    assert len(out) == df.count()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(k, [])) for k in range(n)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return out


def test_sharding(spark, small, docs):
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in check_shards(docs, 40)}
    assert first == {r["doc_id"]: (r["shard"], r["slot"]) for r in check_shards(docs.repartition(5), 40)}
    rows = sharding.op9_sharding(spark, small).collect()
    by = dict(pairs_of(docs))
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == first
    assert all(r["size"] == len(by[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(by[r["doc_id"]].encode()) for r in rows)


def test_sharding_files(spark, docs, tmp_path):
    """A task's rows lie in shards that follow each other, in slot order; where nothing is small enough to broadcast, the texts are shuffled once."""
    sharding.write_shards(docs, f"file://{tmp_path}/out", 6)
    files = [(int(f.name.split("-")[1]), int(f.parent.name.removeprefix("shard="))) for f in (tmp_path / "out").glob("shard=*/*.parquet")]
    tasks = sorted({t for t, _ in files})
    assert len(files) <= len(tasks) + 6 - 1 and {s for _, s in files} == set(range(6))
    assert sorted(files) == sorted(files, key=lambda f: (f[1], f[0]))
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = pq.ParquetFile(f).read(columns=["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = sharding.sharded(docs, 6)
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert sum("Exchange" in line for line in plan.splitlines()) == 2  # the texts, and the orders of the buckets
        assert Counter(r["shard"] for r in placed.collect()) == Counter(s for f in (tmp_path / "out").glob("shard=*/*.parquet") for s in [int(f.parent.name[6:])] * pq.ParquetFile(f).metadata.num_rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_sharding_odd(odd, empty):
    out = check_shards(odd, 3)
    assert Counter((r["doc_id"], r["text"], r["n_words"]) for r in out) == Counter((r[0], r[1], 1) for r in ODD)
    assert check_shards(empty, 4) == []


def check_lm(df):
    rows = [(i, [*WORD.findall(t.translate(FOLD)), "\n"], zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2) for i, t in pairs_of(df)]
    c = Counter(x for _, w, h in rows if not h for x in w)
    n, v = sum(c.values()), len(c)
    expect = Counter((i, h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w, h in rows)
    got = lm_score.scored(df).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expect
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_lm(docs):
    got = check_lm(docs)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better than the counts on texts it has not seen


def test_lm_repeats(spark, docs, monkeypatch):
    """The same scores whatever the partitions, with many lots and a tree of averages; and they are those of the fitted model, token by token."""
    monkeypatch.setattr(lm_score, "LOT", 1 << 10)
    monkeypatch.setattr(lm_score, "FAN", 4)
    got = {r["doc_id"]: r["score"] for r in lm_score.scored(docs).collect()}
    again = {r["doc_id"]: r["score"] for r in lm_score.scored(docs.repartition(7)).collect()}
    assert got.keys() == again.keys() and all(math.isclose(got[i], again[i], rel_tol=1e-9) for i in got)
    _, _, _, p = lm_score.learned(lm_score.marked(docs))
    c = Counter(w for i, t in pairs_of(docs) if zlib.crc32(str(i).encode()) % 7 != 2 for w in WORD.findall(t.translate(FOLD)))
    own = {w: 1 + k for k, (w, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: lm_score.WORDS])}
    tail = {}
    for w, n in c.items():
        if w not in own:
            tail.setdefault(lm_score.tail_class(w), []).append(n)
    by = dict(pairs_of(docs))
    for i in sorted(by)[:12]:
        total, a, b = 0.0, 0, 0
        for w in [*WORD.findall(by[i].translate(FOLD)), None]:
            k = 0 if w is None else own.get(w) or lm_score.tail_class(w)
            context = p["words"][b] @ p["place_1"] + p["words"][a] @ p["place_2"]
            logits = p["classes"] @ context + p["bias"]
            total += (logits[k] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / math.log(10)
            if w is not None and w not in own:
                total += math.log10((c[w] + 1) / (sum(tail.get(k, [])) + len(tail.get(k, [])) + 1))
            a, b = b, k
        assert math.isclose(got[i], total, rel_tol=1e-4)


def test_lm_commonest(spark):
    draw = Counter({f"w{k}": 1 + (k * k) % 50 for k in range(300)})
    rows = [(w, n, (7 * n) % 31) for w, n in draw.items()]
    expect = sorted(sorted(rows, key=lambda r: (-r[1] - r[2], r[0]))[:40], key=lambda r: (-r[1], r[0]))
    assert lm_score.commonest(spark.createDataFrame(rows, "word string, c long, held long"), 40) == [r[:2] for r in expect]


def test_lm_odd(odd, empty):
    check_lm(odd)
    assert lm_score.scored(empty).count() == 0


def test_lm_is_normalised():
    draw = np.random.default_rng(1)
    params = {k: draw.normal(0, 1, s) for k, s in lm_score._SHAPES.items()}
    near, far, norm = lm_score.normalised(params)
    for i, j in ((0, 0), (5, 900), (1200, 3)):
        assert abs((10.0 ** (near[i] + far[j] - norm[i, j]).astype(float)).sum() - 1) < 1e-3


def brute_copies(df):
    """Checks the mix that a frame of (source, size, copies) rows stands for: rates from the dual, solved here by bisection, then copies size by size."""
    sizes, docs_of = Counter(), {}
    for source, size, _ in df:
        sizes[source] += size
        docs_of.setdefault(source, Counter())[size] += 1
    order = sorted((x for x in sizes if x is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(order)}
    low, high = 0.0, 2.0 * sum(sizes.values()) + 1
    for _ in range(200):  # the water level
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[x], level * weight[x]) for x in order) < 1.5 * sum(sizes.values()) else (low, level)
    for x in order:
        target, docs_x = min(2 * sizes[x], low * weight[x]), docs_of[x]
        total = sum(docs_x.values())
        unit = sizes[x] / total if total else 0
        words = lambda m: sum(n * z * min(2.0, math.exp(min(700.0, m * z / unit))) for z, n in docs_x.items())  # noqa: B023, E731
        a, b = -60.0, 60.0
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if sizes[x] and words(m) < target else (a, m)
        owed = 0.0
        for z in sorted(docs_x, reverse=True):
            rate = 2.0 if target >= 2 * sizes[x] * (1 - 1e-12) else min(2.0, math.exp(a * z / unit)) if z else 0.0
            asked = docs_x[z] * rate * z + owed
            k = min(max(round(asked / z), 0), 2 * docs_x[z]) if z else 0
            owed = asked - k * z
            got = sum(c for s, size, c in df if s == x and size == z)
            assert abs(got - k) <= 1e-6 * k + 1, (x, z, got, k)  # a rate at the edge of a copy may round either way
            assert max(c for s, size, c in df if s == x and size == z) - min(c for s, size, c in df if s == x and size == z) <= 1


def test_mixing_rates(docs, odd):
    for df in (docs, odd):
        frame = df.withColumn("row", F.monotonically_increasing_id())
        source = {r["row"]: r["source"] for r in frame.collect()}
        brute_copies([(source[r["row"]], r["size"], r["copies"]) for r in mixing.mixed(frame, ("row",)).collect()])


def check_stages(spark, folder, docs, tokenizer):
    """Each stage against brute force on what the one before it left; none of the operators serves as its own measure."""
    key = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    columns = docs.columns
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows = docs.collect()
    verdict = brute_quality(pairs_of(docs), labels)
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == columns and Counter(kept.collect()) == Counter(r for r in rows if verdict[r["doc_id"], r["text"] or ""][1])

    unique = corpus_pipeline.near_dedup(spark, kept, folder)
    rows = sorted(kept.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    groups = brute_components([(k, r["text"] or "") for k, r in enumerate(rows) if r["doc_id"] is not None])
    first = [r for k, r in enumerate(rows) if groups.get(k, k) == k]
    got = unique.collect()
    assert unique.columns == columns and Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in first) and not Counter(got) - Counter(rows)

    mix = corpus_pipeline.mix(spark, unique, folder)
    copies = key(mix.collect())
    assert mix.columns == columns and set(mix.collect()) <= set(got)
    parts, size = key(got), lambda t: len(WORD.findall(t or ""))
    shared = []  # rows that share doc_id and text come out together: deal their copies evenly
    for r in {(r["doc_id"], r["text"]): r for r in got}.values():
        n, c = parts[r["doc_id"], r["text"]], copies[r["doc_id"], r["text"]]
        assert c <= 2 * n
        shared += [(r["source"], size(r["text"]), c // n + (k < c % n)) for k in range(n)]
    brute_copies(shared)
    out = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.tokens(spark, mix, folder).collect())
    expect = Counter()
    for (i, t), n in copies.items():
        expect[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids)] += n
    assert out == expect
    return out


def test_pipeline(spark, small, docs, tokenizer):
    out = check_stages(spark, small, docs, tokenizer)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, small).collect()) == out


def test_pipeline_odd(spark, odd, empty, tokenizer, tmp_path):
    """Null, shared and repeated doc_ids, repeated rows, columns with the stages' own names, and empty tables: no row is lost or multiplied."""
    labels = spark.createDataFrame([(6, 1, 0), (10, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    text = lambda k: " ".join(f"{k}q{j}" for j in range(80))
    more = [(None, text(1), "a"), (None, text(1), "a"), (20, text(2), None), (20, text(2), None), (20, text(3), "b"), (21, text(3), "b"), (22, text(4), "c"), (6, text(4), "c"), (23, text(5), "")]
    rows = odd.select("doc_id", "text", "source").union(spark.createDataFrame(more, SCHEMA)).withColumns({c: F.lit(c) for c in [*CLASH, "_all", "_row", "_comp", "_copies", "_words", "_hashes", "_good", "base_failed"]}).cache()
    check_stages(spark, str(tmp_path), rows, tokenizer)
    near = corpus_pipeline.near_dedup(spark, rows, "").collect()
    assert sum(r["doc_id"] is None for r in near) == 3 and all(r["_row"] == "_row" for r in near)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_dedup, corpus_pipeline.mix, corpus_pipeline.tokens):
        assert stage(spark, empty, str(tmp_path)).count() == 0
