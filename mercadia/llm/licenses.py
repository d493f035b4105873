"""License scans (operator 2).

One Aho-Corasick automaton finds notice phrases and identifier tags, and where they stand, in the words of a text. Behind each tag,
a shunting-yard parser reads the licence expression (AND, OR, WITH, parentheses) and evaluates it against a policy:
the set of identifiers that are allowed. OR needs one allowed side, AND both, WITH only its licence. Operands are identifiers of a table, which holds
the commoner part of the public list, LicenseRef names, and whatever else is a well-formed identifier and no plain word; WITH stands between a
licence and an exception. All of this takes linear time.

A text's words are runs of letters, digits and non-ASCII characters, in lower case for A-Z; everything else
separates. Phrases match whole words that follow one another, whatever separates them.

labels: those of the phrases found, and of each valid expression its identifiers in lower case, with
"-with-" and the exception where one is named. unlisted: those of them that the table doesn't hold, so may be no licences. score: the share of findings (phrases and expressions) that the policy
allows; 0 where nothing is found.

Defined results: a null text counts as empty: no words, no findings, null first_word and last_word, empty labels.
An expression
ends with its line or at the next tag, and before the first thing that can't go on a valid expression. A tag without a valid expression adds neither label nor finding. Repeated rows each come out. Texts are scanned
whole. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import byte_table, spread, table, word_spans

#: Phrase and label, as given: these count as places.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, which only add labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
#: The default policy: identifiers and labels that are allowed.
ALLOWED = frozenset("mit apache-2 apache-2.0 bsd bsd-2-clause bsd-3-clause isc cc0 cc0-1.0 unlicense zlib".split())

_LINE_END = re.compile(rb"[\r\n]|\Z")
_TOKEN = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9.+:-]*|\(|\))")
_RANK = {"or": 1, "and": 2, "with": 3}
_IS_WORD = byte_table(r"[0-9A-Za-z\x80-\xff]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


# Fixed values of the public licence list, in lower case: identifiers that stand for themselves, and the versions of families. The list is longer;
# what is well-formed but not here is an operand too, and told apart as unlisted.
IDENTIFIERS = frozenset(
    "0bsd aal adsl amdplpa aml antlr-pd apafml beerware blessing blueoak-1.0.0 bzip2-1.0.6 catosl-1.1 cc-pddc clartistic cpal-1.0 cpl-1.0 "
    "curl elastic-2.0 entessa fair fsfap fsful fsfullr ftl glide hpnd icu ijg imagemagick intel isc json latex2e libpng libpng-2.0 libtiff miros mit mit-0 "
    "mit-advertising mit-cmu mit-feh mit-modern-variant mit-open-group ms-pl ms-rl naist-2003 nbpl-1.0 ncsa net-snmp netcdf nokia noweb openssl postgresql psf-2.0 "
    "qpl-1.0 ruby sissl sissl-1.2 sleepycat snia spencer-86 sspl-1.0 tcl tcp-wrappers tu-berlin-2.0 unicode-dfs-2015 unicode-dfs-2016 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 xfree86-1.1 xnet zlib".split()
)
VERSIONS = {
    "afl": "1.1 1.2 2.0 2.1 3.0", "agpl": "1.0 1.0-only 1.0-or-later 3.0 3.0-only 3.0-or-later", "apache": "1.0 1.1 2.0", "apsl": "1.0 1.1 1.2 2.0", "artistic": "1.0 1.0-perl 1.0-cl8 2.0", "bittorrent": "1.0 1.1", "bsl": "1.0",
    "bsd": "1-clause 2-clause 2-clause-patent 2-clause-views 3-clause 3-clause-attribution 3-clause-clear 3-clause-lbnl 3-clause-modification 3-clause-no-nuclear-license 3-clause-open-mpi 4-clause 4-clause-shortened 4-clause-uc protection source-code",
    "busl": "1.1", "cc0": "1.0", "cddl": "1.0 1.1", "cdla-permissive": "1.0 2.0", "cdla-sharing": "1.0", "cecill": "1.0 1.1 2.0 2.1 b c", "cern-ohl": "1.1 1.2 p-2.0 s-2.0 w-2.0", "cua-opl": "1.0", "ecl": "1.0 2.0", "efl": "1.0 2.0",
    "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "gpl": "1.0 1.0-only 1.0-or-later 2.0 2.0-only 2.0-or-later 3.0 3.0-only 3.0-or-later", "hippocratic": "2.1", "lal": "1.2 1.3", "lgpl": "2.0 2.0-only 2.0-or-later 2.1 2.1-only 2.1-or-later 3.0 3.0-only 3.0-or-later",
    "lpl": "1.0 1.02", "lppl": "1.0 1.1 1.2 1.3a 1.3c", "mpl": "1.0 1.1 2.0 2.0-no-copyleft-exception", "mulanpsl": "1.0 2.0", "ncgl-uk": "2.0", "nosl": "1.0", "npl": "1.0 1.1", "nposl": "3.0", "oclc": "2.0", "odbl": "1.0", "odc-by": "1.0",
    "ofl": "1.0 1.0-rfn 1.0-no-rfn 1.1 1.1-rfn 1.1-no-rfn", "ogl-uk": "1.0 2.0 3.0", "oldap": "1.1 1.2 1.3 1.4 2.0 2.0.1 2.1 2.2 2.2.1 2.2.2 2.3 2.4 2.5 2.6 2.7 2.8", "osl": "1.0 1.1 2.0 2.1 3.0", "parity": "6.0.0 7.0.0", "pddl": "1.0", "php": "3.0 3.01",
    "polyform-noncommercial": "1.0.0", "polyform-small-business": "1.0.0", "python": "2.0 2.0.1", "rpl": "1.1 1.5", "rpsl": "1.0", "sgi-b": "1.0 1.1 2.0", "spl": "1.0", "ypl": "1.0 1.1", "zend": "2.0", "zimbra": "1.3 1.4", "zpl": "1.1 2.0 2.1",
}
#: Families with a version and a country or a choice between: cc-by-nc-sa-4.0, cc-by-3.0-de, gfdl-1.3-no-invariants-only.
COMBINED = re.compile(r"cc-by(?:-nc)?(?:-sa|-nd)?-(?:1|2|3|4)\.0(?:-[a-z]{2,3})?|cc-by(?:-nc)?(?:-sa|-nd)?-2\.5(?:-[a-z]{2})?|gfdl-1\.[123](?:-invariants|-no-invariants)?(?:-only|-or-later)?|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+")
LISTED = IDENTIFIERS | {f"{family}-{version}" for family, versions in VERSIONS.items() for version in versions.split()}
EXCEPTIONS = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.-]*|linux-syscall-note|(?:documentref-[a-z0-9.-]+:)?additionref-[a-z0-9.-]+")
_FORMED = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*\+?")
#: Well-formed, but said of what has no licence.
NO_LICENCE = frozenset(["none", "noassertion"])


def is_listed(name: str) -> bool:
    """Does the table hold this identifier, in lower case?"""
    return name.removesuffix("+") in LISTED or COMBINED.fullmatch(name) is not None


def is_licence(raw: str) -> bool:
    """A listed identifier, or a well-formed one as it is written that is no plain word: it has a digit and a letter, a hyphen, or capitals alone."""
    name = raw.lower()
    if is_listed(name):
        return True
    odd = any(c.isdigit() for c in name) and any(c.isalpha() for c in name) or "-" in name.strip("-") or len(name) > 1 and raw.isupper()
    return odd and name not in NO_LICENCE and _FORMED.fullmatch(raw) is not None and EXCEPTIONS.fullmatch(name) is None


def _valid(text: str) -> list[str]:
    """The tokens of the longest licence expression that the text starts with."""
    tokens: list[str] = []
    depth = at = best = 0
    while m := _TOKEN.match(text, at):
        raw, token = m[1], m[1].lower()
        last = tokens[-1] if tokens else "("
        if last == "with":
            token = token.rstrip(".:")
            good = EXCEPTIONS.fullmatch(token) is not None
        elif last in _RANK or last == "(":
            token = token if token in _RANK else token.rstrip(".:")
            good = token == "(" or token not in _RANK and is_licence(raw.rstrip(".:"))
        else:
            good = token in ("and", "or") or token == ")" and depth > 0 or token == "with" and last != ")" and (len(tokens) < 2 or tokens[-2] != "with")
        if not good:
            break
        tokens.append(token)
        depth += (token == "(") - (token == ")")
        at = m.end()
        if depth == 0 and token not in _RANK:
            best = len(tokens)
    return tokens[:best]


def postfix(text: str) -> list[str] | None:
    """The longest licence expression that the text starts with, in postfix order (shunting yard); None if there is none."""
    out: list[str] = []
    ops: list[str] = []
    for token in _valid(text):
        if token == "(":
            ops.append(token)
        elif token == ")":
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        elif token in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[token]:
                out.append(ops.pop())
            ops.append(token)
        else:
            out.append(token)
    return out + ops[::-1] or None


def evaluate(expression: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[set[str], bool]:
    """The labels of a postfix expression, and whether the policy allows it."""
    labels: set[str] = set()
    stack: list[tuple[str, bool]] = []  # the name, of an operand that is still only a name, and whether it is allowed
    for token in expression:
        if token not in _RANK:
            stack.append((token, token in allowed))
            continue
        (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((f"{a}-with-{b}", a_ok))
        else:
            labels.update(x for x in (a, b) if x)
            stack.append(("", a_ok or b_ok if token == "or" else a_ok and b_ok))
    name, good = stack[0]
    return labels | ({name} if name else set()), good


def unlisted(labels: set[str]) -> set[str]:
    """Of the labels of an expression those whose licence the table does not hold."""
    return {x for x in labels if not is_listed(x.split("-with-")[0])}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in NOTICES.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, False))
    for phrase, label in BASE_PHRASES.items():
        found.add_word(f" {phrase} ", (len(phrase) + 2, label, True))
    found.add_word(f" {TAG} ", (len(TAG) + 2, "", False))
    found.make_automaton()
    return found


def scan(text: str, find: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, unlisted."""
    raw = text.encode()
    words = raw.translate(_FOLD).split()
    plain = b" " + b" ".join(words) + b" "
    hits: list[int] = []  # where phrases that count as places begin
    tags: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    odd: set[str] = set()
    findings: list[bool] = []
    for end, (length, label, counts) in find.iter(plain.decode("latin-1")):
        if not label:
            tags.append(end + 1 - length)
            continue
        labels.add(label)
        findings.append(label in ALLOWED)
        if counts:
            base.add(label)
            hits.append(end + 1 - length)
    places: list[int] = []
    if hits or tags:
        blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 32)  # a blank stands before each word
        places = np.searchsorted(blanks, hits).tolist()
    if tags:
        starts, ends, _ = word_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _IS_WORD)
        first = np.searchsorted(blanks, tags)
        begins, behind = starts[first].tolist(), ends[first + TAG.count(" ")].tolist()
        line = -1
        for at, following in zip(behind, [*begins[1:], len(raw)], strict=True):
            if line < at:
                line = _LINE_END.search(raw, at).start()
            if expression := postfix(raw[at : min(line, following)].decode().lstrip(" \t").removeprefix(":")):
                named, good = evaluate(expression)
                labels |= named
                odd |= unlisted(named)
                findings.append(good)
    score = sum(findings) / len(findings) if findings else 0.0
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ",".join(sorted(odd))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "unlisted"]
    for batch in batches:
        rows = [scan(x.as_py() or "", find) for x in batch.column("text")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def scanned(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text), without a shuffle."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_scan_batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, unlisted string")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spread(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), joined AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS t, ' ' || array_to_string(w, '  ') || ' ' AS t2, w FROM words),
places AS (
  SELECT doc_id, label, i
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM joined WHERE t LIKE '% under the mit license %' OR t LIKE '% apache license version 2 %' OR t LIKE '% cc by nc %') p,
       (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) f(phrase, label)
  WHERE w[i + 1 : i + len(phrase)] = phrase
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id
), notices(phrase, label, base) AS (VALUES {notices}
), found AS (
  SELECT doc_id, label, (len(t2) - len(replace(t2, ' ' || replace(phrase, ' ', '  ') || ' ', ''))) // (len(replace(phrase, ' ', '  ')) + 2) AS n,
         label IN ({allowed}) AS good
  FROM joined, notices WHERE contains(t, ' ' || phrase || ' ')
), summed AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, sum(CASE WHEN good THEN n ELSE 0 END)::DOUBLE / sum(n) AS score FROM found GROUP BY doc_id
)
SELECT j.doc_id, j.n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score, '' AS unlisted
FROM joined j LEFT JOIN base b ON j.doc_id = b.doc_id LEFT JOIN summed s ON j.doc_id = s.doc_id
""".format(
    notices=", ".join(f"('{p}', '{x}', {k})" for k, given in ((0, NOTICES), (1, BASE_PHRASES)) for p, x in given.items()),
    allowed=", ".join(f"'{x}'" for x in sorted(ALLOWED)),
)
