"""BPE encoding and decoding (operator 5).

A byte-level BPE vocabulary is turned into three tables: an Aho-Corasick automaton over the tokens, which finds
the longest token at every place of a piece in one pass; the longest proper prefix of each token that is a token;
and the pairs of tokens that may stand side by side, worked out on first use from the merge table. The encoder
goes left to right, takes the longest token, checks it against the token before it, and goes back where the pair
cannot have come from the merges. The result is that of the merges, in linear time. Decoding copies bytes out of
one buffer by an offset table.

Pieces repeat, so each worker keeps the ids of up to PIECES of them, none longer than KEPT characters. The vocabulary file is read on the driver,
from a path that is a parameter, and broadcast: its size doesn't depend on the data.

Defined results: a null text counts as empty: no tokens, the digests of an empty string. Special tokens of the
vocabulary that stand in a text become their own ids. Repeated rows each come out. Texts are encoded whole.
Other columns of the input are ignored by `encoded`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import spread, table

#: The split of byte-level vocabularies of this kind; \s is Unicode white space. The commonest alternative comes first: no two begin alike.
PIECE = regex.compile(r""" ?\p{L}+| ?\p{N}+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of ASCII alone, in the standard library's faster engine, whose own \s differs.
ASCII_PIECE = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PIECES, KEPT = 1 << 18, 256
_END = 1 << 40


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself where printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for one vocabulary file's text (JSON with model.vocab, model.merges and added_tokens)."""

    def __init__(self, spec: str) -> None:
        spec = json.loads(spec)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.to_letters = {b: c for b, c in enumerate(letters)}
        names = list(letters)  # a token's number here is its place in the order of merges
        number = {c: b for b, c in enumerate(letters)}
        self.split = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for pair in merges:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair = number[left], number[right]
            if left + right not in number:
                number[left + right] = len(names)
                names.append(left + right)
                self.split.append(pair)
            self.joined.setdefault(pair, number[left + right])
        self.length = [len(x) for x in names]
        self.fits: dict[tuple[int, int], bool] = {}
        real = [k < 256 or self._stable(k) for k in range(len(names))]
        self.find = ahocorasick.Automaton()
        for k, name in enumerate(names):
            if real[k]:
                self.find.add_word(name, k)
        self.find.make_automaton()
        self.shorter = [next((number[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in number and real[number[x[:n]]]), -1) for x in names]
        self.id = [vocab[x] for x in names]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {x: self._packed([i]) for x, i in added.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        back = {c: b for b, c in enumerate(letters)}
        by_id = {i: bytes(back[c] for c in x) for x, i in vocab.items()} | {i: x.encode() for x, i in added.items()}
        whole = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.bytes = np.frombuffer(b"".join(whole), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)
        self.known: dict[str, tuple[bytes, str]] = {}

    def _beside(self, a: int, b: int, limit: int = _END) -> bool:
        """Can a and b stand side by side? Undo the later merge of the two, again and again: no pair at the border may merge earlier than what was undone."""
        while True:
            merged = self.joined.get((a, b), _END)
            if merged < limit:
                return False
            if a > b or b < 256:
                if a < 256:
                    return True
                limit, a = a, self.split[a][1]
            else:
                limit, b = b + 1, self.split[b][0]

    def _stable(self, k: int) -> bool:
        """Do the merges, on this token's bytes alone, end in this token?"""
        return self._beside(*self.split[k], k)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return np.array(ids, np.int32).tobytes(), ",".join(map(str, ids))

    def piece(self, text: str) -> list[int]:
        """Token numbers of one piece, given in the vocabulary's letters."""
        n = len(text)
        longest = [-1] * (n + 1)
        length = self.length
        for end, k in self.find.iter(text):
            longest[end + 1 - length[k]] = k  # ends come in ascending order, so the last is the longest
        if longest[0] >= 0 and length[longest[0]] == n:
            return [longest[0]]
        out: list[int] = []
        dead = bytearray(n + 1)
        at, k = 0, longest[0]
        while at < n or k >= 0:
            last = out[-1] if out else -1
            while k >= 0:
                if not dead[at + length[k]]:
                    if last < 0:
                        break
                    good = self.fits.get((last, k))
                    if good is None:
                        good = self._beside(last, k)
                        if len(self.fits) < 4 * PIECES:
                            self.fits[last, k] = good
                    if good:
                        break
                k = self.shorter[k]
            if k >= 0:
                out.append(k)
                at += length[k]
                k = longest[at] if at < n else -1
            else:
                dead[at] = 1
                k = out.pop()
                at -= length[k]
        return out

    def _ids(self, piece: str) -> tuple[bytes, str]:
        letters = piece.encode().decode("latin-1").translate(self.to_letters)
        return self._packed([self.id[k] for k in self.piece(letters)])

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > PIECES:
            self.known.clear()
        for p in pieces:
            if len(p) <= KEPT and p not in self.known:
                self.known[p] = self._ids(p)

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids, and the same in decimals joined by commas."""
        if self.cut is None or not self.cut.search(text):
            found = self._plain(text)
        else:
            found, at = [], 0
            for m in self.cut.finditer(text):
                found += self._plain(text[at : m.start()])
                found.append(self.special[m[0]])
                at = m.end()
            found += self._plain(text[at:])
        return np.frombuffer(b"".join([x[0] for x in found]), np.int32), ",".join([x[1] for x in found])

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        pieces = (ASCII_PIECE if text.isascii() else PIECE).findall(text)
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            self._learn(set(pieces))
            return [known.get(p) or self._ids(p) for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        first = self.offset[ids]
        sizes = self.offset[ids.astype(np.int64) + 1] - first
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)
        return self.bytes[at].tobytes().decode("utf-8", errors="replace")


_ready: dict[int, Bpe] = {}


def _bpe(spec) -> Bpe:
    """One table set for each worker and vocabulary."""
    key = hash(spec.value)
    if key not in _ready:
        _ready[key] = Bpe(spec.value)
    return _ready[key]


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's text, sent once to each executor."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, ids (array of int), ids_sha256, decoded_sha256, and with `texts` the decoded text, for each row of docs(doc_id, text)."""
    spec = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(spec)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, hashes, decoded_texts, back = [], [], [], []
                for text in part.column("text"):
                    found, decimals = bpe.encode(text.as_py() or "")
                    decoded = bpe.decode(found)
                    ids.append(found)
                    hashes.append(hashlib.sha256(decimals.encode()).hexdigest())
                    if texts:
                        decoded_texts.append(decoded)
                    back.append(hashlib.sha256(decoded.encode()).hexdigest())
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                arrays = [part.column("doc_id"), lists, pa.array(hashes, pa.string()), pa.array(back, pa.string())] + [pa.array(decoded_texts, pa.string())] * texts
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "ids_sha256", "decoded_sha256", "decoded"][: len(arrays)])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>, ids_sha256 string, decoded_sha256 string" + ", decoded string" * texts)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = encoded(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256")
