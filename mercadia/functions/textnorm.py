"""Normalised text and tokens: for a query in Python, for data as Column expressions. Both follow the same rule.

lower case, accents off, tokens are runs of a-z and 0-9. Null counts as empty.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia.lexicon import DEFAULT, Lexicon

TOKEN = "[a-z0-9]+"


def normalize(text: str | None) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c) != "Mn")


def tokens(text: str | None) -> list[str]:
    return re.findall(TOKEN, normalize(text))


def content_tokens(text: str | None, lexicon: Lexicon = DEFAULT) -> list[str]:
    return [t for t in tokens(text) if t not in lexicon.stopwords]


def collapse(text: str | None) -> str:
    return " ".join((text or "").split())


@cache
def accent_map() -> tuple[str, str]:
    """Characters that decompose to one ASCII character and marks, and those characters; made from the Unicode tables."""
    pairs = [(chr(k), base) for k in range(128, min(sys.maxunicode, 0xFFFF)) if not 0xD800 <= k < 0xE000 and len(base := normalize(chr(k))) == 1 and ord(base) < 128 and chr(k) == chr(k).lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalized(text: Column) -> Column:
    """normalize() over a column; characters whose base isn't ASCII keep their accents, which no token has."""
    known, plain = accent_map()
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Mn}", ""), known, plain)


def token_list(norm: Column) -> Column:
    """tokens() over a normalised column."""
    return F.regexp_extract_all(norm, F.lit(f"({TOKEN})"), F.lit(1))


def content_list(toks: Column, lexicon: Lexicon = DEFAULT) -> Column:
    stop = F.array(*map(F.lit, sorted(lexicon.stopwords)))
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def collapsed(text: Column) -> Column:
    """collapse() over a column; white space is Unicode's."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
