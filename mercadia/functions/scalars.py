"""Prices, stock flags, HTML text, URLs and keys as Column expressions. Bad input gives null, not a failed query."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.textnorm import collapsed

NO_NAME = "—"


def as_price(raw: Column) -> Column:
    """Text to a price: commas and spaces off, two decimals; empty, null and unreadable values are null."""
    return F.round(F.trim(F.replace(raw.cast("string"), F.lit(","), F.lit(""))).try_cast("double"), 2)


def normalize_price(price: Column, config: EngineConfig = DEFAULT) -> Column:
    """Two decimals; if the config says so, values over its threshold count as cents."""
    p = price.cast("double")
    return F.round(F.when(p > config.cents_threshold, p / 100).otherwise(p) if config.normalize_cents else p, 2)


def minor_units(raw: Column, digits: Column) -> Column:
    """raw / 10^digits; digits null or 0 count as 2."""
    return F.round(raw.cast("double") / F.pow(F.lit(10.0), F.coalesce(F.nullif(digits.cast("int"), F.lit(0)), F.lit(2))), 2)


def is_priced(price: Column) -> Column:
    return F.coalesce((price > 0) & ~F.isnan(price), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: inside an array function Spark would do so at each use."""
    return F.get(F.transform(F.array(value), use), 0)


def stock_in(low: Column, *marks: str) -> Column:
    """0 if one of the marks occurs in the text, which is in lower case, else 1."""
    return F.when(reduce(or_, [F.contains(low, F.lit(m)) for m in marks], F.lit(False)), 0).otherwise(1)


def stock_flag(text: Column, *marks: str) -> Column:
    """0 if one of the marks occurs in the text, in any case, else 1."""
    return once(F.lower(F.coalesce(text, F.lit(""))), lambda low: stock_in(low, *marks))


#: Character references that need no table; the ampersand comes last.
COMMON = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ntilde;", "ñ"), ("&amp;", "&")]


@cache
def _references() -> tuple[str, str]:
    """HTML's named references as a JSON map, from Python's table, and a pattern of those that need no semicolon, longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps(html5), f"^({'|'.join(bare)})"


# What numbered references of the C1 controls stand for, and numbers that stand for nothing.
C1 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
NOTHING = [*range(1, 9), 11, *range(14, 32), *range(127, 160), *range(0xFDD0, 0xFDF0), *(p * 65536 + k for p in range(17) for k in (0xFFFE, 0xFFFF))]


def _numbered(digits: Column, base: int) -> Column:
    """The character of a numbered reference."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.conv(F.when(F.length(short) == 0, "0").otherwise(short), base, 10).cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = (F.length(short) > 7) | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, "\ufffd").when(n == 13, "\r").when(n.between(128, 159), F.substring(F.lit(C1), (n - 127).cast("int"), F.lit(1))).when(n.isin(NOTHING), "").otherwise(char)


def _reference(part: Column) -> Column:
    """What stands behind an ampersand, with the reference that it may begin with decoded, as browsers do."""
    names, bare = _references()
    decimal, hexadecimal = F.regexp_extract(part, "^#([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]([0-9a-fA-F]+);?", 1)
    name = F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0)
    known = F.try_element_at(F.from_json(F.lit(names), "map<string,string>"), name)
    legacy = F.regexp_extract(name, bare, 1)
    of_legacy = F.concat(F.try_element_at(F.from_json(F.lit(names), "map<string,string>"), legacy), F.substring(part, F.length(legacy) + 1, F.length(part)))
    return (
        F.when(decimal != "", F.concat(_numbered(decimal, 10), F.regexp_replace(part, "^#[0-9]+;?", "")))
        .when(hexadecimal != "", F.concat(_numbered(hexadecimal, 16), F.regexp_replace(part, "^#[xX][0-9a-fA-F]+;?", "")))
        .when(known.isNotNull(), F.concat(known, F.substring(part, F.length(name) + 1, F.length(part))))
        .when(legacy != "", of_legacy)
        .otherwise(F.concat(F.lit("&"), part))
    )


def unescape(text: Column, full: bool = True) -> Column:
    """Character references to characters: all of HTML's, or only the COMMON ones."""
    if full:
        decoded = lambda p: F.concat(F.get(p, 0), F.array_join(F.transform(F.slice(p, 2, F.size(p)), _reference), ""))
        return once(text, lambda t: F.when(F.contains(t, F.lit("&")), once(F.split(t, "&", -1), decoded)).otherwise(t))
    for name, char in COMMON:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def text_of_markup(markup: Column, full: bool = True) -> Column:
    """html_text of a column that isn't null and needs no working out."""
    marked = reduce(or_, [F.contains(markup, F.lit(m)) for m in ("<", "&", "  ")]) | F.regexp_like(markup, F.lit("[^ -~]"))
    return F.when(marked, collapsed(unescape(F.regexp_replace(markup, "<[^>]+>", " "), full))).otherwise(F.trim(markup))


def html_text(markup: Column, full: bool = True) -> Column:
    """Tags to spaces, references decoded, white space collapsed. Printable ASCII without either is only trimmed."""
    return once(F.coalesce(markup, F.lit("")), lambda t: text_of_markup(t, full))


def html_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def money(price: Column, missing: str = "N/D") -> Column:
    return F.coalesce(F.concat(F.lit("Q"), F.format_number(price, 2)), F.lit(missing))


def url_quote(text: Column, keep_slash: bool = False) -> Column:
    """Percent-encoding of all but letters, digits and _.-~ (and / if kept)."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *([("%2F", "/")] if keep_slash else [])):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clamp(value: Column, low: float, high: float) -> Column:
    """Unreadable values are low; NaN is high."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.cast("string").try_cast("double"), F.lit(low))))


def cache_key(store: Column, query: Column) -> Column:
    return F.concat(store, F.lit("::"), F.lower(F.trim(query)))


def cache_file(key: Column) -> Column:
    return F.concat(F.substring(F.sha2(key, 256), 1, 32), F.lit(".json"))


def client_key(forwarded: Column, host: Column) -> Column:
    """The first forwarded address; without that header the peer; else unknown."""
    sent = F.trim(F.split(forwarded, ",")[0])
    return F.when(F.coalesce(forwarded, F.lit("")) != "", sent).otherwise(F.coalesce(host, F.lit("unknown")))


def truthy(text: Column) -> Column:
    """Null where a JSON scalar, as text, is empty or null."""
    return F.nullif(text, F.lit(""))
