"""Plans as table columns: landed answers and untrusted plans in JSON become clean plans, without Python; alias expansion of a column of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mercadia.config import DEFAULT as CONFIG
from mercadia.functions.scalars import clamp
from mercadia.functions.textnorm import collapsed, normalized
from mercadia.plans import query as plans

LONGEST = 80
END = "\x1f"


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _elements(value: Column) -> Column:
    """The elements of a variant that is a list, else none."""
    return F.coalesce(_at(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def unlike(texts: Column) -> Column:
    """Non-empty texts that differ once normalised, in order. Each is normalised once: inside an array function Spark works out an expression anew at each use, so the pairs are bound to a name."""
    pairs = F.transform(F.filter(texts, lambda t: t != ""), lambda t: F.struct(normalized(t).alias("norm"), t.alias("text")))
    firsts = lambda p: F.transform(F.filter(p, lambda x, k: F.array_position(p["norm"], x["norm"]) == k + 1), lambda x: x["text"])
    return F.get(F.transform(F.array(pairs), firsts), 0)


def clean_list(value: Column, limit: int, longest: int = LONGEST) -> Column:
    """Texts of a variant that is a list: white space collapsed, repeats and long ones out, at most `limit`. A null in it reads None, as a text."""
    texts = F.transform(_elements(value), lambda x: collapsed(F.coalesce(_at(x, "$", "string"), F.lit("None"))))
    return F.slice(unlike(F.filter(texts, lambda t: F.length(t) <= longest)), 1, limit)


def _said(value: Column, *names: str) -> Column:
    """The first field that is a non-empty text or a number other than 0."""
    each = []
    for n in names:
        x, text = _at(value, f"$.{n}"), _at(value, f"$.{n}", "string")
        each.append(F.when(_is_text(x), F.nullif(text, F.lit(""))).when(text.try_cast("double") != 0, text))
    return F.coalesce(*each)


def sanitized(body: Column) -> Column:
    """A plan, as a struct of QueryPlan's fields, from untrusted JSON: wrong types give defaults, lists are capped."""
    return sanitized_variant(F.try_parse_json(body))


def sanitized_variant(v: Column) -> Column:
    """sanitized() of parsed JSON; of a column of it, so that each body is parsed once for all fields."""
    groups = F.filter(F.transform(_elements(_at(v, "$.required_any_groups")), lambda g: clean_list(g, 12)), lambda g: F.size(g) > 0)
    return F.struct(
        F.coalesce(_said(v, "original_query"), F.lit("")).alias("original_query"), F.coalesce(_said(v, "canonical_query", "original_query"), F.lit("")).alias("canonical_query"),
        clean_list(_at(v, "$.search_queries"), 8).alias("search_queries"), F.slice(groups, 1, 4).alias("required_any_groups"), clean_list(_at(v, "$.exclude_terms"), 30).alias("exclude_terms"),
        clamp(_at(v, "$.confidence", "string"), 0.0, 1.0).alias("confidence"), F.coalesce(_said(v, "source"), F.lit("local")).alias("source"),
    )


def merged_texts(query: Column, plan: Column, fallback: Column) -> Column:
    """The texts to search for: the query first, then those of the plan, and the fallback's last, at most eight."""
    return F.slice(unlike(F.transform(F.concat(F.array(query), plan["search_queries"], fallback), collapsed)), 1, 8)


def merged(query: Column, plan: Column, fallback: Column, source: Column) -> Column:
    """A plan(struct) merged with the texts of the local plan."""
    canonical = F.coalesce(F.nullif(plan["canonical_query"], F.lit("")), query)
    kept = (plan[c].alias(c) for c in ("required_any_groups", "exclude_terms", "confidence"))
    return F.struct(query.alias("original_query"), canonical.alias("canonical_query"), merged_texts(query, plan, fallback).alias("search_queries"), *kept, source.alias("source"))


def output_text(body: Column) -> Column:
    """The text of a model's response document in JSON, or an empty one."""
    v = F.try_parse_json(body)
    said = _at(v, "$.output_text")
    messages = F.filter(_elements(_at(v, "$.output")), lambda m: F.coalesce(_at(m, "$.type", "string") == "message", F.lit(False)))
    parts = F.transform(F.flatten(F.transform(messages, lambda m: _elements(_at(m, "$.content")))), lambda c: _at(c, "$.text"))
    first = F.get(F.filter(parts, _is_text), 0)
    return F.when(_is_text(said), _at(said, "$", "string")).otherwise(F.coalesce(_at(first, "$", "string"), F.lit("")))


def _expanded(one) -> Callable[[Column], Column]:
    """A pandas function over a column of queries; each distinct one of a batch is expanded once, from the lexicon alone. The texts come back as one string, each ended by END, which is white space to Python and so in none of them."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for queries in batches:
            texts = queries.fillna("")
            known = {q: "".join(t + END for t in one(q)) for q in texts.unique()}
            yield texts.map(known)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    joined = F.pandas_udf(run, StringType())

    def texts(query: Column) -> Column:
        parts = F.split(joined(query), END, -1)
        return F.slice(parts, 1, F.size(parts) - 1)

    return texts


def search_texts(query: Column, limit: int = CONFIG.search_queries) -> Column:
    """plans.search_queries of a column; null counts as empty."""
    return _expanded(lambda q: plans.search_queries(q, limit))(query)


def variant_texts(query: Column) -> Column:
    """plans.query_variants of a column, each variant's tokens joined by blanks."""
    return _expanded(lambda q: [" ".join(v) for v in plans.query_variants(q)])(query)
