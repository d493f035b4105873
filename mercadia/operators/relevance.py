"""The relevance predicate: a query is compiled on the driver to one boolean Column over normalised names and their tokens.

Everything about the query (variants, synonyms, patterns) is worked out once; the data side is regular expressions
and array overlaps on literals, so Spark evaluates it in its own code, and can push it below joins.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia import lexicon as words
from mercadia.functions.scalars import is_priced
from mercadia.functions.textnorm import content_tokens, normalize, normalized, token_list, tokens
from mercadia.lexicon import DEFAULT, Lexicon
from mercadia.plans.query import QueryPlan, alias_family, query_variants
from mercadia.shared import spool

NOT_UNIT = rf"(?!\s?(?:{'|'.join(words.UNITS)})\b)"


def _any(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def overlaps(toks: Column, options) -> Column:
    return F.arrays_overlap(toks, F.array(*map(F.lit, sorted(options))))


def token_matches(token: str, norm: Column, toks: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A number must stand alone and not before a unit; a word must meet a synonym, or contain one of five letters or more."""
    if token.isdigit():
        return norm.rlike(rf"(?U)(?<!\d){token}(?!\d){NOT_UNIT}")
    group = sorted(lexicon.group(token))
    return _any([overlaps(toks, group), *(F.contains(norm, F.lit(g)) for g in group if len(g) >= 5)])


def term_matches(term: str, norm: Column, toks: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """A plan's term: its text as it is, if several words, or all its tokens."""
    text = normalize(term)
    parts = tokens(text)
    if not parts:
        return F.lit(False)
    each = _all([token_matches(t, norm, toks, lexicon) for t in parts])
    return F.contains(norm, F.lit(text)) | each if len(parts) > 1 else each


def for_product_pattern(variants, lexicon: Lexicon = DEFAULT) -> str | None:
    """"... para <product>" for any synonym of the variants' words; the product may go on, there is no word end."""
    names = sorted({g for v in variants for t in v if not t.isdigit() for g in lexicon.group(t)})
    return rf"(?U)\bpara\s+(?:uso\s+con\s+)?(?:(?:el|la|tu)\s+)?(?:{'|'.join(map(re.escape, names))})" if names else None


def relevant(query: str, norm: Column, toks: Column, plan: QueryPlan | None = None, lexicon: Lexicon = DEFAULT) -> Column:
    """Does a name fit the query's intent? The rules in their fixed order; each rejects, accepts, or passes on."""
    variants = query_variants(query, lexicon=lexicon)
    asked = content_tokens(query, lexicon)
    if not asked:
        return F.lit(True)
    rules: list[tuple[Column, Column]] = []  # condition, verdict

    for term in plan.exclude_terms if plan else []:
        if tokens(term) and not set(tokens(term)) & set(asked):
            rules.append((term_matches(term, norm, toks, lexicon), F.lit(False)))

    if any(set(q) <= set(asked) for q in words.COOLER_QUERIES):
        fits = norm.rlike(f"(?U){words.COOLER_NAME}")
        if set(words.COOLER_PORTABLE) & set(asked):
            fits = fits & overlaps(toks, words.COOLER_PORTABLE)
        rules.append((~fits, F.lit(False)))

    if asked == [words.BRAND]:
        brand = F.array_contains(toks, words.BRAND) & overlaps(toks, words.BRAND_PRODUCTS) & ~overlaps(toks, words.BRAND_ACCESSORIES)
        rules.append((F.lit(True), brand))
    elif not lexicon.accessories & set(asked):
        rules.append((overlaps(toks, lexicon.accessories), F.lit(False)))
        families = set().union(*(alias_family(a, lexicon) for a in words.FOR_PHRASES))
        pattern = for_product_pattern(variants, lexicon)
        if pattern and tuple(asked) not in families:
            rules.append((norm.rlike(pattern), F.lit(False)))
        if tuple(asked) in alias_family(words.CONSOLE, lexicon):
            rules.append((~overlaps(toks, words.CONSOLE_WORDS), F.lit(False)))

    rules.append((_any([_all([token_matches(t, norm, toks, lexicon) for t in v]) for v in variants]), F.lit(True)))

    groups = plan.required_any_groups if plan else []
    if groups and (len(asked) < 2 or len(groups) >= 2):
        rules.append((_all([_any([term_matches(t, norm, toks, lexicon) for t in g]) for g in groups]), F.lit(True)))

    verdict = F.when(*rules[0])
    for condition, then in rules[1:]:
        verdict = verdict.when(condition, then)
    return verdict.otherwise(F.lit(False))


def with_tokens(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds name_norm and name_toks once, for any number of predicates."""
    return df.withColumn("name_norm", normalized(F.col(name))).withColumn("name_toks", token_list(F.col("name_norm")))


def verdicts(offers: DataFrame, query: str, plan: QueryPlan | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """_name, _fits: each distinct name of offers once, null as empty, with the verdict. Written, so that every use has it as a column."""
    names = with_tokens(offers.select(F.coalesce("name", F.lit("")).alias("_name")).distinct(), "_name")
    return spool(names.select("_name", relevant(query, F.col("name_norm"), F.col("name_toks"), plan, lexicon).alias("_fits")), "verdicts")


def tagged(offers: DataFrame, query: str, plan: QueryPlan | None = None, lexicon: Lexicon = DEFAULT, names: DataFrame | None = None) -> DataFrame:
    """offers with _fits and _priced; offers that have them already stay as they are. names(name): where to find all the offers' names, if more cheaply than in the offers."""
    if "_fits" in offers.columns:
        return offers
    named = offers.withColumn("_name", F.coalesce("name", F.lit("")))
    return named.join(verdicts(offers if names is None else names, query, plan, lexicon), "_name").drop("_name").withColumn("_priced", is_priced(F.col("price")))


def relevant_offers(offers: DataFrame, query: str, plan: QueryPlan | None = None, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Priced offers that fit the query."""
    return tagged(offers, query, plan, lexicon).where("_fits AND _priced").drop("_fits", "_priced")


def match_queries(offers: DataFrame, queries: list[str], lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One scan for many queries: each offer comes out once for each query it fits, with the query's number and text."""
    tagged = with_tokens(offers)
    verdicts = F.array(*[F.struct(F.lit(k).alias("query_id"), F.lit(q).alias("query"), relevant(q, F.col("name_norm"), F.col("name_toks"), lexicon=lexicon).alias("fits")) for k, q in enumerate(queries)])
    found = tagged.withColumn("hit", F.explode(F.filter(verdicts, lambda v: v["fits"])))
    return found.select("hit.query_id", "hit.query", *offers.columns)
