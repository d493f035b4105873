"""Relevance for a table of queries, of any number: queries, variants and terms are rows and arrays, not compiled code.

Each distinct normalised name gets a profile, once, and index keys: its words, its runs of digits and its 3-grams. Of each query, every alternative (a
variant, or the plan's required groups) is a list of needs, all of which a fitting name must meet; a need is met only by names that hold one of
its keys. The need whose keys are rarest among the names leads to the candidates, by an equi-join on the key; the rules then decide
each pair of query and name exactly, as operators.relevance.relevant does for one query.

A key that many names share is spread over salts, and its queries go to each of them. A name that many offers share meets its queries by broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia import lexicon as words
from mercadia.functions.textnorm import content_list, normalized, token_list
from mercadia.lexicon import DEFAULT, Lexicon
from mercadia.operators.relevance import NOT_UNIT, overlaps
from mercadia.plans import columns as plan_columns
from mercadia.plans.query import alias_family
from mercadia.shared import spool

#: Names of a key that one task takes, and rows that are broadcast at most.
SALT_ROWS, BROADCAST_ROWS = 50_000, 200_000
#: Offers of a name from which on it is met by broadcast.
CROWD = 4096
LONG_WORD, GRAM = 5, 3
ANY = "*"
_PARA = r"(?U)\bpara\s+"
_ARTICLE = r"(?:el|la|tu)\s+"
#: The word that follows; what it is compared with has no other characters.
_NEXT = "(?=([a-z0-9]+))"


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _groups(lexicon: Lexicon) -> Column:
    """A map from each word with synonyms to its group."""
    group = {t: sorted(lexicon.group(t)) for g in lexicon.synonyms for t in g}
    return F.from_json(F.lit(json.dumps(group)), "map<string,array<string>>")


def _asked_word(token: Column, groups: Column) -> Column:
    """A token of a query: a number, or words any of which will do."""
    return F.struct(F.when(F.regexp_like(token, F.lit("^[0-9]+$")), token).alias("number"), F.coalesce(F.try_element_at(groups, token), F.array(token)).alias("words"))


def _asked_term(term: Column, groups: Column) -> Column:
    """A term of a plan: its tokens, and its text if it has several."""
    norm = normalized(term)
    toks = token_list(norm)
    return F.struct(F.when(F.size(toks) > 1, norm).alias("text"), F.transform(toks, lambda t: _asked_word(t, groups)).alias("tokens"))


def compiled(queries: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One row for each of queries(query_id, query), which may have plan, a struct of QueryPlan's fields: what the rules need of a query."""
    groups = _groups(lexicon)
    plan = F.col("plan") if "plan" in queries.columns else None
    some = lambda field, kind: F.coalesce(plan[field], F.array().cast(kind)) if plan is not None else F.array().cast(kind)
    read = queries.withColumns({"asked": content_list(token_list(normalized(F.col("query"))), lexicon), "texts": plan_columns.variant_texts(F.col("query"))})
    read = read.withColumns({"terms": some("exclude_terms", "array<string>"), "required": some("required_any_groups", "array<array<string>>")})
    asked = F.col("asked")
    phrase = F.array_join(asked, " ")
    family = lambda *anchors: phrase.isin(sorted({" ".join(t) for a in anchors for t in alias_family(a, lexicon)}))
    cooler = F.lit(False)
    for q in words.COOLER_QUERIES:
        cooler = cooler | (F.size(F.array_intersect(asked, _texts(q))) == len(q))
    variants = F.transform("texts", lambda v: F.transform(F.filter(F.split(v, " "), lambda t: t != ""), lambda t: _asked_word(t, groups)))
    brand = asked == F.array(F.lit(words.BRAND))
    strict = ~brand & ~overlaps(asked, lexicon.accessories)
    told = F.filter("terms", lambda t: (F.size(token_list(normalized(t))) > 0) & ~F.arrays_overlap(token_list(normalized(t)), asked))
    needed = F.when((F.size(asked) < 2) | (F.size("required") >= 2), F.col("required")).otherwise(F.array().cast("array<array<string>>"))
    done = read.select(
        "query_id", "query", (F.size(asked) == 0).alias("everything"), variants.alias("variants"), F.coalesce(cooler, F.lit(False)).alias("cooler"), overlaps(asked, words.COOLER_PORTABLE).alias("portable"),
        brand.alias("brand"), strict.alias("strict"), (strict & family(words.CONSOLE)).alias("console"), (strict & ~family(*words.FOR_PHRASES)).alias("bare"),
        F.transform(told, lambda t: _asked_term(t, groups)).alias("exclude"), F.transform(needed, lambda g: F.transform(g, lambda t: _asked_term(t, groups))).alias("required"),
    )
    products = F.array_distinct(F.flatten(F.transform(F.filter(F.flatten("variants"), lambda t: t["number"].isNull()), lambda t: t["words"])))
    return done.withColumn("products", F.when(F.col("bare"), products).otherwise(F.array().cast("array<string>"))).drop("bare")


def profile(norm: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """What the rules need of a normalised name: its tokens, its numbers that no unit follows, the words after "para", and flags."""
    toks = token_list(norm)
    after = [F.regexp_extract_all(norm, F.lit(_PARA + x + _NEXT), F.lit(1)) for x in ("", r"uso\s+con\s+", rf"(?:uso\s+con\s+)?{_ARTICLE}")]
    branded = F.array_contains(toks, words.BRAND) & overlaps(toks, words.BRAND_PRODUCTS) & ~overlaps(toks, words.BRAND_ACCESSORIES)
    return F.struct(
        toks.alias("toks"), F.regexp_extract_all(norm, F.lit(rf"(?U)(?<!\d)(\d+)(?!\d){NOT_UNIT}"), F.lit(1)).alias("nums"), F.array_distinct(F.concat(*after)).alias("para"),
        overlaps(toks, lexicon.accessories).alias("accessory"), F.regexp_like(norm, F.lit(f"(?U){words.COOLER_NAME}")).alias("cooler"), overlaps(toks, words.COOLER_PORTABLE).alias("portable"),
        branded.alias("brand"), overlaps(toks, words.CONSOLE_WORDS).alias("console"),
    )


def fits(query: Column, norm: Column, name: Column) -> Column:
    """The rules in their fixed order, for a compiled query and a name's profile."""

    def word(t: Column) -> Column:
        held = F.arrays_overlap(name["toks"], t["words"]) | F.exists(t["words"], lambda w: (F.length(w) >= LONG_WORD) & F.contains(norm, w))
        return F.when(t["number"].isNotNull(), F.array_contains(name["nums"], t["number"])).otherwise(held)

    def term(t: Column) -> Column:
        return (F.size(t["tokens"]) > 0) & (F.coalesce(F.contains(norm, t["text"]), F.lit(False)) | F.forall(t["tokens"], word))

    accessory_for = F.exists(name["para"], lambda w: F.exists(query["products"], lambda p: F.startswith(w, p)))
    return (
        F.when(query["everything"], True)
        .when(F.exists(query["exclude"], term), False)
        .when(query["cooler"] & ~(name["cooler"] & (~query["portable"] | name["portable"])), False)
        .when(query["brand"], name["brand"])
        .when(query["strict"] & (name["accessory"] | accessory_for), False)
        .when(query["console"] & ~name["console"], False)
        .when(F.exists(query["variants"], lambda v: F.forall(v, word)), True)
        .otherwise((F.size(query["required"]) > 0) & F.forall(query["required"], lambda g: F.exists(g, term)))
    )


def _grams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=([a-z0-9]{{{GRAM}}}))"), F.lit(1)))


def _tagged(mark: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(mark), v))


def name_keys(norm: Column, toks: Column) -> Column:
    """The index keys of a name; ANY is every name's."""
    return F.array_distinct(F.concat(_tagged("w", toks), _tagged("n", F.regexp_extract_all(norm, F.lit(r"(?U)(\d+)"), F.lit(1))), _tagged("g", _grams(norm)), F.array(F.lit(ANY))))


def _word_parts(t: Column) -> Column:
    """For each word that meets a need, the keys any one of which every name with that word has."""
    short = lambda w: F.array(F.concat(F.lit("w"), w))
    of = F.transform(t["words"], lambda w: F.when(F.length(w) >= LONG_WORD, _tagged("g", _grams(w))).otherwise(short(w)))
    return F.when(t["number"].isNotNull(), F.array(F.array(F.concat(F.lit("n"), t["number"])))).otherwise(of)


def _term_parts(t: Column) -> Column:
    grams = _grams(F.coalesce(t["text"], F.lit("")))
    whole = F.when(t["text"].isNull(), F.array().cast("array<array<string>>")).when(F.size(grams) > 0, F.array(_tagged("g", grams))).otherwise(F.array(F.array(F.lit(ANY))))
    return F.when(F.size(t["tokens"]) == 0, F.array().cast("array<array<string>>")).otherwise(F.concat(_word_parts(F.get(t["tokens"], 0)), whole))


def needs(queries: DataFrame) -> DataFrame:
    """query_id, alt, need, part, key of compiled queries. Of an alternative all needs must be met, of a need one part, and a part's names have all its keys."""
    of_variants = F.transform("variants", lambda v: F.transform(v, _word_parts))
    of_groups = F.when(F.size("required") > 0, F.array(F.transform("required", lambda g: F.flatten(F.transform(g, _term_parts)))))
    everyone = F.array(F.array(F.array(F.array(F.lit(ANY)))))
    alternatives = F.when(F.col("everything"), everyone).otherwise(F.concat(of_variants, F.coalesce(of_groups, F.array().cast("array<array<array<array<string>>>>"))))
    rows = queries.select("query_id", F.posexplode(alternatives).alias("alt", "x")).select("query_id", "alt", F.posexplode("x").alias("need", "x"))
    return rows.select("query_id", "alt", "need", F.posexplode("x").alias("part", "x")).select("query_id", "alt", "need", "part", F.explode("x").alias("key"))


def few(df: DataFrame) -> DataFrame:
    """Broadcast where the counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def match_names(names: DataFrame, queries: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """query_id, norm: which of names(norm), each there once, fit which of queries(query_id, query[, plan])."""
    asked = spool(compiled(queries, lexicon), "queries")
    known = spool(names.select("norm", F.monotonically_increasing_id().alias("name_id"), profile(F.col("norm"), lexicon).alias("name")), "names")
    wanted = spool(needs(asked), "needs")
    keys = wanted.select("key").distinct()
    held = known.select("name_id", F.explode(name_keys(F.col("norm"), F.col("name.toks"))).alias("key"))
    held = spool(held.join(few(keys), "key", "left_semi"), "postings")

    counted = held.groupBy("key").agg(F.count("*").alias("n"))
    part = wanted.join(counted, "key", "left").groupBy("query_id", "alt", "need", "part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
    cost = part.groupBy("query_id", "alt", "need").agg(F.sum("k.n").alias("cost"), F.collect_set("k.key").alias("keys"))  # as many as a need has words
    chosen = cost.groupBy("query_id", "alt").agg(F.min_by("keys", F.struct("cost", "need")).alias("keys")).select("query_id", F.explode("keys").alias("key")).distinct()
    chosen = spool(chosen.join(counted, "key").withColumn("salts", F.expr(f"cast(ceil(n / {SALT_ROWS}) as int)")), "chosen")
    salts = chosen.where("salts > 1").select("key", "salts").distinct()  # few: each has more than SALT_ROWS names
    spread = held.join(F.broadcast(salts), "key", "left").withColumn("salt", F.pmod(F.xxhash64("name_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    leads = chosen.select("query_id", "key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    pairs = spread.join(few(leads), ["key", "salt"]).select("query_id", "name_id").distinct()
    whole = asked.select("query_id", F.struct("*").alias("query"))
    tested = pairs.join(known, "name_id").join(few(whole), "query_id")
    return tested.where(fits(F.col("query"), F.col("norm"), F.col("name"))).select("query_id", "norm")


def _named(offers: DataFrame, name: str) -> DataFrame:
    return offers.withColumn("_name", F.coalesce(F.col(name), F.lit("")))


def match_table(offers: DataFrame, queries: DataFrame, lexicon: Lexicon = DEFAULT, name: str = "name") -> DataFrame:
    """The rows of offers, each once for each of queries(query_id, query[, plan]) it fits, with query_id. Each distinct name is tested once."""
    named = _named(offers, name)
    names = spool(named.groupBy("_name").agg(F.count("*").alias("_n")).withColumn("norm", normalized(F.col("_name"))), "names")
    found = match_names(names.select("norm").distinct(), queries, lexicon)
    found = spool(found.join(names, "norm").drop("norm"), "matches")
    if found.count() <= BROADCAST_ROWS:
        return named.join(F.broadcast(found.drop("_n")), "_name").drop("_name")
    crowds = spool(names.where(F.col("_n") > CROWD).select("_name"), "crowds")
    of_crowds, rest = found.where(F.col("_n") > CROWD).drop("_n"), found.where(F.col("_n") <= CROWD).drop("_n")
    if of_crowds.count() > BROADCAST_ROWS:
        return named.join(found.drop("_n"), "_name").drop("_name")
    lone = named.join(F.broadcast(crowds), "_name", "left_anti").join(rest, "_name")
    return lone.unionByName(named.join(F.broadcast(of_crowds), "_name")).drop("_name")


def _first(rows: DataFrame, key: str, order: tuple) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def best_of_names(offers: DataFrame, *ties: str, price: str = "price", name: str = "name") -> DataFrame:
    """The cheapest row of each distinct name of offers, by `ties` among equal prices; rows without a price are left out. The least prices are found by a hash aggregation, so only rows of that price are sorted."""
    named = _named(offers, name).where(F.col(price).isNotNull())
    least = named.groupBy("_name").agg(F.min(price).alias("_least"))
    return _first(named.join(least, "_name").where(F.col(price) == F.col("_least")).drop("_least"), "_name", (price, *ties)).drop("_name")


def cheapest(offers: DataFrame, queries: DataFrame, *ties: str, price: str = "price", lexicon: Lexicon = DEFAULT, name: str = "name") -> DataFrame:
    """query_id and the cheapest row of offers that fits each of queries, by `ties` among equal prices; queries without a fitting priced row are left out. Of each distinct name only its cheapest row takes part."""
    best = best_of_names(offers, *ties, price=price, name=name).withColumn("_norm", normalized(F.col(name)))
    best = spool(_first(best, "_norm", (price, *ties)), "best-of-names")
    found = match_names(best.select(F.col("_norm").alias("norm")), queries, lexicon).withColumnRenamed("norm", "_norm")
    return _first(found.join(best, "_norm"), "query_id", (price, *ties)).drop("_norm")
