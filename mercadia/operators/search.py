"""Searches end to end: from a table of landed payloads to offers, fetch status, and the answers made of them.

landings: store_key, text, ok, error, body: what one store answered to one text, one row for each (store, text).
stores: the store dimension of sources.landed (key, name, domain, kind, enabled, store_ord).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.scalars import is_priced
from mercadia.functions.textnorm import collapsed, normalized
from mercadia.operators import compare
from mercadia.operators.many import few, match_names
from mercadia.operators.relevance import tagged
from mercadia.plans import columns as plan_columns
from mercadia.plans.query import QueryPlan, local_plan, search_queries
from mercadia.shared import spool
from mercadia.sources.landed import select_stores
from mercadia.sources.payloads import ASK_AGAIN, items, kinds

@dataclass(frozen=True)
class Search:
    """A query's offers, with their verdicts and with pos as their order of arrival, and one row of status for each store asked. live: the offers as they are worked out anew at each use."""

    query: str
    plan: QueryPlan
    store: str | None
    live: DataFrame
    fetches: DataFrame

    @cached_property
    def offers(self) -> DataFrame:
        """The offers, written once, for views that read them more than once."""
        return spool(self.live, "offers")


def texts_of(query: str, plan: QueryPlan, config: EngineConfig = DEFAULT) -> list[str]:
    """The texts to ask each store for: the plan's, or else the query's aliases; the query as it is where there is one at most."""
    texts = plan.search_queries[: config.aliases_with_plan] or search_queries(query, config.aliases_without_plan)
    return texts if len(texts) > 1 else [query]


def first_word(text: Column) -> Column:
    """What a text of several words is asked again as; null for one word."""
    clean = collapsed(text)
    return F.when(F.contains(F.trim(text), F.lit(" ")), F.split(clean, " ")[0])


def opened(landings: DataFrame, stores: DataFrame, texts: DataFrame) -> DataFrame:
    """store_key, store_ord, text, ok, error, items, bare of the landings of these stores for texts(text), each there once. One scan of landings, one parse of each.

    bare: has the answer no items, and does this kind ask again after such an answer? Listings do where the listing itself is empty, pages where nothing in them can be read.
    """
    used = [r["kind"] for r in stores.select("kind").distinct().collect()]  # kinds of endpoint: a few
    asked = landings.join(texts, "text", "left_semi").join(stores.select(F.col("key").alias("store_key"), "store_ord", "kind", "domain"), "store_key")
    read = asked.select("store_key", "store_ord", "text", "kind", F.coalesce("ok", F.lit(False)).alias("ok"), "error", "body", F.when(F.col("ok"), items(F.col("kind"), F.col("body"), F.col("domain"), used)).alias("items"))
    some = F.coalesce(F.size("items"), F.lit(0)) > 0
    none = F.when(some, False).when(F.startswith("kind", F.lit("vtex")), F.json_array_length("body") == 0).otherwise(True)  # a listing is read again only where it gave no offers
    bare = F.col("ok") & F.col("kind").isin(ASK_AGAIN) & F.coalesce(none, F.lit(False))
    return spool(read.select("store_key", "store_ord", "text", "ok", "error", "items", bare.alias("bare")), "opened")


def fan_out(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """wanted(store_key, text, again, ...) with ok and error, and `heard`, the text whose items of opened landings count; null where it failed. A text that finds nothing is asked again as `again`, where that isn't null and has landed; nothing
    landed counts as failed. Items stay where they are."""
    told = answers.select("store_key", "text", "ok", "error", "bare")
    second = told.select("store_key", F.col("text").alias("again"), F.col("ok").alias("_ok"), F.col("error").alias("_error"))
    both = wanted.join(told, ["store_key", "text"], "left").join(second, ["store_key", "again"], "left")
    anew = F.coalesce("bare", F.lit(False)) & F.col("_ok").isNotNull()
    done = {"error": F.when(anew & ~F.col("_ok"), F.col("_error")).otherwise(F.col("error")), "ok": F.when(anew, F.col("_ok")).otherwise(F.coalesce("ok", F.lit(False)))}
    both = both.withColumn("heard", F.when(anew, F.col("again")).otherwise(F.col("text")))
    return both.select(*wanted.columns, *[v.alias(k) for k, v in done.items()], F.when(done["ok"], F.col("heard")).alias("heard"))


def with_items(fetched: DataFrame, answers: DataFrame) -> DataFrame:
    """The offers of one query's fetched(store_key, heard, ...): the few rows of a store, one for each alias, are one array, so an answer moves once, whole, to its store's others, where the union of aliases finds its items: they needn't move."""
    asked = fetched.where("ok").groupBy("store_key").agg(F.collect_list(F.struct(*[c for c in fetched.columns if c not in ("store_key", "ok")])).alias("_asked"))  # as many as a query has aliases
    held = answers.where("ok").select("store_key", "text", "items").join(asked, "store_key").repartition("store_key")
    mine = F.explode(F.filter("_asked", lambda a: a["heard"] == F.col("text"))).alias("_a")
    return held.select("store_key", mine, "items").select("store_key", "_a.*", "items").select("*", F.inline("items")).drop("heard", "items")


def search(landings: DataFrame, stores: DataFrame, query: str, store: str | None = None, plan: QueryPlan | None = None, config: EngineConfig = DEFAULT) -> Search:
    """The offers of the enabled stores, or of the one named, to a query and its aliases, each offer once. What the stores answered, verdicts and status are written before the views are made of them."""
    plan = local_plan(query) if plan is None else plan
    texts = texts_of(query, plan, config)
    chosen = select_stores(stores, store)
    spark = landings.sparkSession
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "alias_ord int, text string").withColumn("again", first_word(F.col("text")))
    heard = asked.select(F.explode(F.array("text", "again")).alias("text")).where("text IS NOT NULL").distinct()
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("alias_ord"), F.lit(t).alias("text")) for k, t in enumerate(texts)])).alias("a")
    wanted = chosen.select(F.col("key").alias("store_key"), F.col("name").alias("store_name"), "store_ord", "kind", each).select("*", "a.*").drop("a").withColumn("again", first_word(F.col("text")))
    answers = opened(landings, chosen, F.broadcast(heard))  # heard: the query's texts, a few
    fetched = spool(fan_out(wanted, answers), "fetched")

    found = with_items(fetched.select("store_key", "store_name", "alias_ord", "ok", "heard"), answers).withColumns({"ok": F.lit(True), "n_aliases": F.lit(len(texts))})
    once = compare.alias_union(found, "pos").withColumn("pos", F.struct("alias_ord", "pos")).drop("ok", "n_aliases")
    live = tagged(once, query, plan, names=answers.where("ok").select(F.inline("items")))
    status = compare.fetch_status(fetched.select("store_key", "kind", "alias_ord", "ok", "error"), kinds())
    names = chosen.select(F.col("key").alias("store_key"), F.col("name").alias("store_name"), "store_ord")
    return Search(query, plan, store, live, spool(names.join(status, "store_key"), "status"))


def cli(found: Search) -> DataFrame:
    """The lines of the command line's table."""
    return compare.cli_view(found.offers, found.fetches, found.query, found.plan)


def rows(found: Search) -> DataFrame:
    """One row for each store with its best offer, its items and the image, in order of rank."""
    best = compare.best_per_store(found.offers, found.fetches, found.query, found.plan)
    return best.join(compare.items_of_stores(found.offers, found.fetches, found.query, found.plan), "store_key", "left")


def api(found: Search) -> DataFrame:
    """The search answer as one row; a blank query has no results."""
    query = found.query.strip()
    best = compare.best_per_store(found.offers, found.fetches, query, found.plan)
    if not query:
        return compare.api_response(query, best.limit(0), canonical=None)
    return compare.api_response(query, best, compare.items_of_stores(found.offers, found.fetches, query, found.plan), found.plan.canonical_query, found.plan.source)


def log_row(found: Search, ts: int) -> DataFrame:
    return compare.log_row(found.query, found.store, compare.ranks(found.live, found.fetches, found.query, found.plan), ts)


def batch(landings: DataFrame, stores: DataFrame, queries: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """query_id, query, store_key, store_name, price: the cheapest match of each of queries(query_id, query[, plan]) at the enabled stores; those without a match are left out. For compare.batch_total.

    One job for all queries: each landing is parsed once, whichever queries ask for its text, and each distinct name is tested once. plan is a struct of QueryPlan's fields; where it has no texts the query's aliases are asked for.
    """
    query = collapsed(F.col("query"))
    local = F.slice(plan_columns.search_texts(query, config.aliases_without_plan), 1, config.aliases_without_plan)
    planned = F.slice(F.col("plan.search_queries"), 1, config.aliases_with_plan) if "plan" in queries.columns else F.lit(None).cast("array<string>")
    texts = F.when(F.coalesce(F.size(planned), F.lit(0)) > 0, planned).otherwise(local)
    texts = F.when(F.size(texts) > 1, texts).otherwise(F.array(query))
    asked = spool(queries.select("query_id", texts.alias("texts")).select("query_id", F.size("texts").alias("n_aliases"), F.posexplode("texts").alias("alias_ord", "text")).withColumn("again", first_word(F.col("text"))), "asked")
    heard = asked.select(F.explode(F.array("text", "again")).alias("text")).where("text IS NOT NULL").distinct()
    chosen = select_stores(stores)
    answers = opened(landings, chosen, heard)
    offers = heard_offers(asked, answers)
    names = spool(answers.where("ok").select(F.inline("items")).where(is_priced(F.col("price"))).select(F.coalesce("name", F.lit("")).alias("_name")).distinct().withColumn("norm", normalized(F.col("_name"))), "batch-names")
    fits = spool(match_names(names.select("norm").distinct(), queries).join(names, "norm").select("query_id", "_name"), "batch-fits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("price", "store_ord", "alias_ord", "pos"))
    best = offers.withColumn("_name", F.coalesce("name", F.lit(""))).join(few(fits), ["query_id", "_name"]).select("query_id", "store_key", "store_ord", "alias_ord", "pos", "price").withColumn("_rank", rank).where("_rank = 1")
    named = best.join(chosen.select(F.col("key").alias("store_key"), F.col("name").alias("store_name")), "store_key")
    return named.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "store_key", "store_name", "price")


def heard_offers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, store_key, store_ord, alias_ord, pos, name, url, price: the priced offers of asked(query_id, alias_ord, n_aliases, text, again) in opened landings, each once for a query of several aliases.

    The texts go to the answers, whose items stay where they are: a bare answer has none, so only what is asked again in its place is sought by store and text, where it is kept.
    """
    kept = answers.where("ok").select("store_key", "store_ord", "text", "items")
    bare = answers.where("bare").select("store_key", "text")

    def found(some: DataFrame) -> DataFrame:
        again = spool(bare.join(few(some.where("again IS NOT NULL")), "text").select("store_key", F.col("again").alias("text"), "query_id", "alias_ord"), "again")
        both = kept.join(few(some.select("text", "query_id", "alias_ord")), "text").unionByName(kept.join(few(again), ["store_key", "text"]))
        return both.select("query_id", "store_key", "store_ord", "alias_ord", F.inline("items")).where(is_priced(F.col("price"))).drop("available", "image")

    return found(asked.where("n_aliases <= 1")).unionByName(compare.keep_first(found(asked.where("n_aliases > 1")), "alias_ord", "pos", by=("query_id",)))
