"""From offers to a comparison: union and dedupe, the best offer of each store in both modes, and the views made of it.

offers: store_key, store_name, name, price, available, url, image, pos (any orderable: the order of arrival).
fetches: store_key, store_name, store_ord, ok, error: one row for each store that was asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.scalars import is_priced
from mercadia.operators.many import best_of_names, match_table
from mercadia.operators.relevance import match_queries, relevant_offers, tagged
from mercadia.plans.query import QueryPlan

NO_RESULTS = "sin resultados"
NO_MATCH = "sin coincidencia para tu búsqueda"
NO_PRICE = "productos encontrados sin precio público"
FOREVER = float("inf")


def dedupe_key() -> list[Column]:
    """Price, address (or name where that is empty), store; a missing price and 0 are the same. The price comes first, since a sort tells numbers apart faster than texts."""
    address = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.lower(F.trim("url"))).otherwise(F.lower(F.trim("name")))
    return [F.coalesce("price", F.lit(0.0)), address, F.col("store_key")]


def keep_first(offers: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first offer of each dedupe key (within `by`), in the given order."""
    rank = F.row_number().over(Window.partitionBy(*dedupe_key(), *by).orderBy(*order))
    return offers.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def alias_union(fetched: DataFrame, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Offers of all alias fetches of a store(store_key, alias_ord, ok, n_aliases, ...): failed fetches out; deduped only where the store was asked more than once."""
    good = fetched.where("ok")
    return good.where("n_aliases <= 1").unionByName(keep_first(good.where("n_aliases > 1"), "alias_ord", *order, by=by))


def fetch_status(fetches: DataFrame, known_kinds: list[str] | None = None) -> DataFrame:
    """One row for each store of alias fetches(store_key, alias_ord, ok, error): ok if any was; else the first one's error."""
    if known_kinds is not None:
        unknown = ~F.col("kind").isin(known_kinds)
        fetches = fetches.withColumns({"ok": ~unknown & F.col("ok"), "error": F.when(unknown, "scraper no implementado").otherwise(F.col("error"))})
    ok = F.bool_or("ok")
    return fetches.groupBy("store_key").agg(ok.alias("ok"), F.when(~ok, F.min_by("error", "alias_ord")).alias("error"))


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """The primary rows, and the fallback rows of keys that the primary has none of."""
    return primary.unionByName(fallback.join(primary.select(keys).distinct(), keys, "left_anti"))


def unavailable() -> Column:
    return F.col("available") <= 0


def _winners(offers: DataFrame, *order) -> DataFrame:
    """The first offer of each store, by order."""
    rank = F.row_number().over(Window.partitionBy("store_key").orderBy(*order))
    return offers.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def best_match_per_store(offers: DataFrame, query: str, plan: QueryPlan | None = None) -> DataFrame:
    """The cheapest relevant offer of each store, whatever its stock; the first one on ties."""
    return _winners(tagged(offers, query, plan).where("_fits AND _priced"), "price", "pos").select("store_key", "store_name", "name", "price", "available", "url")


def _reasons(offers: DataFrame) -> DataFrame:
    return offers.groupBy("store_key").agg(F.bool_or(is_priced(F.col("price"))).alias("any_priced"))


def reason() -> Column:
    """Why a store has no row, from ok, error and any_priced."""
    return F.when(~F.col("ok"), F.coalesce(F.nullif("error", F.lit("")), F.lit(NO_RESULTS))).when(F.col("any_priced"), NO_MATCH).otherwise(NO_RESULTS)


def unmatched_stores(offers: DataFrame, fetches: DataFrame, matched: DataFrame) -> DataFrame:
    """Stores without a match, with the reason."""
    return fetches.join(matched.select("store_key"), "store_key", "left_anti").join(_reasons(offers), "store_key", "left").select("store_key", "store_name", "store_ord", reason().alias("reason"))


def only_ok(offers: DataFrame, fetches: DataFrame) -> DataFrame:
    return offers.join(fetches.where("ok").select("store_key"), "store_key", "left_semi")


def cli_view(offers: DataFrame, fetches: DataFrame, query: str, plan: QueryPlan | None = None) -> DataFrame:
    """Matches by price, then the other stores in their own order, numbered in line_no."""
    known = tagged(offers, query, plan)
    best = _winners(known.where("_fits AND _priced"), "price", "pos").select("store_key", F.struct("name", "price", (F.col("available") > 0).alias("in_stock")).alias("b"))
    rows = fetches.join(_reasons(known), "store_key", "left").join(best, "store_key", "left").withColumn("b", F.when(F.col("ok"), F.col("b")))
    rows = rows.select("store_key", "store_name", "store_ord", "b.*", F.when(F.col("b").isNull(), reason()).alias("reason"))
    line = F.row_number().over(Window.orderBy(F.col("reason").isNotNull(), F.col("price").asc_nulls_last(), "store_ord"))  # one row for each store
    return rows.withColumn("line_no", line).select("store_key", "store_name", "name", "price", "in_stock", "reason", "line_no")


def item(offers: DataFrame) -> Column:
    """What the views show of an offer; image is null where the offers have none."""
    image = F.col("image") if "image" in offers.columns else F.lit(None).cast("string")
    return F.struct("name", "price", (F.col("available") > 0).alias("available"), "url", image.alias("image"))


def rank_key() -> Column:
    """Available first, then cheap, then early."""
    return F.struct(unavailable().alias("a"), F.coalesce("price", F.lit(FOREVER)).alias("b"), F.col("pos").alias("c"))


def ranked_rows(asked: DataFrame, counts: DataFrame, best: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of asked(*by, store_key, store_name, store_ord, ok, error, any_priced): the store's best priced relevant offer, best(*by, store_key, b), and how many there are, counts(*by, store_key, n_priced, n_all), or why there is none. rank orders the stores (within `by`)."""
    keys = [*by, "store_key"]
    rows = asked.join(counts, keys, "left").join(best, keys, "left")
    good, bare = F.col("ok") & F.coalesce(F.col("n_priced") > 0, F.lit(False)), F.col("ok") & F.coalesce(F.col("n_all") > 0, F.lit(False))
    rows = rows.select(
        *keys, "store_name", "store_ord", good.alias("ok"), F.when(good, F.col("n_priced")).when(bare, F.col("n_all")).alias("count"), F.when(good, F.col("b")).alias("b"),
        F.when(good, None).when(bare, NO_PRICE).otherwise(reason()).alias("error"), F.when(~good & bare, True).alias("found_without_price"),
    )
    order = Window.partitionBy(*by).orderBy(~F.col("ok"), ~F.coalesce("available", F.lit(False)), F.coalesce("price", F.lit(FOREVER)), "store_ord")  # one row for each store
    return rows.select(*keys, "store_name", "store_ord", "ok", "count", "b.name", "b.price", "b.available", "b.url", "b.image", "error", "found_without_price").withColumn("rank", F.row_number().over(order)).drop("store_ord")


def best_per_store(offers: DataFrame, fetches: DataFrame, query: str, plan: QueryPlan | None = None) -> DataFrame:
    """One row for each store asked: its best priced relevant offer and how many there are, or why there is none. rank orders the stores. Counts are of numbers alone, and the best is sought among fitting offers only."""
    known = tagged(offers, query, plan)
    counts = known.groupBy("store_key").agg(F.count_if(F.col("_fits") & F.col("_priced")).alias("n_priced"), F.count_if("_fits").alias("n_all"), F.bool_or("_priced").alias("any_priced"))
    best = _winners(known.where("_fits AND _priced"), rank_key()).select("store_key", item(offers).alias("b"))
    rows = ranked_rows(fetches, counts, best)
    return rows if "image" in offers.columns else rows.drop("image")


def ranks(offers: DataFrame, fetches: DataFrame, query: str, plan: QueryPlan | None = None) -> DataFrame:
    """store_key, ok, rank (among ok rows, by its order alone) of best_per_store, for what shows no offers: one aggregation of numbers, which reads the offers once."""
    known = tagged(offers, query, plan)
    least = lambda stock: F.min(F.when(F.col("_fits") & F.col("_priced") & stock, F.col("price")))
    prices = known.groupBy("store_key").agg(least(F.col("available").isNull()).alias("_unknown"), least(~unavailable()).alias("_in"), least(unavailable()).alias("_out"))
    price = F.coalesce("_unknown", "_in", "_out")  # the order of rank_key
    order = F.struct((F.col("_unknown").isNotNull() | F.col("_in").isNull()).alias("a"), price.alias("b"), F.col("store_ord").alias("c"))
    return fetches.join(prices, "store_key", "left").select("store_key", (F.col("ok") & price.isNotNull()).alias("ok"), order.alias("rank"))


def best_per_page(offers: DataFrame, fetches: DataFrame, queries: DataFrame) -> DataFrame:
    """best_per_store for each of queries(query_id, query[, plan]), in one job: query_id and its rows, one for each store. The offers of all queries are matched at once; the stores asked, a dimension, go to each query as one array."""
    hits = match_table(offers, queries).withColumn("_priced", is_priced(F.col("price")))
    by = ("query_id", "store_key")
    counts = hits.groupBy(*by).agg(F.count_if("_priced").alias("n_priced"), F.count("*").alias("n_all"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(rank_key()))
    best = hits.where("_priced").withColumn("_rank", rank).where("_rank = 1").select(*by, item(offers).alias("b"))
    stores = fetches.join(_reasons(offers), "store_key", "left")
    asked = queries.select("query_id").join(F.broadcast(stores.agg(F.collect_list(F.struct(*stores.columns)).alias("stores")))).select("query_id", F.inline("stores"))  # one row
    return ranked_rows(asked, counts, best, ("query_id",))


def items_of_stores(offers: DataFrame, fetches: DataFrame, query: str, plan: QueryPlan | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """store_key, items: the best priced relevant offers of each store that answered, at most config.items_per_store; of a store without public prices its first relevant ones."""
    shown = tagged(only_ok(offers, fetches), query, plan).where("_fits").select("store_key", "_priced", F.struct(~F.col("_priced"), F.when(F.col("_priced"), unavailable()), F.when(F.col("_priced"), F.col("price")), "pos").alias("_order"), item(offers).alias("item"))
    rank = F.row_number().over(Window.partitionBy("store_key").orderBy("_order"))
    top = shown.withColumn("item_no", rank).where(F.col("item_no") <= config.items_per_store)
    grouped = top.groupBy("store_key").agg(F.array_sort(F.collect_list(F.struct("item_no", "_priced", "item"))).alias("x"))  # items_per_store elements at most
    some = F.exists("x", lambda v: v["_priced"])
    return grouped.select("store_key", F.transform(F.filter("x", lambda v: v["_priced"] | ~some), lambda v: v["item"]).alias("items"))


def store_items(offers: DataFrame, query: str, plan: QueryPlan | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The best items of each store, ranked, at most config.items_per_store of each."""
    rank = F.row_number().over(Window.partitionBy("store_key").orderBy(unavailable(), "price", "pos"))
    return relevant_offers(offers, query, plan).withColumn("item_no", rank).where(F.col("item_no") <= config.items_per_store).select("store_key", "store_name", "item_no", "name", "price", (F.col("available") > 0).alias("available"), "url")


def nested_items(offers: DataFrame, query: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """store_items as one array for each store; at most items_per_store elements."""
    entry = F.struct("item_no", "name", "price", "available", "url")
    sorted_items = F.array_sort(F.collect_list(entry))
    return store_items(offers, query, config=config).groupBy("store_key").agg(F.transform(sorted_items, lambda s: F.struct(s["name"], s["price"], s["available"], s["url"])).alias("items"))


def all_view(items: DataFrame, page: int = 1, config: EngineConfig = DEFAULT) -> DataFrame:
    """All stores' items, available first and cheap first, as far as `page` pages."""
    return items.orderBy(~F.col("available"), "price", "store_key", "item_no").limit(page * config.page_size)


def compare_meta(best: DataFrame) -> DataFrame:
    """Stores with a price, offers found, and the last ok row's price less the first's, where there are two and it is above 0."""
    ok = best.where("ok")
    gap = F.max_by("price", "rank") - F.min_by("price", "rank")
    return ok.agg(F.count("*").alias("stores"), F.sum(F.coalesce(F.nullif("count", F.lit(0)), F.lit(1))).alias("relevant"), F.when((F.count("*") > 1) & (gap > 0), F.round(gap, 2)).alias("saving"))


def cheapest_store(best: DataFrame) -> DataFrame:
    return best.where("ok").agg(F.min_by("store_key", "rank").alias("store_key"))


def batch(offers: DataFrame, queries: list[str]) -> DataFrame:
    """The cheapest match of each query over all stores, of the cheapest offers of the distinct names; queries without a match are left out. For a list of a few queries; many.cheapest takes a table of them."""
    best = best_of_names(offers.where(is_priced(F.col("price"))).select("name", "store_key", "store_name", "price", "pos"), "store_key", "pos")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("price", "store_key", "pos"))
    return match_queries(best, queries).withColumn("_rank", rank).where("_rank = 1").select("query_id", "query", "store_key", "store_name", "price")


def batch_total(items: DataFrame) -> DataFrame:
    """The batch's rows(query_id, query, store_name, price), and their sum as the row `TOTAL`; items are read once."""
    summed = items.rollup("query_id").agg(F.first("query").alias("query"), F.first("store_name").alias("store_name"), F.sum("price").alias("price"), F.grouping("query_id").alias("all"))
    total = F.col("all") == 1
    return summed.select(F.when(total, "TOTAL").otherwise(F.col("query")).alias("query"), F.when(~total, F.col("store_name")).alias("store_name"), F.when(total, F.round("price", 2)).otherwise(F.col("price")).alias("price"))


def api_response(query: str, best: DataFrame, items: DataFrame | None = None, canonical: str | None = None, planner: str = "local") -> DataFrame:
    """The search answer as one row: query, normalized_query, planner, its results in order (one for each store asked), and the cheapest store."""
    fields = [c for c in ("rank", "store_key", "store_name", "ok", "count", "name", "price", "available", "url", "image", "error", "found_without_price") if c in best.columns]
    if items is not None:  # one row for each store on both sides
        best, fields = best.join(items, "store_key", "left"), [*fields, "items"]
    answer = best.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"), F.min_by("store_key", F.when(F.col("ok"), F.col("rank"))).alias("cheapest"))
    return answer.select(F.lit(query).alias("query"), F.lit(query if canonical is None else canonical).alias("normalized_query"), F.lit(planner).alias("planner"), F.to_json("results", {"ignoreNullFields": "false"}).alias("results"), "cheapest")


def log_row(query: str, store: str | None, best: DataFrame, ts: int) -> DataFrame:
    """One row of the search log: ts, query, store, stores_with_price, cheapest."""
    found = best.agg(F.count_if("ok").alias("stores_with_price"), F.min_by("store_key", F.when(F.col("ok"), F.col("rank"))).alias("cheapest"))
    return found.select(F.lit(ts).cast("long").alias("ts"), F.lit(query).alias("query"), F.lit(store).cast("string").alias("store"), "stores_with_price", "cheapest")


def list_items(best: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """The first ok rows as positions of a ranked list."""
    first = best.where("ok").orderBy("rank").limit(config.list_items)
    stock = F.when(F.col("available"), "InStock").otherwise("OutOfStock")
    shown = [c for c in ("store_name", "image") if c in best.columns]
    return first.select(F.row_number().over(Window.orderBy("rank")).alias("position"), "store_key", *shown, "name", "price", stock.alias("availability"), "url")
