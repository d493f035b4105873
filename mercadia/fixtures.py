"""Views over the test tables in the shape of the comparison's inputs, and the same in portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCHES_SQL = """fetches AS (
  SELECT s_suppkey AS store_key, s_name AS store_name, s_suppkey AS store_ord, s_acctbal >= 0 AS ok,
         CASE WHEN s_acctbal >= 0 THEN NULL ELSE 'timeout' END AS error FROM supplier)"""
OFFERS_SQL = """offers AS (
  SELECT l_suppkey AS store_key, s_name AS store_name, concat_ws(' ', p_brand, p_name, p_type, CAST(p_size AS VARCHAR)) AS name,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price,
         CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS available,
         concat('/p/', CAST(l_partkey AS VARCHAR)) AS url,
         (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS pos
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
DUP_SQL = """offers_dup AS (
  SELECT l_suppkey AS store_key, l_linenumber AS alias_ord, l_orderkey, l_partkey, p_name AS name,
         CASE WHEN l_linenumber = 1 THEN '' ELSE concat('/P/', p_name) END AS url,
         CASE WHEN l_linenumber = 2 THEN CAST(0 AS DOUBLE) WHEN l_linenumber = 3 THEN NULL
              ELSE CAST(floor(l_extendedprice / 10000) * 10000 AS DOUBLE) END AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
SEARCHES_SQL = """searches AS (
  SELECT event_id, ts, user_id AS client, concat('  ', upper(event_type), '   ', CAST(user_id % 7 AS VARCHAR), ' ') AS query FROM events)"""


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fetches(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("s_acctbal") >= 0
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("store_key"), F.col("s_name").alias("store_name"), F.col("s_suppkey").alias("store_ord"), ok.alias("ok"), F.when(~ok, "timeout").alias("error"))


def offers(spark: SparkSession, d: str) -> DataFrame:
    """One offer for each lineitem; the joins are left to Spark, which broadcasts what its threshold allows."""
    part, supplier = _t(spark, d, "part"), _t(spark, d, "supplier").select("s_suppkey", "s_name")
    line = _t(spark, d, "lineitem")
    joined = line.join(part, line["l_partkey"] == part["p_partkey"]).join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.select(
        F.col("l_suppkey").alias("store_key"), F.col("s_name").alias("store_name"), F.concat_ws(" ", "p_brand", "p_name", "p_type", F.col("p_size").cast("string")).alias("name"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), None).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity").cast("int")).otherwise(0).alias("available"),
        F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("url"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate").alias("pos"),
    )


def offers_dup(spark: SparkSession, d: str) -> DataFrame:
    part, line = _t(spark, d, "part").select("p_partkey", "p_name"), _t(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("l_suppkey").alias("store_key"), n.alias("alias_ord"), "l_orderkey", "l_partkey", F.col("p_name").alias("name"), F.when(n == 1, "").otherwise(F.concat(F.lit("/P/"), "p_name")).alias("url"),
        F.when(n == 2, 0.0).when(n == 3, None).otherwise((F.floor(F.col("l_extendedprice") / 10000) * 10000).cast("double")).alias("price"),
    )


def searches(spark: SparkSession, d: str) -> DataFrame:
    query = F.concat(F.lit("  "), F.upper("event_type"), F.lit("   "), (F.col("user_id") % 7).cast("string"), F.lit(" "))
    return _t(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("client"), query.alias("query"))


#: What drawn queries are made of; "de" and "para" are no content.
FIRST = ["red", "rojo", "blue", "azul", "small", "large", "old", "hot", "de", "new", "brand"]
SECOND = ["widget", "gizmo", "bolt", "ring", "plate", "anvil", "soporte", "para", "wid"]
DRAWN_SQL = f"""drawn AS (
  SELECT DISTINCT concat_ws(' ', {FIRST}[user_id % {len(FIRST)} + 1], {SECOND}[CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % {len(SECOND)} + 1],
    CASE WHEN event_type IN ('click', 'error') THEN CAST(CAST(floor(value) AS INTEGER) % 50 AS VARCHAR) END) AS query FROM events)"""


def drawn_queries(spark: SparkSession, d: str) -> DataFrame:
    """query_id, query: two words and, of some kinds of events, a number; each text once."""
    word = lambda pool, k: F.element_at(F.array(*map(F.lit, pool)), (k % len(pool) + 1).cast("int"))
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    number = F.when(F.col("event_type").isin("click", "error"), (F.floor("value").cast("int") % 50).cast("string"))
    text = F.concat_ws(" ", word(FIRST, F.col("user_id")), word(SECOND, k), number)
    return _t(spark, d, "events").select(text.alias("query")).distinct().select(F.col("query").alias("query_id"), "query")


PLAN_TTL_S = 3 * 86_400
#: Plans cached for the searches' texts: of every 11th event one that ends as it is asked, of every 17th one written right after it; some are no objects.
CACHED_PLANS_SQL = f"""asked AS (SELECT *, epoch_us(ts) AS t, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS clean FROM searches),
cached AS (
  SELECT lower(clean) AS key, t - {PLAN_TTL_S * 10**6} AS t, event_id * 2 AS id, event_id AS e FROM asked WHERE event_id % 11 = 0
  UNION ALL SELECT lower(clean), t + 1, event_id * 2 + 1, event_id FROM asked WHERE event_id % 17 = 0)"""


def timed_searches(spark: SparkSession, d: str) -> DataFrame:
    return searches(spark, d).select("event_id", "query", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def cached_plans(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    plan = F.to_json(F.struct(F.concat(F.lit("plan "), e.cast("string")).alias("canonical_query"), F.array(F.concat(F.lit(" Extra  "), (e % 9).cast("string"))).alias("search_queries"), F.lit("data").alias("source")))
    body = F.when(e % 5 == 0, "[1]").when(e % 7 == 0, "{broken").otherwise(plan)
    asked = timed_searches(spark, d)
    ends = asked.where(e % 11 == 0).select(F.upper("query").alias("query"), (F.col("t") - PLAN_TTL_S * 10**6).alias("t"), (e * 2).alias("id"), body.alias("body"))
    return ends.unionByName(asked.where(e % 17 == 0).select("query", (F.col("t") + 1).alias("t"), (e * 2 + 1).alias("id"), body.alias("body")))


#: Requests and timed landings from events: two stores, six texts of two words and their first word; some landings fail, some are empty.
TIMED_SQL = """requests AS (SELECT user_id % 2 AS store, user_id % 6 AS k, epoch_us(ts) AS t, event_id AS id FROM events),
timed AS (
  SELECT value_cents % 2 AS store, CASE WHEN event_id % 4 = 0 THEN -1 ELSE value_cents % 6 END AS k, t, event_id AS id, event_id % 7 <> 0 AS ok, event_id % 5 = 0 AS bare
  FROM (SELECT event_id, epoch_us(ts) - 500000 AS t, CAST(round(value * 100) AS BIGINT) AS value_cents FROM events) WHERE event_id % 3 = 0)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id")
    return _t(spark, d, "events").select((user % 2).cast("string").alias("store_key"), F.concat(F.lit("item "), (user % 6).cast("string")).alias("text"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("id"))


def timed_landings(spark: SparkSession, d: str) -> DataFrame:
    e, cents = F.col("event_id"), F.round(F.col("value") * 100).cast("long")
    text = F.when(e % 4 == 0, "item").otherwise(F.concat(F.lit("item "), (cents % 6).cast("string")))
    ok = e % 7 != 0
    rows = _t(spark, d, "events").where(e % 3 == 0)
    return rows.select(
        (cents % 2).cast("string").alias("store_key"), text.alias("text"), (F.unix_micros(F.col("ts").cast("timestamp")) - 500_000).alias("t"), e.alias("id"), ok.alias("ok"), F.when(~ok, F.concat(F.lit("e"), e.cast("string"))).alias("error"),
        F.when(e % 5 == 0, "[]").otherwise(F.concat(F.lit('[{"productName":"'), e.cast("string"), F.lit('"}]'))).alias("body"),
    )


#: A page for each nation; the query is of two words of the pools.
PAGES_SQL = f"""pages_ AS (
  SELECT lower(n_name) AS slug, {FIRST}[n_nationkey % {len(FIRST)} + 1] || ' ' || {SECOND}[n_nationkey % {len(SECOND)} + 1] AS query, 'Precios ' || n_name AS h1, 'Ofertas "' || n_name || '"' AS description FROM nation)"""


def comparison_pages(spark: SparkSession, d: str) -> DataFrame:
    word = lambda pool: F.element_at(F.array(*map(F.lit, pool)), (F.col("n_nationkey") % len(pool) + 1).cast("int"))
    return _t(spark, d, "nation").select(
        F.lower("n_name").alias("slug"), F.concat_ws(" ", word(FIRST), word(SECOND)).alias("query"), F.col("n_name").alias("title"), F.concat(F.lit("Precios "), "n_name").alias("h1"), F.concat(F.lit('Ofertas "'), "n_name", F.lit('"')).alias("description")
    )


#: Texts asked for, the first of which finds nothing at every fifth store and is asked again as its first word.
TEXTS = ["widget rojo", "red widget", "widget"]
LANDED_SQL = """texts AS (SELECT * FROM (VALUES (0, 'widget rojo'), (1, 'red widget'), (2, 'widget')) v(k, text)),
grid AS (
  SELECT s_suppkey AS s, s_name AS store_name, s_suppkey % 2 AS odd, k, (s_suppkey + k) % 4 <> 0 AS ok0, k = 0 AND s_suppkey % 5 = 0 AS bare FROM supplier, texts),
fetched AS (
  SELECT *, CASE WHEN ok0 AND bare THEN (s + 2) % 4 <> 0 ELSE ok0 END AS ok, concat('e', CASE WHEN ok0 AND bare THEN 2 ELSE k END) AS error, CASE WHEN bare THEN 2 ELSE k END AS body FROM grid),
landed_offers AS (
  SELECT f.s, f.store_name, f.k, concat_ws(' ', p_brand, p_name, p_type, CAST(p_size AS VARCHAR)) AS name,
         CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN NULL ELSE round(l_extendedprice, 2) END AS price,
         CASE WHEN l_linestatus <> 'O' THEN 0 WHEN f.odd = 1 THEN 1 ELSE CAST(l_quantity AS INTEGER) END AS available,
         concat('https://shop/', CAST(l_partkey AS VARCHAR)) AS url, CASE WHEN f.odd = 1 THEN NULL ELSE 'i' || l_partkey END AS image,
         row_number() OVER (PARTITION BY f.s, f.k ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS pos
  FROM fetched f JOIN lineitem ON l_suppkey = f.s AND l_linenumber % 3 IN (f.body, 0) JOIN part ON l_partkey = p_partkey WHERE f.ok AND l_suppkey = f.s)"""


def landings(spark: SparkSession, d: str) -> DataFrame:
    """What each supplier, as a store, answered to TEXTS: JSON listings of even keys, product grids of odd ones."""
    part, line = _t(spark, d, "part"), _t(spark, d, "lineitem")
    name = F.concat_ws(" ", "p_brand", "p_name", "p_type", F.col("p_size").cast("string"))
    hidden = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)
    # a line goes to its store once, as numbers and a name; the markup is made there
    row = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate", hidden.alias("hidden"), (F.col("l_linestatus") == "O").alias("open"), "name")
    lines = line.join(part.select("p_partkey", name.alias("name")), line["l_partkey"] == part["p_partkey"]).select("l_suppkey", row.alias("x"))
    of_store = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_list("x")).alias("x"))  # a fixture: a store's listing is one payload

    price = lambda x: F.when(x["hidden"], None).otherwise(F.round(x["l_extendedprice"], 2))
    stock = lambda x: F.when(x["open"], x["l_quantity"].cast("int")).otherwise(0)
    key = lambda x: x["l_partkey"].cast("string")
    url = lambda x: F.concat(F.lit("https://shop/"), key(x))

    def listed(x):
        offer = F.struct(price(x).alias("Price"), stock(x).alias("AvailableQuantity"))
        unit = F.struct(F.array(F.struct(F.concat(F.lit("i"), key(x)).alias("imageUrl"))).alias("images"), F.array(F.struct(offer.alias("commertialOffer"))).alias("sellers"))
        return F.to_json(F.struct(x["name"].alias("productName"), url(x).alias("link"), F.array(unit).alias("items")))

    def shown(x):
        return F.concat(
            F.lit('<div class="product-item-info"><a class="product-item-link" href="'), url(x), F.lit('">'), x["name"], F.lit("</a>"),
            F.coalesce(F.concat(F.lit('<i data-price-amount="'), price(x).cast("decimal(18,2)").cast("string"), F.lit('"></i>')), F.lit("")), F.when(stock(x) == 0, "Agotado").otherwise(""), F.lit("</div>"),
        )

    s = F.col("s_suppkey")
    even = s % 2 == 0
    # the markup of a line is made once, for all the texts whose answers it is in
    made = lambda x: F.struct((x["l_linenumber"] % 3).alias("third"), F.when(even, listed(x)).otherwise(shown(x)).alias("text"))
    joined = _t(spark, d, "supplier").select("s_suppkey").join(of_store, s == F.col("l_suppkey"), "left").select("s_suppkey", F.coalesce(F.transform("x", made), F.array().cast("array<struct<third:int,text:string>>")).alias("x"))

    def answer(k: int, text: str):
        ok = (s + k) % 4 != 0
        mine = lambda x: x["third"].isin(0, k)
        kept = F.transform(F.filter("x", (lambda x: mine(x) & (s % 5 != 0)) if k == 0 else mine), lambda x: x["text"])
        body = F.when(even, F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]"))).otherwise(F.array_join(kept, "\n"))
        return F.struct(F.lit(text).alias("text"), ok.alias("ok"), F.when(~ok, f"e{k}").alias("error"), F.when(ok, body).alias("body"))

    return joined.select(s.cast("string").alias("store_key"), F.inline(F.array(*[answer(k, t) for k, t in enumerate(TEXTS)])))


def stores(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier as a store; those in debt are switched off."""
    s = _t(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"), F.lit("shop.example").alias("domain"), F.when(F.col("s_suppkey") % 2 == 0, "vtex").otherwise("magento").alias("kind"),
        (F.col("s_acctbal") >= 0).alias("enabled"), F.lit(None).cast("string").alias("search_path"), F.col("s_suppkey").cast("int").alias("store_ord"),
    )
