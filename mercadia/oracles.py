"""DuckDB SQL for the named queries, written from the operators' descriptions. Queries over small made-up inputs have their expected rows instead."""

from __future__ import annotations

import json

from mercadia import samples
from mercadia.fixtures import CACHED_PLANS_SQL, DRAWN_SQL, DUP_SQL, FETCHES_SQL, LANDED_SQL, OFFERS_SQL, PAGES_SQL, PLAN_TTL_S, SEARCHES_SQL, TIMED_SQL
from mercadia.lexicon import ACCESSORIES, STOPWORDS, SYNONYMS


def _text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _values(columns: dict[str, str], rows: list[tuple]) -> str:
    """A query that gives the rows as they stand; columns: name to type."""
    body = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST(c{k} AS {t}) AS {n}" for k, (n, t) in enumerate(columns.items())) + f" FROM (VALUES {body}) v({', '.join(f'c{k}' for k in range(len(columns)))})"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


STRIP = "strip_accents(lower(coalesce({}, '')))"
TOKENS = "regexp_extract_all(" + STRIP + ", '[a-z0-9]+')"
NAME = "concat_ws(' ', p_brand, p_name, p_type, CAST(p_size AS VARCHAR))"
ACCESSORY = f"list_has_any(toks, {_list(ACCESSORIES)})"
RED, BLUE = ["rojo", "roja", "red"], ["azul", "blue"]


def _word(word: str, group: list[str] | None = None) -> str:
    """A name's tokens hold the word or a synonym, or its text holds one of five letters or more."""
    group = group or [word]
    return "(" + " OR ".join([f"list_has_any(toks, {_list(group)})", *(f"contains(norm, '{g}')" for g in group if len(g) >= 5)]) + ")"


def _number(n: str) -> str:
    return f"(regexp_matches(norm, '(^|[^0-9]){n}([^0-9]|$)') AND NOT regexp_matches(norm, '(^|[^0-9]){n} ?(ml|g|gr|kg|mg|mah|w|watts?|v|hz|cc)([^a-z0-9_]|$)'))"


WIDGET = f"(NOT {ACCESSORY} AND {_word('widget')} AND {_word('rojo', RED)})"
MATCHES = [
    WIDGET, f"(NOT {ACCESSORY} AND {_word('anvil')} AND {_word('azul', BLUE)})", f"(NOT {ACCESSORY} AND {_word('ring')} AND {_number('28')})",
    f"(NOT {ACCESSORY} AND {_word('brand')} AND {_number('17')})", f"(NOT {ACCESSORY} AND {_word('plat')})", f"(NOT {ACCESSORY} AND {_word('gizmo')})", f"(NOT {ACCESSORY} AND {_word('plate')})", "TRUE",
]
NAMED = f"named AS (SELECT *, {STRIP.format('name')} AS norm, {TOKENS.format('name')} AS toks FROM offers)"
PARTS = f"parts AS (SELECT p_partkey, p_name, p_retailprice, {NAME} AS name FROM part), named AS (SELECT *, {STRIP.format('name')} AS norm, {TOKENS.format('name')} AS toks FROM parts)"
FOUND = f"WITH {FETCHES_SQL}, {OFFERS_SQL}, {NAMED}, hit AS (SELECT * FROM named WHERE {WIDGET}), priced AS (SELECT * FROM hit WHERE price > 0)"
OK_ONLY = ", good AS (SELECT h.* FROM hit h JOIN fetches f USING (store_key) WHERE f.ok), goodp AS (SELECT * FROM good WHERE price > 0)"
BEST = (
    FOUND
    + OK_ONLY
    + """, top AS (SELECT *, row_number() OVER (PARTITION BY store_key ORDER BY (available <= 0), price, pos) AS r, count(*) OVER (PARTITION BY store_key) AS n FROM goodp),
bare AS (SELECT store_key, count(*) AS n_all FROM good GROUP BY store_key),
anyp AS (SELECT store_key, bool_or(coalesce(price > 0, FALSE)) AS p FROM offers GROUP BY store_key),
best0 AS (
  SELECT f.store_key, f.store_name, f.store_ord, t.store_key IS NOT NULL AS ok, coalesce(t.n, b.n_all) AS count, t.name, t.price,
         CASE WHEN t.store_key IS NOT NULL THEN t.available > 0 END AS available, t.url,
         CASE WHEN t.store_key IS NOT NULL THEN NULL WHEN b.n_all > 0 THEN 'productos encontrados sin precio público'
              WHEN NOT f.ok THEN coalesce(nullif(f.error, ''), 'sin resultados') WHEN a.p THEN 'sin coincidencia para tu búsqueda' ELSE 'sin resultados' END AS error,
         CASE WHEN t.store_key IS NULL AND b.n_all > 0 THEN TRUE END AS found_without_price
  FROM fetches f LEFT JOIN (SELECT * FROM top WHERE r = 1) t USING (store_key) LEFT JOIN bare b USING (store_key) LEFT JOIN anyp a USING (store_key)),
best AS (SELECT store_key, store_name, ok, count, name, price, available, url, error, found_without_price,
         CAST(row_number() OVER (ORDER BY NOT ok, NOT coalesce(available, FALSE), coalesce(price, 'inf'::DOUBLE), store_ord) AS INTEGER) AS rank FROM best0)
"""
)
CHEAPEST = ", m AS (SELECT store_key, store_name, name, price, available, url, row_number() OVER (PARTITION BY store_key ORDER BY price, pos) AS r FROM {0})"
REASON = "CASE WHEN NOT f.ok THEN coalesce(nullif(f.error, ''), 'sin resultados') WHEN a.p THEN 'sin coincidencia para tu búsqueda' ELSE 'sin resultados' END"
ANY_PRICED = ", anyp AS (SELECT store_key, bool_or(coalesce(price > 0, FALSE)) AS p FROM offers GROUP BY store_key)"
ITEMS = FOUND + ", items AS (SELECT store_key, store_name, CAST(row_number() OVER (PARTITION BY store_key ORDER BY (available <= 0), price, pos) AS INTEGER) AS item_no, name, price, available > 0 AS available, url FROM priced)"
DEDUPE = "row_number() OVER (PARTITION BY store_key, CASE WHEN coalesce(url, '') <> '' THEN lower(trim(url)) ELSE lower(trim(name)) END, coalesce(price, 0) ORDER BY alias_ord, l_orderkey, l_partkey, url)"
HITS = f"WITH {SEARCHES_SQL}, hits AS (SELECT client, epoch_us(ts) / 1e6 AS t, event_id AS id FROM searches)"
COLLAPSE = "trim(regexp_replace(lower(query), '\\s+', ' ', 'g'))"
HTML = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ntilde;", "ñ"), ("&amp;", "&")]


def _replaced(text: str, pairs) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def _digest(toks: str) -> str:
    return f"SELECT doc_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {toks} AS w FROM documents)"


def _dealt(table: str, id_: str, n: int, columns: dict[str, str], rows: list[tuple]) -> str:
    """The rows of a table, each with those of the given rows (k, ...) whose k is its id modulo n."""
    given = _values({"_k": "INTEGER"} | columns, rows)
    return f"SELECT {id_}, {', '.join(columns)} FROM {table} JOIN ({given}) ON {id_} % {n} = _k"


_OFFER = {"name": "VARCHAR", "price": "DOUBLE", "available": "INTEGER", "url": "VARCHAR", "image": "VARCHAR"}
_OWN = "replace(replace(url, 'https://shop.example', 'https://' || s_suppkey || '.shop.example'), 'https://u', 'https://u' || s_suppkey) AS url"


def _offer(kind: str) -> str:
    return f"SELECT CAST(s_suppkey AS VARCHAR) AS store_key, name, price, available, {_OWN}, image FROM supplier CROSS JOIN ({_values(_OFFER, samples.PARSED[kind])})"


#: A walk over requests(key, t, id, ok) in order, with the last entry's id and time; one recursion a key.
WALK = """o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS n FROM r),
walk AS (
  SELECT key, id, n, t, ok, FALSE AS hit, CASE WHEN ok THEN id END AS e, CASE WHEN ok THEN t END AS w FROM o WHERE n = 1
  UNION ALL
  SELECT o.key, o.id, o.n, o.t, o.ok, coalesce(o.t - w.w <= {ttl}, FALSE), CASE WHEN coalesce(o.t - w.w <= {ttl}, FALSE) THEN w.e WHEN o.ok THEN o.id END,
         CASE WHEN coalesce(o.t - w.w <= {ttl}, FALSE) THEN w.w WHEN o.ok THEN o.t END FROM walk w JOIN o ON o.key = w.key AND o.n = w.n + 1)"""
_IS_PRICED = "coalesce(price > 0, FALSE)"
SEARCHED = (
    f"""WITH {LANDED_SQL}, shops AS (SELECT s_suppkey AS s, s_name AS store_name FROM supplier WHERE s_acctbal >= 0 {{where}}),
once AS (
  SELECT *, CAST(s AS VARCHAR) AS store_key FROM (SELECT *, row_number() OVER (PARTITION BY s, lower(url), coalesce(price, 0) ORDER BY k, pos) AS r FROM landed_offers WHERE s IN (SELECT s FROM shops)) WHERE r = 1),
status AS (SELECT s, bool_or(ok) AS ok, CASE WHEN NOT bool_or(ok) THEN arg_min(error, k) END AS error FROM fetched GROUP BY s),
named AS (SELECT *, {STRIP.format('name')} AS norm, {TOKENS.format('name')} AS toks FROM once),
hit AS (SELECT * FROM named WHERE {WIDGET}), priced AS (SELECT * FROM hit WHERE price > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_IS_PRICED} DESC, CASE WHEN {_IS_PRICED} THEN available <= 0 END, CASE WHEN {_IS_PRICED} THEN price END, k, pos) AS n,
         count(*) FILTER (price > 0) OVER (PARTITION BY s) AS n_priced, count(*) OVER (PARTITION BY s) AS n_all FROM hit),
items AS (
  SELECT s, any_value(n_priced) AS n_priced, any_value(n_all) AS n_all,
         '[' || string_agg('{{{{"name":"' || name || '"' || coalesce(',"price":' || CAST(price AS VARCHAR), '') || ',"available":' || (available > 0) || ',"url":"' || url || '"' || coalesce(',"image":"' || image || '"', '') || '}}}}', ',' ORDER BY n) || ']' AS items,
         count(*) AS n_items FROM ranked WHERE n <= 24 AND ({_IS_PRICED} OR n_priced = 0) GROUP BY s),
anyp AS (SELECT s, bool_or({_IS_PRICED}) AS p FROM once GROUP BY s),
best0 AS (
  SELECT h.s, CAST(h.s AS VARCHAR) AS store_key, h.store_name, f.ok AND coalesce(i.n_priced, 0) > 0 AS ok, CASE WHEN i.n_priced > 0 THEN i.n_priced ELSE i.n_all END AS count, t.name, t.price, t.available > 0 AS available, t.url, t.image,
         CASE WHEN i.n_priced > 0 THEN NULL WHEN i.n_all > 0 THEN 'productos encontrados sin precio público' WHEN NOT f.ok THEN coalesce(nullif(f.error, ''), 'sin resultados') WHEN a.p THEN 'sin coincidencia para tu búsqueda' ELSE 'sin resultados' END AS error,
         CASE WHEN coalesce(i.n_priced, 0) = 0 AND i.n_all > 0 THEN TRUE END AS found_without_price, i.items, i.n_items
  FROM shops h JOIN status f USING (s) LEFT JOIN items i USING (s) LEFT JOIN (SELECT * FROM ranked WHERE n = 1 AND price > 0) t USING (s) LEFT JOIN anyp a USING (s)),
best AS (SELECT *, CAST(row_number() OVER (ORDER BY NOT ok, NOT coalesce(available, FALSE), coalesce(price, 'inf'::DOUBLE), s) AS INTEGER) AS rank FROM best0)
"""
)
ALL_STORES = SEARCHED.format(where="")
CHEAPEST_HIT = ", m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY price, k, pos) AS c FROM priced) WHERE c = 1)"

_PLANS = [
    {"original_query": "tenis nike", "canonical_query": "tenis nike", "search_queries": ["Zapatos Nike", "TENIS NIKE"], "required_any_groups": [["tenis"]], "exclude_terms": [], "confidence": 1.0, "source": "local"},
    {"original_query": "tenis nike", "canonical_query": "nike", "search_queries": ["a", "b", "c", "d", "e", "f", "g", "h"], "required_any_groups": [], "exclude_terms": [], "confidence": 0.0, "source": "data"},
]

ORACLES: dict[str, str] = {
    "text_normalize": f"SELECT doc_id, {STRIP.format('text')} AS norm FROM documents",
    "text_tokens": _digest(TOKENS.format("text")),
    "content_tokens": _digest(f"list_filter({TOKENS.format('text')}, lambda x: NOT list_contains({_list(STOPWORDS)}, x))"),
    "synonym_expand": f"WITH {PARTS}, t AS (SELECT p_partkey, unnest(list_distinct(toks)) AS token FROM named), "
    + f"s(token, syn) AS (VALUES {', '.join(f'({_text(t)}, {_text(",".join(sorted(g)))})' for g in SYNONYMS for t in g)}) SELECT p_partkey, t.token, coalesce(syn, t.token) AS synonyms FROM t LEFT JOIN s ON t.token = s.token",
    "price_parse": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE round(l_extendedprice, 2) END AS price FROM lineitem",
    "price_cents_rule": "SELECT p_partkey, round(p_retailprice * 100, 2) AS off, round(CASE WHEN p_retailprice * 100 > 100000 THEN p_retailprice * 100 / 100 ELSE p_retailprice * 100 END, 2) AS with_rule FROM part",
    "price_minor_units": "SELECT p_partkey, round(round(p_retailprice * 100) / pow(10.0, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 THEN 2 ELSE p_partkey % 4 END), 2) AS price FROM part",
    "stock_flag": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag IN ('R', 'A') THEN 0 ELSE 1 END AS flag FROM lineitem",
    "html_text": f"SELECT page_id, {HTML.format(_replaced("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')", _ENTITIES))} AS text FROM pages",
    "html_text_full": f"SELECT page_id, trim({HTML.format(_replaced("regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')", _ENTITIES))} || ' ñññ …≂̸< b>') AS text FROM pages",
    "html_chunks": """SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(chunk, 'href="([^"]+)"', 1) AS href, regexp_extract(chunk, '>([^<]*)</a>', 1) AS label
        FROM (SELECT page_id, unnest(c) AS chunk, unnest(range(len(c))) AS pos FROM (SELECT page_id, regexp_split_to_array(html, '(?i)<li><a') AS c FROM pages)) WHERE pos > 0""",
    "html_escape": "SELECT page_id, md5(" + _replaced("html", [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")]) + ") AS digest FROM pages",
    "money_format": f"WITH {OFFERS_SQL} SELECT store_key, url, price, coalesce('Q' || format('{{:,.2f}}', price), 'N/D') AS web, coalesce('Q' || format('{{:,.2f}}', price), '—') AS cli FROM offers",
    "url_encode": "SELECT p_partkey, url_encode(p_name || '/ñ&=?+*~' || p_brand) AS strict, replace(url_encode(p_name || '/ñ&=?+*~' || p_brand), '%2F', '/') AS with_slash FROM part",
    "ws_collapse": f"WITH {SEARCHES_SQL} SELECT event_id, {HTML.format('query')} AS query FROM searches",
    "plan_clamp": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(1.0, (p_retailprice - 1000) / 500)) END AS confidence FROM part",
    "cache_path": f"WITH {SEARCHES_SQL}, k AS (SELECT event_id, CAST(client AS VARCHAR) || '::' || lower(trim(query)) AS key FROM searches) SELECT event_id, key, substr(sha256(key), 1, 32) || '.json' AS file FROM k",
    "client_key": "SELECT event_id, CASE user_id % 5 WHEN 0 THEN '10.0.0.' || user_id WHEN 2 THEN '' WHEN 3 THEN '10.1.' || user_id ELSE CASE WHEN event_id % 4 = 0 THEN 'unknown' ELSE 'h' || user_id END END AS client FROM events",
    "relevance_match": f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT {k} AS query_id, p_partkey FROM named WHERE {m}" for k, m in enumerate(MATCHES)),
    "relevance_many": f"""WITH {PARTS}, {DRAWN_SQL}, asked AS (SELECT query, list_filter({TOKENS.format('query')}, lambda x: NOT list_contains({_list(STOPWORDS)}, x)) AS w FROM drawn),
        wanted AS (SELECT query, w, list_has_any(w, {_list(ACCESSORIES)}) AS asks, list_transform(w, lambda x: CASE WHEN list_contains({_list(RED)}, x) THEN {_list(RED)} WHEN list_contains({_list(BLUE)}, x) THEN {_list(BLUE)} ELSE [x] END) AS g FROM asked),
        known AS (SELECT p_partkey, norm, toks, regexp_extract_all(norm, '[0-9]+') AS nums, {ACCESSORY} AS accessory FROM named)
        SELECT query, p_partkey FROM wanted, known WHERE len(w) = 0 OR (asks OR NOT accessory) AND len(list_filter(g, lambda x: NOT CASE WHEN regexp_full_match(x[1], '[0-9]+') THEN list_contains(nums, x[1])
          ELSE list_has_any(toks, x) OR len(list_filter(x, lambda y: length(y) >= 5 AND contains(norm, y))) > 0 END)) = 0""",
    "relevance_accessory": "SELECT p_partkey, p_partkey % 3 IN (0, 1) AS accessory FROM part",
    "relevance_para": "SELECT p_partkey, regexp_matches(p_name, '^(red|blue)') AS for_product FROM part",
    "relevance_plan": f"WITH {PARTS} SELECT p_partkey FROM named WHERE NOT {_word('small')} AND NOT {ACCESSORY} AND (({_word('widget')} AND {_word('rojo', RED)}) OR ({_word('gizmo')} AND {_word('azul', BLUE)}))",
    "relevance_golden": _dealt("part", "p_partkey", len(samples.RELEVANCE), {"fits": "BOOLEAN"}, [(k, v) for k, (_, _, v) in enumerate(samples.RELEVANCE)]),
    "relevant_offers": FOUND + " SELECT store_key, name, price, available, url FROM priced",
    "search_aliases": _dealt("events", "event_id", len(samples.ALIASES), {"alias_ord": "INTEGER", "text": "VARCHAR"}, [(k, n, t) for k, q in enumerate(samples.ALIASES) for n, t in enumerate(samples.SEARCHED[q])]),
    "query_variants": _dealt("events", "event_id", len(samples.ALIASES), {"variant": "INTEGER", "text": "VARCHAR"}, [(k, n, t) for k, q in enumerate(samples.ALIASES) for n, t in enumerate(samples.VARIANTS[q])]),
    "plan_sanitize": _dealt("events", "event_id", len(_PLANS), {"plan": "VARCHAR"}, [(k, json.dumps(p, separators=(",", ":"))) for k, p in enumerate(_PLANS)]),
    "plan_merge": _dealt("events", "event_id", len(samples.MERGED), {"n": "INTEGER", "text": "VARCHAR"}, [(k, n, t) for k, m in enumerate(samples.MERGED) for n, t in enumerate(m)]),
    "plan_extract": _dealt("events", "event_id", len(samples.EXTRACTED), {"text": "VARCHAR"}, list(enumerate(samples.EXTRACTED))),
    "src_vtex": _offer("vtex"), "src_magento": _offer("magento"), "src_kemik": _offer("kemik"), "src_pricesmart": _offer("pricesmart"),
    "src_intelaf": _offer("intelaf"), "src_novex": _offer("novex"), "src_woocommerce": _offer("woocommerce"), "src_max": _offer("max_constructor"),
    "offers_union": f"SELECT kind, CAST(s_suppkey AS VARCHAR) AS store_key, name, price, available, {_OWN} FROM supplier CROSS JOIN ({_values({'kind': 'VARCHAR'} | _OFFER, [(k, *r) for k, rows in samples.PARSED.items() for r in rows])})",
    "stores_enabled": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier WHERE s_acctbal >= 0",
    "stores_only": "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, s_acctbal >= 0 AS enabled FROM supplier WHERE s_suppkey = 7",
    "config_merge": """WITH u AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, 'd' || s_suppkey % 3 AS domain, CASE s_suppkey % 4 WHEN 0 THEN 'kemik' WHEN 1 THEN 'vtex' END AS kind, s_acctbal >= 0 AS enabled FROM supplier),
        d AS (SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, 'd' || c_custkey % 2 AS domain FROM customer),
        j AS (SELECT u.*, d.name AS dn, d.domain AS dd, coalesce(u.domain = d.domain AND coalesce(u.kind, 'vtex') = 'vtex' AND NOT u.enabled, FALSE) AS old FROM u LEFT JOIN d USING (key))
        SELECT key, CASE WHEN old THEN dn ELSE name END AS name, CASE WHEN old THEN dd ELSE domain END AS domain, CASE WHEN old THEN 'max_constructor' ELSE kind END AS kind, enabled OR old AS enabled FROM j
        UNION ALL SELECT key, name, domain, 'max_constructor', TRUE FROM d WHERE key NOT IN (SELECT key FROM u)""",
    "batch_items": "SELECT doc_id, CAST(line AS INTEGER) AS line, value FROM (SELECT doc_id, unnest(range(len(l))) AS line, trim(unnest(l)) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE value <> '' AND NOT starts_with(value, '#')",
    "fetch_status": """WITH f AS (SELECT DISTINCT l_suppkey AS store_key, l_linenumber AS alias_ord FROM lineitem),
        g AS (SELECT store_key, alias_ord, store_key % 50 <> 7 AND (store_key + alias_ord) % 3 <> 0 AS ok, CASE WHEN store_key % 50 = 7 THEN 'scraper no implementado' ELSE concat('e', alias_ord) END AS error FROM f)
        SELECT store_key, bool_or(ok) AS ok, CASE WHEN NOT bool_or(ok) THEN arg_min(error, alias_ord) END AS error FROM g GROUP BY store_key""",
    "dedupe_offers": f"WITH {DUP_SQL} SELECT store_key, alias_ord, l_orderkey, l_partkey, price FROM (SELECT *, {DEDUPE} AS r FROM offers_dup) WHERE r = 1",
    "alias_union": f"WITH {DUP_SQL}, g AS (SELECT *, store_key % 2 = 0 AS single FROM offers_dup WHERE (store_key + alias_ord) % 3 <> 0) "
    + f"SELECT store_key, alias_ord, l_orderkey, l_partkey, price FROM g WHERE single UNION ALL SELECT store_key, alias_ord, l_orderkey, l_partkey, price FROM (SELECT *, {DEDUPE} AS r FROM g WHERE NOT single) WHERE r = 1",
    "zero_result_fallback": f"WITH {OFFERS_SQL} SELECT store_key, name, price, url FROM offers o WHERE contains(name, 'red widget') OR contains(name, 'widget') AND NOT EXISTS (SELECT 1 FROM offers p WHERE p.store_key = o.store_key AND contains(p.name, 'red widget'))",
    "offer_items": f"WITH {OFFERS_SQL} SELECT name, price, available > 0 AS available, url FROM offers",
    "priced_offers": f"WITH {OFFERS_SQL} SELECT store_key, name, price, url FROM offers WHERE price > 0 AND NOT isnan(price)",
    "offers_by_store": f"WITH {OFFERS_SQL} SELECT store_key, store_name, count(*) AS n, count(*) FILTER (price > 0) AS n_priced FROM offers GROUP BY ALL",
    "best_match_per_store": FOUND + CHEAPEST.format("priced") + " SELECT store_key, store_name, name, price, available, url FROM m WHERE r = 1",
    "best_per_store": BEST + " SELECT * FROM best",
    "store_items": ITEMS + " SELECT * FROM items WHERE item_no <= 24",
    "nested_items": ITEMS + " SELECT store_key, count(*) AS n, arg_min(price, item_no) AS first_price, max(price) AS top_price FROM items WHERE item_no <= 24 GROUP BY store_key",
    "unmatched_stores": FOUND + OK_ONLY + ANY_PRICED + f" SELECT f.store_key, {REASON} AS reason FROM fetches f LEFT JOIN anyp a USING (store_key) WHERE f.store_key NOT IN (SELECT store_key FROM goodp)",
    "store_reasons": f"WITH {FETCHES_SQL}, {OFFERS_SQL}" + ANY_PRICED + f" SELECT f.store_key, {REASON} AS reason FROM fetches f LEFT JOIN anyp a USING (store_key)",
    "cli_view": FOUND + OK_ONLY + CHEAPEST.format("goodp") + ANY_PRICED
    + f", u AS (SELECT f.store_key, f.store_ord, f.store_name, m.name, m.price, m.available > 0 AS in_stock, CASE WHEN m.store_key IS NULL THEN {REASON} END AS reason, m.store_key IS NULL AS part FROM fetches f LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (store_key) LEFT JOIN anyp a USING (store_key))"
    + " SELECT store_key, store_name, name, price, in_stock, reason, CAST(row_number() OVER (ORDER BY part, price NULLS LAST, store_ord) AS INTEGER) AS line_no FROM u",
    "all_view": ITEMS + " SELECT * FROM items WHERE item_no <= 24 ORDER BY NOT available, price, store_key, item_no LIMIT 45",
    "compare_meta": BEST + ", o AS (SELECT * FROM best WHERE ok), g AS (SELECT count(*) AS stores, CAST(sum(coalesce(nullif(count, 0), 1)) AS BIGINT) AS relevant, arg_max(price, rank) - arg_min(price, rank) AS gap FROM o) SELECT stores, relevant, CASE WHEN stores > 1 AND gap > 0 THEN round(gap, 2) END AS saving FROM g",
    "cheapest_store": BEST + " SELECT arg_min(store_key, rank) AS store_key FROM best WHERE ok",
    "batch_total": f"WITH {OFFERS_SQL}, {NAMED}, q AS (" + " UNION ALL ".join(f"SELECT '{q}' AS query, * FROM named WHERE price > 0 AND {MATCHES[k]}" for q, k in (("widget rojo", 0), ("anvil azul", 1), ("gizmo", 5), ("plat", 4)))
    + "), b AS (SELECT query, store_name, price FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY price, store_key, pos) AS r FROM q) WHERE r = 1) SELECT * FROM b UNION ALL SELECT 'TOTAL', NULL, round(sum(price), 2) FROM b",
    "api_response": BEST + " SELECT 'widget rojo' AS query, count(*) AS n, count(*) FILTER (ok) AS n_ok, round(coalesce(sum(price ORDER BY rank), 0), 2) AS sum_price, arg_min(store_key, rank) FILTER (ok) AS cheapest FROM best",
    "jsonld_items": BEST + " SELECT rank AS position, store_key, name, price, CASE WHEN available THEN 'InStock' ELSE 'OutOfStock' END AS availability, url FROM best WHERE ok AND rank <= 10",
    "search_log_rows": BEST + " SELECT 'widget rojo' AS query, count(*) FILTER (ok) AS stores_with_price, arg_min(store_key, rank) FILTER (ok) AS cheapest FROM best",
    "search_status": ALL_STORES + " SELECT CAST(s AS VARCHAR) AS store_key, store_name, ok, error FROM shops JOIN status USING (s)",
    "search_offers": ALL_STORES + " SELECT store_key, name, price, available, url, image, CAST(k AS INTEGER) AS alias_ord FROM once",
    "search_cli": ALL_STORES + CHEAPEST_HIT
    + """, u AS (SELECT h.s, CAST(h.s AS VARCHAR) AS store_key, h.store_name, m.name, m.price, m.available > 0 AS in_stock,
          CASE WHEN m.s IS NOT NULL THEN NULL WHEN NOT f.ok THEN coalesce(nullif(f.error, ''), 'sin resultados') WHEN a.p THEN 'sin coincidencia para tu búsqueda' ELSE 'sin resultados' END AS reason
          FROM shops h JOIN status f USING (s) LEFT JOIN m USING (s) LEFT JOIN anyp a USING (s))
        SELECT store_key, store_name, name, price, in_stock, reason, CAST(row_number() OVER (ORDER BY reason IS NOT NULL, price NULLS LAST, s) AS INTEGER) AS line_no FROM u""",
    "search_rows": ALL_STORES + " SELECT rank, store_key, ok, count, name, price, available, url, image, error, found_without_price, items FROM best",
    "search_api": ALL_STORES + " SELECT 'widget rojo' AS query, 'widget rojo' AS normalized_query, 'local' AS planner, (SELECT arg_min(store_key, rank) FILTER (ok) FROM best) AS cheapest, rank, store_key, ok, count, name, price, available, url, image, error, found_without_price, n_items FROM best",
    "search_one_store": SEARCHED.format(where="OR s_suppkey = 7").replace("s_acctbal >= 0 OR s_suppkey = 7", "s_suppkey = 7") + " SELECT rank, store_key, ok, count, name, price, error FROM best",
    "search_log": ALL_STORES + " SELECT 1704067200 AS ts, 'widget rojo' AS query, NULL::VARCHAR AS store, count(*) FILTER (ok) AS stores_with_price, arg_min(store_key, rank) FILTER (ok) AS cheapest FROM best",
    "search_batch": f"""WITH {LANDED_SQL}, named AS (SELECT *, {STRIP.format('name')} AS norm, {TOKENS.format('name')} AS toks FROM landed_offers WHERE s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)),
        b AS (SELECT text AS query, store_name, price FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY price, s, pos) AS r FROM named JOIN texts USING (k) WHERE price > 0 AND CASE WHEN k = 2 THEN NOT {ACCESSORY} AND {_word('widget')} ELSE {WIDGET} END) WHERE r = 1)
        SELECT * FROM b UNION ALL SELECT 'TOTAL', NULL, round(sum(price), 2) FROM b""",
    "popular_queries": f"WITH {SEARCHES_SQL} SELECT query, count FROM (SELECT {COLLAPSE} AS query, count(*) AS count, min(event_id) AS first FROM searches GROUP BY 1) WHERE query <> '' ORDER BY count DESC, first LIMIT 20",
    "popular_by_hour": f"WITH {SEARCHES_SQL} SELECT date_trunc('hour', ts) AS start, {COLLAPSE} AS query, count(*) AS count FROM searches GROUP BY 1, 2",
    "sessions": f"""WITH {SEARCHES_SQL}, a AS (SELECT client, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM searches WINDOW w AS (PARTITION BY client ORDER BY ts)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY client ORDER BY ts) AS s FROM a) SELECT client, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS searches FROM b GROUP BY client, s""",
    "rate_limit": "WITH RECURSIVE " + HITS.removeprefix("WITH ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, id) AS n FROM hits),
        walk AS (SELECT client, id, n, [t] AS live, TRUE AS accepted FROM o WHERE n = 1
          UNION ALL SELECT o.client, o.id, o.n, CASE WHEN len(list_filter(w.live, lambda x: x >= o.t - 86400)) < 2 THEN list_append(list_filter(w.live, lambda x: x >= o.t - 86400), o.t) ELSE list_filter(w.live, lambda x: x >= o.t - 86400) END,
                 len(list_filter(w.live, lambda x: x >= o.t - 86400)) < 2 FROM walk w JOIN o ON o.client = w.client AND o.n = w.n + 1)
        SELECT client, id, accepted FROM walk""",
    "attempts_in_window": HITS + " SELECT client, id, count(*) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS attempts FROM hits",
    "cache_hit_sim": "WITH RECURSIVE " + HITS.removeprefix("WITH ") + """, o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, id) AS n FROM hits),
        walk AS (SELECT client, id, n, t AS written, FALSE AS hit FROM o WHERE n = 1
          UNION ALL SELECT o.client, o.id, o.n, CASE WHEN o.t - w.written <= 43200 THEN w.written ELSE o.t END, o.t - w.written <= 43200 FROM walk w JOIN o ON o.client = w.client AND o.n = w.n + 1)
        SELECT CAST(client AS VARCHAR) AS key, id, hit FROM walk""",
    "cache_lookup": HITS + """, l AS (SELECT CAST(client AS VARCHAR) AS key, arg_max(CASE WHEN id % 7 = 0 THEN 'null' ELSE '[' || id || ']' END, t) AS data, max(t) AS ts FROM hits GROUP BY client)
        SELECT key, data, substr(sha256(key), 1, 32) || '.json' AS file FROM l WHERE 1704067200 + 29 * 86400 - ts <= 86400 AND data <> 'null'""",
    "plan_resolution": f"""WITH {SEARCHES_SQL}, {CACHED_PLANS_SQL}, last AS (SELECT a.event_id, a.clean, arg_max(struct_pack(e := c.e, t := c.t), (c.t, c.id)) AS c, any_value(a.t) AS t FROM asked a LEFT JOIN cached c ON c.key = lower(a.clean) AND c.t <= a.t GROUP BY 1, 2),
        f AS (SELECT *, coalesce(t - c.t <= {PLAN_TTL_S * 10**6} AND c.e % 5 <> 0 AND c.e % 7 <> 0, FALSE) AS fresh FROM last)
        SELECT event_id, CASE WHEN fresh THEN 'data' ELSE 'local' END AS source, CASE WHEN fresh THEN 'plan ' || c.e ELSE clean END AS canonical_query, clean || CASE WHEN fresh THEN '|Extra ' || c.e % 9 ELSE '' END AS texts FROM f""",
    "cached_searches": f"""WITH RECURSIVE {TIMED_SQL}, a AS (
          SELECT q.store, q.k, q.t, q.id, arg_max(struct_pack(id := l.id, ok := l.ok, bare := l.bare), (l.t, l.id)) FILTER (l.k = q.k) AS f, arg_max(struct_pack(id := l.id, ok := l.ok, bare := l.bare), (l.t, l.id)) FILTER (l.k = -1) AS g
          FROM requests q LEFT JOIN timed l ON l.store = q.store AND l.t <= q.t AND l.k IN (q.k, -1) GROUP BY 1, 2, 3, 4),
        b AS (SELECT *, CASE WHEN coalesce(f.ok AND f.bare, FALSE) AND g IS NOT NULL THEN g ELSE f END AS own FROM a),
        r AS MATERIALIZED (SELECT concat(store, '::', k) AS key, t, id, coalesce(own.ok, FALSE) AS ok, own.id AS landing FROM b), {WALK.format(ttl=4 * 3600 * 10**6)}
        SELECT walk.id, hit, hit OR walk.ok AS ok, CASE WHEN NOT hit AND NOT walk.ok THEN 'e' || own.landing END AS error, wrote.landing FROM walk JOIN r own ON own.id = walk.id LEFT JOIN r wrote ON wrote.id = walk.e""",
    "cache_one_key": f"WITH RECURSIVE r AS MATERIALIZED (SELECT 'all' AS key, epoch_us(ts) AS t, event_id AS id, event_id % 3 <> 0 AS ok FROM events), {WALK.format(ttl=3600 * 10**6)} SELECT id, hit, e AS entry FROM walk",
    "page_lookup": "SELECT lower(n_name) AS slug, CASE WHEN n_regionkey < 3 THEN 'q ' || n_name END AS query, CASE WHEN n_regionkey < 3 THEN 200 ELSE 404 END AS status FROM nation",
    "page_documents": f"""WITH {FETCHES_SQL}, {OFFERS_SQL}, {PAGES_SQL}, {NAMED}, w0 AS (SELECT *, list_filter({TOKENS.format('query')}, lambda x: NOT list_contains({_list(STOPWORDS)}, x)) AS w FROM pages_),
        asked AS (SELECT *, list_has_any(w, {_list(ACCESSORIES)}) AS asks, list_transform(w, lambda x: CASE WHEN list_contains({_list(RED)}, x) THEN {_list(RED)} WHEN list_contains({_list(BLUE)}, x) THEN {_list(BLUE)} ELSE [x] END) AS g FROM w0),
        names AS (SELECT DISTINCT name, norm, toks, {ACCESSORY} AS accessory FROM named),
        pairs AS (SELECT slug, name FROM asked, names WHERE len(w) = 0 OR (asks OR NOT accessory) AND len(list_filter(g, lambda x: NOT (list_has_any(toks, x) OR len(list_filter(x, lambda y: length(y) >= 5 AND contains(norm, y))) > 0))) = 0),
        hit AS (SELECT slug, o.* FROM pairs JOIN offers o USING (name)),
        top AS (SELECT *, row_number() OVER (PARTITION BY slug, store_key ORDER BY (available <= 0), price, pos) AS r, count(*) OVER (PARTITION BY slug, store_key) AS n FROM hit WHERE price > 0),
        bare AS (SELECT slug, store_key, count(*) AS n_all FROM hit GROUP BY 1, 2), anyp AS (SELECT store_key, bool_or({_IS_PRICED}) AS p FROM offers GROUP BY store_key),
        b0 AS (SELECT p.slug, f.store_key, f.store_name, f.store_ord, f.ok AND t.store_key IS NOT NULL AS good, t.name, t.price, t.available > 0 AS available, t.url,
               CASE WHEN NOT f.ok THEN coalesce(nullif(f.error, ''), 'sin resultados') WHEN b.n_all > 0 THEN 'productos encontrados sin precio público' WHEN a.p THEN 'sin coincidencia para tu búsqueda' ELSE 'sin resultados' END AS error
          FROM pages_ p CROSS JOIN fetches f LEFT JOIN (SELECT * FROM top WHERE r = 1) t ON t.slug = p.slug AND t.store_key = f.store_key LEFT JOIN bare b ON b.slug = p.slug AND b.store_key = f.store_key LEFT JOIN anyp a ON a.store_key = f.store_key),
        b1 AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY NOT good, NOT coalesce(good AND available, FALSE), CASE WHEN good THEN price ELSE 'inf'::DOUBLE END, store_ord) AS rank FROM b0),
        s AS (SELECT slug, coalesce(md5(string_agg(concat(store_name, ':', error), ',' ORDER BY rank) FILTER (NOT good)), md5('')) AS failures, arg_min(store_key, rank) FILTER (good) AS store_key, arg_min(price, rank) FILTER (good) AS price, count(*) AS stores,
          coalesce(string_agg('{{"@type":"ListItem","position":' || rank || ',"name":"' || name || '","url":"' || url || '","item":{{"@type":"Product","name":"' || name || '","image":null,"offers":{{"@type":"Offer","priceCurrency":"GTQ","price":' || CAST(price AS VARCHAR)
            || ',"availability":"https://schema.org/' || CASE WHEN available THEN 'InStock' ELSE 'OutOfStock' END || '","seller":{{"@type":"Organization","name":"' || store_name || '"}},"url":"' || url || '"}}}}}}', ',' ORDER BY rank) FILTER (good AND rank <= 10), '') AS items FROM b1 GROUP BY slug),
        l AS (SELECT p.slug, string_agg(q.slug, ',' ORDER BY q.slug < p.slug, q.slug) AS links FROM pages_ p JOIN pages_ q ON p.slug <> q.slug GROUP BY 1)
        SELECT slug, '{{"@context":"https://schema.org","@type":"ItemList","name":"' || h1 || '","description":"' || replace(description, '"', '\\"') || '","url":"https://shop.example/comparar/' || slug || '","dateModified":"2024-01-31","itemListElement":[' || items || ']}}' AS json_ld,
          failures, store_key, price, stores, array_to_string(string_split(links, ',')[1:3], ',') AS related FROM pages_ JOIN s USING (slug) JOIN l USING (slug)""",
    "sitemap_rows": "SELECT 'https://shop.example/' AS loc, '2024-01-31' AS lastmod, 'daily' AS changefreq, 1.0::DOUBLE AS priority UNION ALL SELECT 'https://shop.example/comparar/' || lower(n_name), '2024-01-31', 'daily', 0.9::DOUBLE FROM nation",
}
