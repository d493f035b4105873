"""Golden cases and properties of the operators, and the streaming forms against the batch forms."""

from __future__ import annotations

import html
import html.entities
import random

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from mercadia import fixtures as fx
from mercadia import samples
from mercadia.functions import scalars as sc
from mercadia.operators import compare, report, search, state
from mercadia.plans import columns as plan_columns
from mercadia.sources import landed, payloads
from mercadia.streaming.stateful import cached, popular_stream, rate_limited


def column(spark, expression, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v"))).collect()]


def test_price_and_money(spark):
    assert column(spark, sc.as_price, " 1,399.00 ", "", "abc", "0", None) == [1399.0, None, None, 0.0, None]
    assert column(spark, sc.money, 11499.0, None, kind="double") == ["Q11,499.00", "N/D"]
    assert column(spark, sc.is_priced, 1.0, 0.0, None, float("nan"), kind="double") == [True, False, False, False]


def test_html(spark):
    assert column(spark, sc.html_text, " A <b>x</b>&nbsp;&amp;lt; \n y ", None) == ["A x &lt; y", ""]
    assert column(spark, sc.html_escape, "<a href=\"x\">'&'</a>", None) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;", ""]


def test_references_as_python_reads_them(spark):
    draw = random.Random(9)
    names = [f"&{n}" for n in draw.sample(sorted(html.entities.html5), 300)]
    odd = ["&", "&&", "a&b;c", "&#;", "&#x;", "&#0;", "&#00065;&#x41", "&#128;&#150;&#129;", "&#55296;&#1114112;&#99999999999999999999;", "&#xFFFE;&#1;&#13;&#11;", "&notit;&notin;&amp&lt&copyx&ampamp;", "&#xZ;&#12a", "é&eacute;&EACUTE;", "&" * 50, "&nosuch;", "&Aacut", "&lt;&gt", "&amp;lt;"]
    mixed = ["".join(draw.choices([*names, *odd, "x", " ", ";", "#"], k=6)) for _ in range(300)]
    texts = [*names, *odd, *mixed, "plain", ""]
    assert column(spark, sc.unescape, *texts) == [html.unescape(t) for t in texts]
    assert column(spark, sc.unescape, None) == [None]


def test_broken_payloads_are_isolated(spark):
    body = {k: samples.PAYLOADS[k] for k in samples.PAYLOADS}
    rows = [(k, f"{k}-{n}", "S", "shop.example", b) for k in body for n, b in enumerate([body[k], "{", "", None, "[1, 2]"])]
    found = payloads.parse(spark.createDataFrame(rows, "kind string, store_key string, store_name string, domain string, body string"))
    got = found.where(F.endswith("store_key", F.lit("-0"))).groupBy("store_key").count().collect()
    assert {r["store_key"][:-2]: r["count"] for r in got} == {k: len(v) for k, v in samples.PARSED.items()}


def test_register_source(spark):
    payloads.register_source("plain", lambda body, domain: F.array(payloads._item(F.lit(0), body, F.lit(1.0), F.lit(1), F.lit(""), F.lit(None))))
    try:
        row = payloads.parse(spark.createDataFrame([("plain", "s", "S", "d", "thing")], "kind string, store_key string, store_name string, domain string, body string")).first()
        assert row["name"] == "thing"
    finally:
        del payloads._KINDS["plain"]


def test_last_card_is_capped_by_payload(spark):
    """A card whose only price lies beyond 4,000 characters has no row, whatever other payloads of its store hold; columns without a value don't matter."""
    card = '<a title="{}" href="/{}-abcdefghijklmnopqrst">{}<div data-component="Price"><div>Q10</div></div></a>'
    far, near = card.format("Far", "far", "x" * 4100), card.format("Near", "near", "")
    rows = [("kemik", "k", None, None, far, 1), ("kemik", "k", None, None, near + near + far, 2), ("kemik", "k", None, None, far + near, 3)]
    found = payloads.parse(spark.createDataFrame(rows, "kind string, store_key string, store_name string, domain string, body string, n int"), "n")
    assert sorted((r["n"], r["name"]) for r in found.collect()) == [(2, "Near"), (2, "Near"), (3, "Far"), (3, "Near")]


def test_keep_first(spark):
    data = [(1, "U ", "n", 10.0), (2, "u", "m", 10.0), (3, "", "N", 0.0), (4, None, "n ", None), (5, "u", "m", 11.0)]
    offers = spark.createDataFrame([(1, k, u, n, p) for k, u, n, p in data], "store_key int, k int, url string, name string, price double")
    once = compare.keep_first(offers, "k")
    assert sorted(r["k"] for r in once.collect()) == [1, 3, 5]
    assert sorted(r["k"] for r in compare.keep_first(once, "k").collect()) == [1, 3, 5]


def _limits(spark, hits, seconds, limit):
    rows = state.rate_limit(spark.createDataFrame(hits, "client string, t double, id long"), seconds, limit).collect()
    return {r["id"]: r["accepted"] for r in rows}


def test_rate_limit_golden(spark):
    got = _limits(spark, [("c", float(t), k) for k, t in enumerate([0, 10, 20, 60, 61, 71])], 60, 2)
    assert [got[k] for k in range(6)] == [True, True, False, False, True, True]


def test_rate_limit_never_exceeds(spark):
    draw = random.Random(5)
    hits = [(f"c{draw.randrange(3)}", float(draw.randrange(500)), k) for k in range(300)]
    got = _limits(spark, hits, 60, 4)
    for client, t, _ in hits:
        assert sum(got[k] for c, x, k in hits if c == client and t - 60 <= x <= t) <= 4
    assert len(got) == len(hits) and got == brute_limits(hits, 60, 4)


def brute_limits(hits, seconds, limit):
    live, out = {}, {}
    for client, t, k in sorted(hits, key=lambda h: (h[1], h[2])):
        mine = live.setdefault(client, [])
        out[k] = sum(x >= t - seconds for x in mine) < limit
        if out[k]:
            mine.append(t)
    return out


def test_rate_limit_of_a_busy_client(spark):
    """Pauses of just the window and just above it, hits at one time, null clients and times, and a client with most of the hits."""
    draw = random.Random(6)
    times = [0.0, 60.0, 120.0, 180.1, 180.1, 240.0]
    hits = [("edge", t, k) for k, t in enumerate(times)] + [("busy", float(draw.randrange(40_000)), 100 + k) for k in range(20_000)]
    got = _limits(spark, hits + [(None, t, 50_000 + k) for k, t in enumerate(times)] + [("edge", None, 90_000)], 60, 2)
    assert got.pop(90_000) and {k - 50_000: v for k, v in got.items() if k >= 50_000} == {k: got[k] for k in range(6)}
    assert {k: v for k, v in got.items() if k < 50_000} == brute_limits(hits, 60, 2)


def test_cache_of_a_busy_key(spark):
    draw = random.Random(7)
    requests = [("busy" if draw.random() < 0.8 else f"k{draw.randrange(9)}", float(draw.randrange(90_000)), k) for k in range(10_000)]
    written, expect = {}, {}
    for key, t, k in sorted(requests, key=lambda r: (r[1], r[2])):
        expect[k] = key in written and t - written[key] <= 30
        if not expect[k]:
            written[key] = t
    rows = state.cache_hits(spark.createDataFrame(requests, "key string, t double, id long"), 30).collect()
    assert {r["id"]: r["hit"] for r in rows} == expect


def test_streaming_cache_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frame = spark.createDataFrame([("a" if k % 3 else "b", float(7 * k), k) for k in range(60)], "key string, t double, id long")
    frame.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    cached(stream, 30).writeStream.format("memory").queryName("cached").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: r["hit"] for r in spark.table("cached").collect()} == {r["id"]: r["hit"] for r in state.cache_hits(frame, 30).collect()}


def test_streaming_limit_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hits = [("a" if k % 3 else "b", float(7 * k), k) for k in range(60)]
    frame = spark.createDataFrame(hits, "client string, t double, id long")
    frame.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).json(str(tmp_path / "in"))
    done = rate_limited(stream, 60, 3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    done.awaitTermination()
    assert {r["id"]: r["accepted"] for r in spark.table("limited").collect()} == _limits(spark, hits, 60, 3)


def test_popular(spark, tmp_path):
    log = [("  TV  55", 0), ("tv 55", 1), ("Pañal", 2), ("panal", 3), ("  ", 4)]
    frame = spark.createDataFrame(log, "query string, seq int")
    assert [tuple(r) for r in state.popular(frame).collect()] == [("tv 55", 2), ("pañal", 1), ("panal", 1)]
    frame.select("query").write.json(str(tmp_path / "in"))
    stream = popular_stream(spark.readStream.schema("query string").json(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("pop").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(r["query"], r["count"]) for r in spark.table("pop").collect()} == {("tv 55", 2), ("pañal", 1), ("panal", 1)}


def test_cache(spark):
    entries = [("a", 0.0, "[]"), ("b", -1.0, "[1]"), ("c", 0.0, "null"), ("d", -9.0, "[0]"), ("d", 0.0, "[2]")]
    hits = landed.lookup(spark.createDataFrame(entries, "key string, ts double, data string"), 1800.0, 1800.0)
    assert {r["key"]: r["data"] for r in hits.collect()} == {"a": "[]", "d": "[2]"}


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    landed.append_log(spark.createDataFrame([(1, "tv", None, 2, None)], landed.LOG), path)
    (tmp_path / "log" / "bad.json").write_text("no json\n")
    assert [r["query"] for r in landed.read_log(spark, path).collect()] == ["tv"]


def test_modes_choose_different_winners(spark):
    offers = spark.createDataFrame([("s", "S", "tv A", 100.0, 0, "", 0), ("s", "S", "tv B", 120.0, 3, "", 1)], "store_key string, store_name string, name string, price double, available int, url string, pos int")
    fetches = spark.createDataFrame([("s", "S", 0, True, None), ("f", "F", 1, False, "timeout")], "store_key string, store_name string, store_ord int, ok boolean, error string")
    assert compare.best_match_per_store(offers, "tv").first()["name"] == "tv A"
    best = {r["store_key"]: r for r in compare.best_per_store(offers, fetches, "tv").collect()}
    assert (best["s"]["name"], best["s"]["rank"], best["f"]["error"]) == ("tv B", 1, "timeout")


def test_bare_matches_have_their_own_reason(spark):
    offers = spark.createDataFrame([("s", "S", "tv A", None, 1, "", 0), ("t", "T", "radio", 5.0, 1, "", 0)], "store_key string, store_name string, name string, price double, available int, url string, pos int")
    fetches = spark.createDataFrame([("s", "S", 0, True, None), ("t", "T", 1, True, None), ("u", "U", 2, True, None)], "store_key string, store_name string, store_ord int, ok boolean, error string")
    best = {r["store_key"]: r for r in compare.best_per_store(offers, fetches, "tv").collect()}
    assert [best[k]["error"] for k in "stu"] == [compare.NO_PRICE, compare.NO_MATCH, compare.NO_RESULTS]
    assert best["s"]["found_without_price"] and best["s"]["count"] == 1


def test_reports(spark):
    pages = spark.createDataFrame(samples.PAGES, report.PAGE)
    xml = report.sitemap_xml(report.sitemap_rows(pages, "https://shop.example", "2024-01-31"))
    assert xml.count("<url>") == 3 and "comparar/ps5" in xml and report.robots("https://x").endswith("sitemap.xml\n")
    assert report.link_lines(pages, "https://x").first()[0] == "- [Televisores](https://x/comparar/tv-55): Precios de televisores"


def test_page_report(spark):
    offers = spark.createDataFrame([("s", "S", "tv 55 A", 100.0, 0, "u", "i", 0), ("s", "S", "tv 55 B", 120.0, 3, "v", None, 1)], "store_key string, store_name string, name string, price double, available int, url string, image string, pos int")
    fetches = spark.createDataFrame([("s", "S", 0, True, None), ("f", "F", 1, False, "timeout")], "store_key string, store_name string, store_ord int, ok boolean, error string")
    pages = spark.createDataFrame(samples.PAGES, report.PAGE)
    best = compare.best_per_store(offers, fetches, "televisor 55")
    row = report.page_report(pages.where("slug = 'tv-55'"), pages, best, compare.list_items(best), "https://x", "2024-01-31").first()
    assert json.loads(row["json_ld"]) == {
        "@context": "https://schema.org", "@type": "ItemList", "name": "Televisores", "description": "Precios de televisores", "url": "https://x/comparar/tv-55", "dateModified": "2024-01-31",
        "itemListElement": [{"@type": "ListItem", "position": 1, "name": "tv 55 B", "url": "v", "item": {"@type": "Product", "name": "tv 55 B", "image": None, "offers": {
            "@type": "Offer", "priceCurrency": "GTQ", "price": 120.0, "availability": "https://schema.org/InStock", "seller": {"@type": "Organization", "name": "S"}, "url": "v"}}}],
    }
    assert [tuple(x) for x in row["failures"]] == [("F", "timeout")] and tuple(row["best"]) == ("s", "S", 120.0) and row["stores"] == 2 and [x["slug"] for x in row["related"]] == ["ps5"]
    assert '<a href="/comparar/ps5">Consolas</a>' in report.not_found(pages) and "(https://x/comparar/tv-55): Precios" in report.llms_text(pages, "https://x", "N", "A")


def test_blank_search(spark, small):
    from mercadia import catalog
    from mercadia.operators import search as searching

    found = searching.search(catalog._landings(spark, small), catalog.fx.stores(spark, small), "  ")
    row = searching.api(found).first()
    assert (row["query"], row["results"], row["cheapest"]) == ("", "[]", None)


def test_config_write_back(spark, tmp_path):
    defaults = landed.stores(spark, samples.DEFAULT_STORES).withColumn("replaces", F.when(F.col("key") == "max", "vtex"))
    path = str(tmp_path / "config")
    merged = landed.write_config(landed.stores(spark, samples.USER_STORES), defaults, path)
    assert [(r["key"], r["name"], r["domain"], r["kind"], r["enabled"]) for r in merged.orderBy("store_ord").collect()] == samples.MERGED_STORES
    again = landed.write_config(landed.read_config(spark, path), defaults, path)
    assert [r["key"] for r in again.orderBy("store_ord").collect()] == [s[0] for s in samples.MERGED_STORES]


def test_plans_stay_in_the_engine(spark, small):
    """No Python on the hot path; top-k per store is pruned before the sort; filters reach the scan."""
    from mercadia import catalog

    plan = lambda name: catalog.QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert not any(x in plan("best_per_store") for x in ("Python", "Arrow", "Cartesian"))
    assert "WindowGroupLimit" in plan("store_items")


def test_samples_by_hand(spark):
    urls = spark.createDataFrame(samples.URLS, "raw string").select("raw", sc.url_quote(F.col("raw")).alias("strict"), sc.url_quote(F.col("raw"), True).alias("with_slash"))
    assert [tuple(r) for r in urls.collect()] == samples.ENCODED
    clients = spark.createDataFrame(samples.CLIENTS, "forwarded string, host string").select(sc.client_key(F.col("forwarded"), F.col("host")).alias("client"))
    assert [r["client"] for r in clients.collect()] == samples.CLIENT_KEYS
    assert [r["value"] for r in landed.batch_items(spark.createDataFrame([(t,) for t in samples.LINES], "value string")).collect()] == samples.KEPT_LINES


def test_settings_over_defaults(spark):
    make = lambda rows: spark.createDataFrame(rows, "name string, value string")
    merged = landed.merge_settings(make([("a", "1"), ("b", None), ("own", "x")]), make([("a", "0"), ("b", "2"), ("c", "3")]))
    assert {r["name"]: r["value"] for r in merged.collect()} == {"a": "1", "b": None, "c": "3", "own": "x"}


def test_texts_are_normalised_once(spark):
    """Inside an array function Spark works out an expression at each use: a list of n texts would be normalised 2 n times n."""
    frame = spark.createDataFrame([(["Á b", "a  b", "", "a B", None, "c", "Á B"],), ([],), (None,)], "v array<string>").select(plan_columns.unlike(F.col("v")).alias("v"))
    assert [r["v"] for r in frame.collect()] == [["Á b", "a  b", "c"], [], None]
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_answers_stay_where_they_are_until_they_are_asked_for(spark):
    answers = spark.createDataFrame([("1", "a b", True, None, [7], True), ("1", "a", True, None, [8, 9], False), ("1", "c", False, "e", None, False), ("2", "a b", True, None, [1], False)], "store_key string, text string, ok boolean, error string, items array<int>, bare boolean")
    wanted = spark.createDataFrame([("1", "a b", "a"), ("1", "c", None), ("2", "a b", "a"), ("2", "c", None)], "store_key string, text string, again string")
    got = search.fan_out(wanted, answers)
    assert "items" not in got.columns
    assert sorted((r["store_key"], r["text"], r["ok"], r["error"], r["heard"]) for r in got.collect()) == [("1", "a b", True, None, "a"), ("1", "c", False, "e", None), ("2", "a b", True, None, "a b"), ("2", "c", False, None, None)]


def test_a_line_goes_to_its_store_once(spark, small):
    plan = fx.landings(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower() and "productName" not in plan[plan.index("Aggregate") :]


ITEMS = "array<struct<pos:int,name:string,price:double,available:int,url:string,image:string>>"
ANSWERS = f"store_key string, store_ord int, text string, ok boolean, error string, items {ITEMS}, bare boolean"


def _items(*offers):
    return [(k, name, price, 1, url, None) for k, (name, price, url) in enumerate(offers)]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables beyond the threshold
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_offers_of_a_batch_are_met_where_they_are(spark, no_broadcast):
    answers = spark.createDataFrame(
        [
            ("s", 0, "a b", True, None, [], True), ("s", 0, "a", True, None, _items(("A", 3.0, "/1"), ("B", None, "/2"), (None, 2.0, "/3")), False),
            ("t", 1, "a b", True, None, _items(("C", 1.0, "/1")), False), ("t", 1, "a", False, "e", None, False),
            ("u", 2, "a b", True, None, [], True), ("u", 2, "p", True, None, _items(("P", 1.0, "/1"), ("Q", 1.0, " /1")), False), ("u", 2, "q", True, None, _items(("R", 1.0, "/1"), ("R", 4.0, "/1")), False),
        ],
        ANSWERS,
    )
    asked = spark.createDataFrame([(1, 1, 0, "a b", "a"), (2, 1, 0, "a", None), (3, 2, 0, "p", None), (3, 2, 1, "q", None)], "query_id int, n_aliases int, alias_ord int, text string, again string")
    found = search.heard_offers(asked, answers)
    got = sorted(tuple(r) for r in found.select("query_id", "store_key", "alias_ord", "pos", F.coalesce("name", F.lit("")), "price").collect())
    assert got == [(1, "s", 0, 0, "A", 3.0), (1, "s", 0, 2, "", 2.0), (1, "t", 0, 0, "C", 1.0), (2, "s", 0, 0, "A", 3.0), (2, "s", 0, 2, "", 2.0), (3, "u", 0, 0, "P", 1.0), (3, "u", 1, 1, "R", 4.0)]
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_text_of_markup_and_links_of_a_grid(spark):
    texts = ["", "a b", " a  b ", "a\tb\n", "a &amp; b", "x<b>y</b>", "é  ü", "a b", "a;b", None, "<", "a > b"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", sc.html_text(F.col("t")).alias("t")).orderBy("k").collect()
    assert [r["t"] for r in rows] == ["", "a b", "a b", "a b", "a & b", "x y", "é ü", "a b", "a;b", "", "<", "a > b"]
    link = '<div class="product-item-info"><a id="1" class="c product-item-link" href="{}" rel="n">{}</a>'
    body = "x" + link.format("/1?a>b", " One  <i>1</i>") + link.format("/2", "Two > 1") + link.format("/3", "") + '<div class="product-item-info"><a href="/4">Four</a>' + link.format("/5", "Five") + "AGOTADO"
    got = spark.createDataFrame([(body,)], "body string").select(F.inline(payloads.grid_page(F.col("body"), F.lit("d")))).collect()
    assert [(r["pos"], r["name"], r["url"], r["available"]) for r in got] == [(0, "One 1", "/1?a>b", 1), (1, "Two > 1", "/2", 1), (4, "Five", "/5", 0)]


def test_items_of_a_store_move_once_as_whole_answers(spark, no_broadcast):
    answers = spark.createDataFrame([("s", 0, "p", True, None, _items(("P", 1.0, "/1"), ("Q", 1.0, " /1")), False), ("s", 0, "q", True, None, _items(("R", 1.0, "/1"), ("R", 4.0, "/1")), False)], ANSWERS)
    fetched = spark.createDataFrame([("s", "S", 0, True, "p"), ("s", "S", 1, True, "q")], "store_key string, store_name string, alias_ord int, ok boolean, heard string")
    found = search.with_items(fetched, answers).withColumns({"ok": F.lit(True), "n_aliases": F.lit(2)})
    once = compare.alias_union(found, "pos")
    assert sorted((r["alias_ord"], r["pos"], r["name"]) for r in once.collect()) == [(0, 0, "P"), (1, 1, "R")]
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [store_key" in plan
    initial = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in initial[: initial.index("Generate inline")]


def test_verdicts_are_written_with_the_offers(spark, small):
    from mercadia import catalog

    found = catalog._searched(spark, small)
    assert {"_fits", "_priced"} <= set(found.offers.columns)
    plan = found.offers._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_log_row_reads_offers_once_and_writes_none(spark, small, monkeypatch):
    from mercadia import catalog
    from mercadia.operators import search as searching

    written, spool = [], searching.spool
    monkeypatch.setattr(searching, "spool", lambda df, name: written.append(name) or spool(df, name))
    found = catalog._searched(spark, small)
    row = searching.log_row(found, 5)
    assert row._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
    assert tuple(row.first())[:3] == (5, "widget rojo", None) and "offers" not in written
    best = compare.best_per_store(found.offers, found.fetches, found.query, found.plan)
    assert tuple(row.first()) == tuple(compare.log_row(found.query, None, best, 5).first()) and written.count("offers") == 1


def test_ranks_are_those_of_the_best_offers(spark):
    nan = float("nan")
    rows = [
        ("a", "mesa", 9.0, 1), ("a", "mesa", 3.0, 0), ("b", "mesa", 8.0, None), ("b", "mesa", 1.0, 1), ("c", "mesa", nan, 1), ("c", "mesa", 0.0, 1), ("c", "silla", 1.0, 1), ("d", "mesa", 2.0, 0), ("d", "mesa", 7.0, -1),
        ("e", "mesa", 9.0, 1), ("e", "mesa", None, 1), ("f", "mesa", 1.0, 1), ("g", None, 1.0, 1), ("i", "mesa", float("inf"), 0),
    ]
    offers = spark.createDataFrame([(s, s, n, p, v, "/x", k) for k, (s, n, p, v) in enumerate(rows)], "store_key string, store_name string, name string, price double, available int, url string, pos int")
    fetches = spark.createDataFrame([(s, s, k, s != "f", None if s != "f" else "e") for k, s in enumerate("abcdefghi")], "store_key string, store_name string, store_ord int, ok boolean, error string")
    order = lambda df: [r["store_key"] for r in df.where("ok").orderBy("rank").collect()]
    assert order(compare.ranks(offers, fetches, "mesa")) == order(compare.best_per_store(offers, fetches, "mesa")) == ["a", "e", "d", "b", "i"]
    got = {r["store_key"]: r["ok"] for r in compare.ranks(offers, fetches, "mesa").collect()}
    assert got == {r["store_key"]: r["ok"] for r in compare.best_per_store(offers, fetches, "mesa").collect()}


def test_grid_links_are_those_of_the_plain_pattern(spark):
    plain = re.compile(r'(?is)<a\b[^>]*class="[^"]*product-item-link[^"]*"[^>]*href="([^"]+"[^>]*>.*?)</a>')
    tag = '<a class="product-item-link" href="{}">{}</a>'
    texts = [
        tag.format("/1", "One"), tag.format("/1", "x <b>1</b>\n<"), tag.format("/1", "x") + tag.format("/2", "y"), tag.format("", "x"), tag.format("/a?b=c", "x"), tag.format("/href=", "x") + '<i data="1">z</i></a>', tag.format("/1", "x")[:-4],
        tag.format("/1", "x")[:-4] + tag.format("/2", "y"), tag.format("/a>b", "x"), tag.format("/1", "x").upper(), tag.format("/1", "x").replace('">', '" title="t">'), '<a class="product-item-link" href="/1" href="/2">x</a>',
        '<a class="product-item-link" class="product-item-link b" href="/1">x</a>', '<a href="/0">o</a>' + tag.format("/1", "<A>x</A>"), '<abbr class="product-item-link" href="/1">x</a>', '<a  class="product-item-link" href="/1">x</a>', "",
    ]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", payloads._first(F.col("t"), payloads.GRID_LINK).alias("link")).orderBy("k").collect()
    assert [r["link"] for r in rows] == [m[1] if (m := plain.search(t)) else None for t in texts]
    page = '<div class="PRODUCT-item-info">' + tag.format("/1", "One") + '<i DATA-price-AMOUNT="12.345"></i><img CLASS="product-IMAGE-photo" alt="" SRC="/I.png"/>Sin EXISTENCIA'
    got = spark.createDataFrame([(page,)], "body string").select(F.inline(payloads.grid_page(F.col("body"), F.lit("d")))).first()
    assert tuple(got) == (0, "One", 12.35, 0, "/1", "/I.png")
