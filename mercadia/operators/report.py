"""Rows of generated pages: sitemap, link lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.config import DEFAULT, EngineConfig
from mercadia.functions.scalars import html_escape
from mercadia.operators.compare import best_per_page
from mercadia.shared import spool

PAGE = "slug string, query string, title string, h1 string, description string"


def page_lookup(pages: DataFrame, slugs: DataFrame) -> DataFrame:
    """Each asked slug with its page, and status 200 or, where there is none, 404. The pages are a dimension that a config holds."""
    return slugs.join(pages, "slug", "left").withColumn("status", F.when(F.col("query").isNull(), 404).otherwise(200))


def sitemap_rows(pages: DataFrame, site: str, today: str) -> DataFrame:
    """loc, lastmod, changefreq, priority: the home page and each page."""
    home = pages.sparkSession.createDataFrame([(f"{site}/", 1.0)], "loc string, priority double")
    rows = home.union(pages.select(F.concat(F.lit(f"{site}/comparar/"), "slug"), F.lit(0.9)))
    return rows.select("loc", F.lit(today).alias("lastmod"), F.lit("daily").alias("changefreq"), "priority")


def sitemap_xml(rows: DataFrame) -> str:
    """The sitemap of a page dimension, which fits in the driver as it comes from a config."""
    urls = [f"  <url><loc>{r.loc}</loc><lastmod>{r.lastmod}</lastmod><changefreq>{r.changefreq}</changefreq><priority>{r.priority}</priority></url>" for r in rows.collect()]
    return "\n".join(['<?xml version="1.0" encoding="UTF-8"?>', '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', *urls, "</urlset>"])


def robots(site: str) -> str:
    return f"User-agent: *\nAllow: /\nSitemap: {site}/sitemap.xml\n"


def link_lines(pages: DataFrame, site: str) -> DataFrame:
    return pages.select(F.concat(F.lit("- ["), "h1", F.lit(f"]({site}/comparar/"), "slug", F.lit("): "), "description").alias("line"))


def llms_text(pages: DataFrame, site: str, name: str, about: str) -> str:
    """The overview for language models: a heading, what the site is, and its pages. The pages come from a config."""
    lines = [r["line"] for r in link_lines(pages, site).collect()]
    return "\n".join([f"# {name}", "", about, "", "## Paginas principales", "", f"- [Inicio]({site}/): {about}", *lines, ""])


def not_found(pages: DataFrame) -> str:
    """The body of a 404: links to the pages there are."""
    shown = pages.select(F.concat(F.lit('<li><a href="/comparar/'), html_escape(F.col("slug")), F.lit('">'), html_escape(F.col("h1")), F.lit("</a></li>")).alias("x"))
    links = "".join(r["x"] for r in shown.collect())
    return f'<!DOCTYPE html><html lang="es"><head><meta charset="UTF-8"><title>Página no encontrada</title></head>\n<body><h1>Página no encontrada</h1><p>Comparaciones disponibles:</p><ul>{links}</ul></body></html>'


def item_list(listed: DataFrame, currency: str = "GTQ") -> Column:
    """One position of a JSON-LD item list, of compare.list_items."""
    image = F.col("image") if "image" in listed.columns else F.lit(None).cast("string")
    offer = F.struct(
        F.lit("Offer").alias("@type"), F.lit(currency).alias("priceCurrency"), "price", F.concat(F.lit("https://schema.org/"), "availability").alias("availability"),
        F.struct(F.lit("Organization").alias("@type"), F.col("store_name").alias("name")).alias("seller"), "url",
    )
    product = F.struct(F.lit("Product").alias("@type"), "name", image.alias("image"), offer.alias("offers"))
    return F.struct(F.lit("ListItem").alias("@type"), "position", "name", "url", product.alias("item"))


def page_report(page: DataFrame, pages: DataFrame, best: DataFrame, listed: DataFrame, site: str, today: str, planner: str = "local") -> DataFrame:
    """What a page shows, as one row for the one row of `page`(PAGE): JSON-LD document, failures, related pages, cheapest offer and counts.

    best is compare.best_per_store's answer to the page's query and listed compare.list_items of it; each is one row for a store at most.
    """
    items = listed.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item_list(listed).alias("x")))), lambda v: v["x"]).alias("items"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", F.col("store_name").alias("store"), "error"))))
    first = F.min_by(F.when(F.col("ok"), F.struct("store_key", "store_name", "price")), F.when(F.col("ok"), F.col("rank")))
    shown = best.agg(F.transform(failed, lambda v: F.struct(v["store"], v["error"])).alias("failures"), first.alias("best"), F.count("*").alias("stores"))
    own = page.select(F.col("slug").alias("_slug"))
    links = pages.join(F.broadcast(own), F.col("slug") == F.col("_slug"), "left_anti").agg(F.array_sort(F.collect_list(F.struct("slug", "h1"))).alias("related"))  # pages come from a config
    whole = page.join(items).join(shown).join(links)  # one row each
    url = F.concat(F.lit(f"{site}/comparar/"), "slug")
    document = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.col("h1").alias("name"), "description", url.alias("url"), F.lit(today).alias("dateModified"), F.col("items").alias("itemListElement"))
    return whole.select("slug", "title", "h1", "description", url.alias("canonical"), F.to_json(document, {"ignoreNullFields": "false"}).alias("json_ld"), "failures", "best", "stores", "related", F.lit(planner).alias("planner"), F.lit(today).alias("updated"))


#: Pages among which a page's related ones are sought.
LINK_GROUP = 64


def related_pages(pages: DataFrame, most: int) -> DataFrame:
    """slug, related: at most `most` other pages, those that follow in order of slug and then from the start, within groups of about LINK_GROUP pages; where pages are fewer than that, of all."""
    groups = max(1, -(-pages.count() // LINK_GROUP))
    grouped = pages.withColumn("_group", F.pmod(F.xxhash64("slug"), F.lit(groups)))
    lists = grouped.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("slug", "h1"))).alias("all"))
    others = F.concat(F.filter("all", lambda x: x["slug"] > F.col("slug")), F.filter("all", lambda x: x["slug"] < F.col("slug")))
    return grouped.select("slug", "_group").join(lists, "_group").select("slug", F.slice(others, 1, most).alias("related"))


def page_reports(pages: DataFrame, offers: DataFrame, fetches: DataFrame, site: str, today: str, config: EngineConfig = DEFAULT, planner: str = "local") -> DataFrame:
    """What each of pages(PAGE) shows, as page_report gives it for one: all pages in one job. slugs are unique; related has at most config.related pages."""
    rows = spool(best_per_page(offers, fetches, pages.select(F.col("slug").alias("query_id"), "query")), "page-rows")
    shown = rows if "image" in rows.columns else rows.withColumn("image", F.lit(None).cast("string"))
    positions = shown.where((F.col("ok")) & (F.col("rank") <= config.list_items)).withColumns({"position": F.col("rank"), "availability": F.when(F.col("available"), "InStock").otherwise("OutOfStock")})
    items = positions.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", item_list(positions).alias("x")))), lambda v: v["x"]).alias("items"))
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("rank", F.col("store_name").alias("store"), "error"))))  # a page's stores
    first = F.min_by(F.when(F.col("ok"), F.struct("store_key", "store_name", "price")), F.when(F.col("ok"), F.col("rank")))
    sums = shown.groupBy("query_id").agg(F.transform(failed, lambda v: F.struct(v["store"], v["error"])).alias("failures"), first.alias("best"), F.count("*").alias("stores"))
    whole = pages.join(sums.join(items, "query_id", "left").withColumnRenamed("query_id", "slug"), "slug").join(related_pages(pages, config.related), "slug")
    url = F.concat(F.lit(f"{site}/comparar/"), "slug")
    none = F.array().cast(items.schema["items"].dataType)
    document = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.col("h1").alias("name"), "description", url.alias("url"), F.lit(today).alias("dateModified"), F.coalesce("items", none).alias("itemListElement"))
    return whole.select("slug", "title", "h1", "description", url.alias("canonical"), F.to_json(document, {"ignoreNullFields": "false"}).alias("json_ld"), "failures", "best", "stores", "related", F.lit(planner).alias("planner"), F.lit(today).alias("updated"))
