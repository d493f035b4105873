"""Parsers of landed search payloads: one kind of retailer endpoint each, from the columns (body, domain) to an array of offers.

Each parser is a Column expression, so payloads of all kinds are read in one scan: a dispatch by kind to one array, one explode. The
offers are structs of the ITEM columns; pos is the order within the payload. A body that can't be read gives no offers, and an element that
can't be read gives none of its own: others are untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.functions.scalars import NO_NAME, as_price, html_text, minor_units, normalize_price, stock_flag, stock_in, text_of_markup, truthy, unescape, url_quote

ITEM = ["pos", "name", "price", "available", "url", "image"]
#: Kinds that are asked again for the first word where a text of several words finds nothing.
ASK_AGAIN = ["vtex", "vtex_manual", "kemik", "magento", "woocommerce"]

# Field names and markup of the endpoints' answers.
CATALOG = (
    "ARRAY<STRUCT<productName STRING, link STRING, items ARRAY<STRUCT<images ARRAY<STRUCT<imageUrl STRING>>, "
    "sellers ARRAY<STRUCT<commertialOffer STRUCT<Price STRING, AvailableQuantity STRING>>>>>>>"
)
PRODUCTS = (
    "ARRAY<STRUCT<Codigo STRING, Descripcion STRING, PrecioNormal STRING, PrecioDescuento STRING, "
    "Existencia ARRAY<STRUCT<Existencia STRING>>, EnBodega STRING, EnTransito STRING, Imagen STRING>>"
)
RESULTS = (
    "STRUCT<response STRUCT<results ARRAY<STRUCT<value STRING, data STRUCT<final_price STRING, special_price STRING, price STRING, "
    "regular_price STRING, url STRING, url_key STRING, meta_title STRING, image_url STRING, salable_quantity STRING, "
    "facets ARRAY<STRUCT<name STRING, values ARRAY<STRING>>>>>>>>"
)
GRID_ITEM = r"(?i)product-item-info"
# address, quote, rest of the tag, text; a tag of these two attributes alone, which can be read in one way only, is read without trying others
GRID_LINK = r'(?is)<a\b(?: class="product-item-link" href="(?=[^"<>=]+">)|[^>]*class="[^"]*product-item-link[^"]*"[^>]*href=")([^"]+"[^>]*>[^<]*+(?:<(?!/a>)[^<]*+)*+)</a>'
GRID_PRICE = r'data-price-amount="([\d.]+)"'  # in lower case
GRID_IMAGE = r'(?i)class="product-image-photo"[^>]*\ssrc="([^"]+)"'
CARD = r'(?i)<a title="([^"]*)"[^>]*href="(/[a-z0-9][a-z0-9\-]{20,})"'
CARD_PRICE = r'(?i)data-component="Price"[^>]*>\s*<div>Q\s?([\d,]+)</div>'
CARD_IMAGE = r'(?i)<img\s+src="(https://cdn\.kemik\.gt[^"]+)"'
LIST_ITEM = r'(?is)<li\b[^>]*class="[^"]*\bproduct\b[^"]*"[^>]*>(.*?)</li>'
LIST_LINK = r'(?is)<a\b[^>]*href="([^"]+)"[^>]*woocommerce-loop-product__link[^>]*>'
LIST_TITLE = r'(?is)<h2\b[^>]*class="[^"]*woocommerce-loop-product__title[^"]*"[^>]*>(.*?)</h2>'
LIST_AMOUNT = r'(?i)woocommerce-Price-currencySymbol">\s*Q\s*</span>\s*([\d,]+(?:\.\d+)?)'
LIST_IMAGE = r'(?i)\b(?:data-lazy-src|src)="(https?://[^"]+)"'


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group at the first match, or null without one. The first match takes the rest of the text, so no others are sought."""
    return F.get(F.regexp_extract_all(text, F.lit(f"{pattern}(?s:.*)"), F.lit(group)), 0)


def _site(domain: Column, path: str, tail: Column) -> Column:
    return F.concat(F.lit("https://"), domain, F.lit(path), tail)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _item(pos: Column, name: Column, price: Column, available: Column, url: Column, image: Column) -> Column:
    columns = (pos.cast("int"), name.cast("string"), price.cast("double"), available.cast("int"), url.cast("string"), image.cast("string"))
    return F.struct(*[c.alias(n) for c, n in zip(columns, ITEM, strict=True)])


def catalog(body: Column, domain: Column) -> Column:
    """Catalog listings: first unit, first seller, first image; an item with an unreadable price or stock is dropped."""
    unit = lambda x: F.get(x["items"], 0)
    offer = lambda x: F.get(unit(x)["sellers"], 0)["commertialOffer"]
    stock = lambda x: truthy(offer(x)["AvailableQuantity"])
    readable = lambda x: (offer(x)["Price"].isNull() | _number(offer(x)["Price"]).isNotNull()) & (stock(x).isNull() | _number(stock(x)).isNotNull())
    return F.transform(
        F.filter(F.from_json(body, CATALOG), readable),
        lambda x, k: _item(k, F.coalesce(x["productName"], F.lit(NO_NAME)), normalize_price(_number(offer(x)["Price"])), F.coalesce(_number(stock(x)).cast("int"), F.lit(0)), F.coalesce(x["link"], F.lit("")), F.get(unit(x)["images"], 0)["imageUrl"]),
    )


def _text(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "string")


def minor_unit_search(body: Column, domain: Column, price_field: str = "P", stock_field: str = "I") -> Column:
    """Search documents whose price, in minor units, is a field of the document or of one of its variants; which field depends on country and club."""

    def one(x: Column, k: Column) -> Column:
        master = truthy(_text(x, "$.master_sku"))
        variants = F.try_variant_get(x, "$.variants", "array<variant>")
        v = F.coalesce(F.get(F.filter(variants, lambda v: _text(v, "$.skuid") == master), 0), F.get(F.filter(variants, lambda v: _text(v, f"$.{price_field}").isNotNull()), 0))
        of = lambda name: F.coalesce(_text(x, f"$.{name}"), _text(v, f"$.{name}[0]"), _text(v, f"$.{name}"))
        pid = F.coalesce(_text(x, "$.pid"), F.lit(""))
        slug, sku = F.coalesce(truthy(_text(x, "$.slug")), pid), F.coalesce(master, pid)
        price = minor_units(_number(of(price_field)), _text(x, "$.fractionDigits").try_cast("int"))
        return _item(k, F.coalesce(_text(x, "$.title"), F.lit(NO_NAME)), price, F.when(F.lower(of(stock_field)) == "in stock", 1).otherwise(0), _site(domain, "/es-gt/producto/", F.concat(slug, F.lit("/"), sku)), _text(x, "$.thumb_image"))

    return F.transform(F.try_variant_get(F.try_parse_json(body), "$.response.docs", "array<variant>"), one)


def stocked_products(body: Column, domain: Column) -> Column:
    """Products with stock by branch, in an optional wrapper; a discount above zero is the price. Without a code no row."""
    parsed = F.from_json(body, f"STRUCT<Response STRUCT<Productos {PRODUCTS}>, Productos {PRODUCTS}>")
    inner = F.when(parsed["Response"].isNotNull(), parsed["Response"]["Productos"]).otherwise(parsed["Productos"])
    yes = lambda flag: F.when(F.coalesce(flag, F.lit("")).isin("", "false", "0"), 0).otherwise(1)

    def one(x: Column, k: Column) -> Column:
        held = F.aggregate(F.coalesce(x["Existencia"], F.array()), F.lit(0.0), lambda acc, b: acc + F.coalesce(_number(truthy(b["Existencia"])), F.lit(0.0)))
        discount = as_price(x["PrecioDescuento"])
        name = F.trim(unescape(F.coalesce(truthy(x["Descripcion"]), x["Codigo"])))
        return _item(k, name, F.when(discount > 0, discount).otherwise(as_price(x["PrecioNormal"])), held + yes(x["EnBodega"]) + yes(x["EnTransito"]), _site(domain, "/producto/", url_quote(x["Codigo"])), x["Imagen"])

    return F.transform(F.filter(inner, lambda x: truthy(x["Codigo"]).isNotNull()), one)


def first_price_search(body: Column, domain: Column) -> Column:
    """Results with several prices: the first that is neither missing, empty nor the number 0 counts (the text "0" does)."""

    def one(x: Column, k: Column) -> Column:
        text = lambda name: _text(x, f"$.{name}")

        def given(name: str) -> Column:
            value = F.try_variant_get(x, f"$.{name}", "variant")
            return F.when(F.schema_of_variant(value) == "STRING", truthy(text(name))).when(_number(text(name)) != 0, text(name))

        sku = F.trim(F.coalesce(given("id"), given("mpn"), truthy(text("id")), truthy(text("mpn")), F.lit("")))
        sku = F.when(sku == "0", "").otherwise(sku)
        price = as_price(F.coalesce(given("sale_price"), given("best_price"), text("price")))
        return _item(k, F.trim(unescape(F.coalesce(truthy(text("title")), sku))), price, F.when(F.lower(text("availability")) == "in stock", 1).otherwise(0), F.coalesce(truthy(text("link")), _site(domain, "/producto/", url_quote(sku))), text("image_link"))

    return F.transform(F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>"), one)


def faceted_search(body: Column, domain: Column) -> Column:
    """Results with prices by purpose (the first that isn't zero once read) and stock by quantity, by facet, or else 1."""

    def one(x: Column, k: Column) -> Column:
        data = x["data"]
        prices = [as_price(data[c]) for c in ("final_price", "special_price", "price", "regular_price")]
        facet = F.get(F.filter(data["facets"], lambda f: f["name"] == "availability"), 0)
        by_facet = F.when(facet.isNull(), 1).when(F.exists(F.coalesce(facet["values"], F.array()), lambda v: F.upper(v) == "IN_STOCK"), 1).otherwise(0)
        address = F.coalesce(truthy(data["url"]), _site(domain, "/", truthy(data["url_key"])), F.lit(""))
        price = F.coalesce(*(F.nullif(p, F.lit(0.0)) for p in prices[:-1]), prices[-1])
        return _item(k, F.coalesce(truthy(x["value"]), truthy(data["meta_title"]), F.lit(NO_NAME)), price, F.coalesce(_number(data["salable_quantity"]).cast("int"), by_facet), address, data["image_url"])

    return F.transform(F.from_json(body, RESULTS)["response"]["results"], one)


def _named(items: Column) -> Column:
    return F.filter(items, lambda o: o["name"] != "")


def grid_page(body: Column, domain: Column) -> Column:
    """Pages of a product grid: a chunk from each item mark to the next; without link or name no row. The link is sought once for its address and text, the image only where its mark is."""
    chunks = F.slice(F.split(body, GRID_ITEM), 2, 1 << 30)  # all from the second on
    linked = F.transform(chunks, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low"), _first(x, GRID_LINK).alias("link")))
    split = F.transform(linked, lambda c: F.struct(c["x"].alias("x"), c["low"].alias("low"), c["link"].alias("link"), F.substring_index(c["link"], '"', 1).alias("url")))
    text = lambda c: F.substring(c["link"], F.position(F.lit(">"), c["link"], F.length(c["url"]) + 1) + 1, F.length(c["link"]))
    price = lambda c: F.round(_number(_first(c["low"], GRID_PRICE)), 2)
    image = lambda c: F.when(F.contains(c["low"], F.lit("product-image-photo")), _first(c["x"], GRID_IMAGE))
    return _named(F.transform(split, lambda c, k: _item(k, html_text(text(c)), price(c), stock_in(c["low"], "agotado", "sin existencia"), c["url"], image(c))))


def card_page(body: Column, domain: Column) -> Column:
    """Pages of titled cards: a segment from each card's anchor to the next, the last at most 4,000 characters; without price no row."""
    parts = F.split(body, f"(?={CARD})")
    cut = F.transform(chunks, lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    image = lambda c: F.when(F.contains(c["low"], F.lit("product-image-photo")), _first(c["x"], GRID_IMAGE))
    price = lambda c: F.round(_number(_first(c["low"], GRID_PRICE)), 2)
    read = F.transform(cut, lambda c: F.struct(_first(c["x"], GRID_LINK).alias("link"), price(c).alias("price"), stock_in(c["low"], "agotado", "sin existencia").alias("available"), image(c).alias("image")))
    text = lambda link: F.substring(link, F.position(F.lit(">"), link, F.instr(link, '"')) + 1, F.length(link))
    split = F.transform(read, lambda c: F.struct(F.coalesce(text(c["link"]), F.lit("")).alias("text"), F.substring_index(c["link"], '"', 1).alias("url"), c["price"].alias("price"), c["available"].alias("available"), c["image"].alias("image")))
    return _named(F.transform(split, lambda c, k: _item(k, text_of_markup(c["text"]), c["price"], c["available"], c["url"], c["image"])))


def card_page(body: Column, domain: Column) -> Column:
    """Pages of titled cards: a segment from each card's anchor to the next, the last at most 4,000 characters; without price no row."""
    parts = F.split(body, f"(?={CARD})")
    cut = F.transform(parts, lambda x, k: F.struct(x.alias("x"), (k == F.size(parts) - 1).alias("last")))
    cards = F.filter(cut, lambda c: F.regexp_like(c["x"], F.lit(f"^{CARD}")))
    segment = lambda c: F.substring(c["x"], F.length(F.regexp_extract(c["x"], f"^{CARD}", 0)) + 1, F.when(c["last"], 4000).otherwise(F.length(c["x"])))
    priced = F.filter(F.transform(cards, lambda c: F.struct(c["x"].alias("x"), segment(c).alias("s"))), lambda c: F.regexp_like(c["s"], F.lit(CARD_PRICE)))
    return F.transform(
        priced,
        lambda c, k: _item(k, F.trim(unescape(F.regexp_extract(c["x"], f"^{CARD}", 1))), as_price(_first(c["s"], CARD_PRICE)), stock_flag(c["s"], "agotado", "sin stock"), _site(domain, "", F.regexp_extract(c["x"], f"^{CARD}", 2)), _first(c["s"], CARD_IMAGE)),
    )


def list_page(body: Column, domain: Column) -> Column:
    """Pages of product list items: link and title needed, the last amount is the price."""
    amounts = lambda x: F.regexp_extract_all(x, F.lit(LIST_AMOUNT), F.lit(1))
    linked = F.filter(F.regexp_extract_all(body, F.lit(LIST_ITEM), F.lit(1)), lambda x: F.regexp_like(x, F.lit(LIST_LINK)))
    return _named(F.transform(
        linked, lambda x, k: _item(k, html_text(_first(x, LIST_TITLE)), as_price(F.try_element_at(amounts(x), F.lit(-1))), stock_flag(x, "outofstock", "agotado"), _first(x, LIST_LINK), _first(x, LIST_IMAGE))
    ))


Parser = Callable[[Column, Column], Column]
_KINDS: dict[str, Parser] = {
    "vtex": catalog, "vtex_manual": catalog, "pricesmart": minor_unit_search, "intelaf": stocked_products, "novex": first_price_search,
    "max_constructor": faceted_search, "magento": grid_page, "kemik": card_page, "woocommerce": list_page,
}


def register_source(kind: str, parser: Parser) -> None:
    """Adds a kind of payload; parser takes the columns (body, domain) and gives an array of structs of the ITEM columns."""
    _KINDS[kind] = parser


def kinds() -> list[str]:
    return sorted(_KINDS)


def items(kind: Column, body: Column, domain: Column, only: list[str] | None = None) -> Column:
    """The offers of a payload: an array, by the parser of its kind (of `only`, where given). Unknown kinds have none (see fetch_status)."""
    found = F.lit(None).cast("array<struct<pos:int,name:string,price:double,available:int,url:string,image:string>>")
    by_parser: dict[Parser, list[str]] = {}
    for k, parser in _KINDS.items():
        if only is None or k in only:
            by_parser.setdefault(parser, []).append(k)
    for parser, named in by_parser.items():
        found = F.when(kind.isin(named), parser(body, domain)).otherwise(found)
    return found


def parse(payloads: DataFrame, *keep: str) -> DataFrame:
    """Offers of all payloads(kind, store_key, store_name, domain, body), with the payload's columns `keep`, in one scan."""
    rows = payloads.select("store_key", "store_name", *keep, F.explode(items(F.col("kind"), F.col("body"), F.col("domain"))).alias("_item"))
    return rows.select("store_key", "store_name", *keep, "_item.*")
