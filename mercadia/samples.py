"""Small made-up inputs and what must come of them, worked out by hand: payloads of each kind, plans, names, addresses."""

from __future__ import annotations

PAYLOADS = {
    "vtex": """[{"productName":"TV A","link":"https://shop.example/a","items":[{"images":[{"imageUrl":"i1"},{"imageUrl":"i2"}],
  "sellers":[{"commertialOffer":{"Price":1399.0,"AvailableQuantity":5}},{"commertialOffer":{"Price":1.0,"AvailableQuantity":9}}]}]},
 {"productName":"B","items":[]},
 {"productName":"C","items":[{"sellers":[{"commertialOffer":{"Price":"x"}}]}]}]""",
    "pricesmart": """{"response":{"docs":[
 {"pid":"1","title":"A","slug":"a","master_sku":"s2","fractionDigits":0,"thumb_image":"i",
  "variants":[{"skuid":"s1","P":[100]},{"skuid":"s2","P":[129900],"I":["In Stock"]}]},
 {"pid":"2","P":5000,"I":"out"}]}}""",
    "intelaf": """{"Response":{"Productos":[
 {"Codigo":"A/1","Descripcion":"Mouse &amp; Pad","PrecioNormal":"1,250.50","PrecioDescuento":0,
  "Existencia":[{"Existencia":2},{"Existencia":null}],"EnBodega":true,"Imagen":"i"},
 {"Descripcion":"no code"},
 {"Codigo":"B","PrecioNormal":100,"PrecioDescuento":"90"}]}}""",
    "novex": """{"results":[{"id":7,"title":"Pi&ntilde;a","sale_price":"0","best_price":50,"availability":"In Stock","link":"L","image_link":"m"},
            {"mpn":"x y","price":"1,000"}]}""",
    "max_constructor": """{"response":{"results":[
 {"value":"V","data":{"final_price":"0","price":"2,500","url_key":"v","salable_quantity":"3.7","image_url":"i"}},
 {"data":{"meta_title":"M","url":"https://u","regular_price":0,"facets":[{"name":"availability","values":["out_of_stock"]}]}},
 {"value":"W","data":{}}]}}""",
    "magento": """<p>pre</p><div class="product-item-info"><a class="product-item-link" href="https://u/1"> TV <b>A</b> &amp; B </a>
<i data-price-amount="99.5"></i><i data-price-amount="80"></i></div><div class="product-item-info">
<a class="product-item-link" href="https://u/2">C</a> AGOTADO</div><div class="product-item-info"><i data-price-amount="5"></i></div>""",
    "kemik": """<a title="Mouse &amp; Co" href="/mouse-inalambrico-abcdef"><img src="https://cdn.kemik.gt/i.png">
<div data-component="Price"><div>Q1,469</div></div></a><a title="Short" href="/short"></a>
<a title="No price" href="/producto-sin-precio-abcdefg">Agotado</a>""",
    "woocommerce": """<li class="product outofstock"><a href="https://u/1" class="woocommerce-loop-product__link"><img src="https://i/1.png">
<h2 class="woocommerce-loop-product__title">A&nbsp;B</h2></a><span class="woocommerce-Price-currencySymbol">Q</span>1,200.00
<span class="woocommerce-Price-currencySymbol">Q</span>999.90</li>""",
}
#: name, price, available, url, image of each payload's offers.
PARSED = {
    "vtex": [("TV A", 1399.0, 5, "https://shop.example/a", "i1"), ("B", None, 0, "", None)],
    "pricesmart": [("A", 1299.0, 1, "https://shop.example/es-gt/producto/a/s2", "i"), ("—", 50.0, 0, "https://shop.example/es-gt/producto/2/2", None)],
    "intelaf": [("Mouse & Pad", 1250.5, 3, "https://shop.example/producto/A%2F1", "i"), ("B", 90.0, 0, "https://shop.example/producto/B", None)],
    "novex": [("Piña", 0.0, 1, "L", "m"), ("x y", 1000.0, 0, "https://shop.example/producto/x%20y", None)],
    "max_constructor": [("V", 2500.0, 3, "https://shop.example/v", "i"), ("M", 0.0, 0, "https://u", None), ("W", None, 1, "", None)],
    "magento": [("TV A & B", 99.5, 1, "https://u/1", None), ("C", None, 0, "https://u/2", None)],
    "kemik": [("Mouse & Co", 1469.0, 1, "https://shop.example/mouse-inalambrico-abcdef", "https://cdn.kemik.gt/i.png")],
    "woocommerce": [("A B", 999.9, 1, "https://u/1", "https://i/1.png")],
}
RELEVANCE = [
    ("televisor 55", "Televisor Samsung 55 pulgadas 4K", True), ("televisor 55", "Soporte para Televisor 55", False),
    ("televisor 55", "Televisor 550 LED", False), ("pantalla 50", "Pantalla solar 50 ml", False), ("tv 55", "Pantalla LG 55", True),
    ("licuadora", "Motor para Licuadora", False), ("tv", "Organizador para telefono con tv", False), ("ps5", "Consola PlayStation 5 Slim", True),
    ("ps5", "PlayStation 5 Slim", False), ("ps5", "Control DualSense PS5", False), ("auriculares", "Audifonos Sony", False),
    ("audifonos", "Auriculares Sony", True), ("owala", "Botella Owala FreeSip", True), ("owala", "Funda Owala", False),
    ("aire acondicionado", "Ventilador aire", False), ("ac portatil", "Aire Acondicionado Portatil 12000 BTU", False),
    ("ac portatil", "AC Portatil 12000 BTU", True), ("de para", "cualquier cosa", True), ("playera roja", "Camiseta Red Nike", True),
    ("secadora de pelo", "Secadora para Cabello Remington", True), ("refrigeradora", "Organizador para el Refrigerador", False),
    ("samsung", "Funda Samsung", False), ("dewalt", "Taladro DeWaltPro 20V", True), ("rojo", "Vestido Rojos", False), ("taladro 20", "Taladro 20V", False),
    ("pañales", "Panales Huggies", True), ("widget rojo", "red widget", True), ("cafetera", "Maquina de coser marron", True), ("televisor 55", None, False),
]
ALIASES = ["cafetera", "ps5", "televisor 55", "tenis nike", "  ", "de la"]
SEARCHED = {
    "cafetera": ["cafetera", "percoladora", "coffee maker", "coffee machine", "maquina de cafe"],
    "ps5": ["ps5", "playstation 5", "play station 5", "playstation5", "play 5", "consola ps5"],
    "televisor 55": ["televisor 55"],
    "tenis nike": ["tenis nike", "zapatos deportivos nike", "sneakers nike", "zapatillas deportivas nike"],
    "  ": [],
    "de la": ["de la"],
}
#: The token variants of each query, by hand from its alias group: the group's own order, then one more round of substitution.
VARIANTS = {
    "cafetera": ["cafetera", "percoladora", "coffee maker", "coffee machine", "maquina cafe"],
    "ps5": ["ps5", "playstation 5", "play station 5", "playstation5", "play 5", "consola ps5", "consola playstation 5", "sony ps5"],
    "televisor 55": ["televisor 55"],
    "tenis nike": ["tenis nike", "zapatos deportivos nike", "sneakers nike", "zapatillas deportivas nike"],
    "  ": [""],
    "de la": [""],
}
PLANS = [
    {"original_query": "tenis nike", "search_queries": ["  Zapatos   Nike", "zapatos nike", "TENIS NIKE"], "required_any_groups": [["tenis", "Tenis"], []], "exclude_terms": "no list", "confidence": 1.7},
    {"original_query": "tenis nike", "canonical_query": "nike", "search_queries": ["a", "b", "c", "d", "e", "f", "g", "h", "i"], "confidence": "x", "source": "data"},
]
#: The texts of each plan after its merge with the local plan of "tenis nike".
MERGED = [
    ["tenis nike", "Zapatos Nike", "zapatos deportivos nike", "sneakers nike", "zapatillas deportivas nike"],
    ["tenis nike", "a", "b", "c", "d", "e", "f", "g"],
]
RESPONSES = [{"output_text": "t"}, {"output": [{"type": "reasoning"}, {"type": "message", "content": [{"text": None}, {"text": "u"}]}]}, {}]
EXTRACTED = ["t", "u", ""]
URLS = [("a b/c",), ("x+y*z~",), ("ñ&=?",), ("",)]
ENCODED = [("a b/c", "a%20b%2Fc", "a%20b/c"), ("x+y*z~", "x%2By%2Az~", "x%2By%2Az~"), ("ñ&=?", "%C3%B1%26%3D%3F", "%C3%B1%26%3D%3F"), ("", "", "")]
CLIENTS = [("1.2.3.4, 5.6.7.8", "h"), ("", "h"), (None, "h"), (None, None), (" 9.9.9.9 ", None), (", x", "h")]
CLIENT_KEYS = ["1.2.3.4", "h", "h", "unknown", "9.9.9.9", ""]
LINES = ["# list", "  televisor 55 ", "", "licuadora", "   ", "licuadora", "#x"]
KEPT_LINES = ["televisor 55", "licuadora", "licuadora"]
DEFAULT_STORES = [{"key": "a", "name": "A", "domain": "a.example"}, {"key": "max", "name": "Max", "domain": "max.example", "kind": "max_constructor"}, {"key": "z", "name": "Z", "domain": "z.example", "kind": "kemik"}]
USER_STORES = [{"key": "a", "name": "Mine", "domain": "a.example", "enabled": False}, {"key": "max", "name": "Max", "domain": "max.example", "enabled": False}, {"key": "own", "domain": "own.example"}]
MERGED_STORES = [("a", "Mine", "a.example", "vtex", False), ("max", "Max", "max.example", "max_constructor", True), ("own", "own", "own.example", "vtex", True), ("z", "Z", "z.example", "kemik", True)]
PAGES = [("tv-55", "televisor 55", "TV 55", "Televisores", "Precios de televisores"), ("ps5", "ps5", "PS5", "Consolas", "Precios de consolas")]
