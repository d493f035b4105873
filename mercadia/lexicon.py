"""The words that decide relevance: synonyms, aliases, accessories, stopwords and the rules of single products.

They are data, not code: pass another Lexicon to compare in another language or trade.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on exactly these words.

#: Any word of a group stands for the others.
SYNONYMS = [
    "televisor televisores tv tele pantalla television".split(),
    "refrigeradora refrigerador refri nevera".split(),
    "licuadora blender".split(),
    "laptop portatil notebook computadora compu".split(),
    "celular telefono smartphone movil".split(),
    "audifonos auriculares earbuds headphones".split(),
    "lavadora washer".split(),
    "microondas microwave".split(),
    "congelador freezer".split(),
    "aspiradora vacuum".split(),
    "cafetera cafeteras percoladora percoladoras".split(),
    "freidora freidoras airfryer".split(),
    "playera playeras camiseta camisetas tshirt".split(),
    "tenis sneaker sneakers zapatilla zapatillas".split(),
    "mochila mochilas backpack backpacks".split(),
    "lonchera loncheras lunchbox lunchboxes".split(),
    "pachon pachones termo termos".split(),
    "panal panales diaper diapers".split(),
    "negro negra black".split(),
    "blanco blanca white".split(),
    "rojo roja red".split(),
    "rosado rosada rosa pink".split(),
    "azul blue".split(),
    "celeste aqua".split(),
    "verde green".split(),
    "gris gray grey".split(),
    "amarillo amarilla yellow".split(),
    "dorado dorada gold".split(),
    "plateado plateada silver".split(),
    "morado morada purple".split(),
    "cafe marron brown".split(),
    "naranja orange".split(),
    "pelo cabello cabellos hair".split(),
    "secadora secadoras secador secadores secado dryer".split(),
    "alisadora alisadoras alisador alisadores straightener".split(),
    "ps5 playstation5".split(),
    "playstation play ps".split(),
    "perro perros canino caninos canina caninas".split(),
    "treat treats premio premios snack snacks golosina golosinas bocadillo bocadillos galleta galletas".split(),
]

#: Whole phrases that mean the same search.
ALIASES = [
    ["secadora de pelo", "secadora de cabello", "secador de pelo", "secador de cabello", "secador para cabello", "hair dryer"],
    ["plancha de pelo", "plancha de cabello", "plancha para cabello", "plancha alisadora", "alisadora de cabello", "alisador de cabello", "alisadora", "alisador", "hair straightener"],
    ["ps5", "playstation 5", "play station 5", "playstation5", "play 5", "consola ps5", "consola playstation 5", "sony ps5"],
    ["treats para perro", "treats de perro", "premios para perro", "premios para perros", "snacks para perro", "snacks para perros", "golosinas para perro", "golosinas para perros", "galletas para perro", "galletas para perros", "bocadillos para perro", "bocadillos para perros"],
    ["playera", "camiseta", "t-shirt", "t shirt", "tshirt"],
    ["cafetera", "percoladora", "coffee maker", "coffee machine", "maquina de cafe"],
    ["freidora de aire", "air fryer", "airfryer"],
    ["tenis", "zapatos deportivos", "sneakers", "zapatillas deportivas"],
    ["audifonos", "auriculares", "earbuds", "headphones"],
    ["mochila", "backpack"],
    ["lonchera", "lunchbox"],
    ["pachon", "botella de agua", "termo", "water bottle"],
    ["panales", "pañales", "diapers"],
    ["coche de bebe", "coche para bebe", "carreola", "stroller"],
    ["bateria externa", "power bank", "powerbank", "cargador portatil"],
    ["funda para celular", "case para celular", "protector para celular", "phone case"],
    ["comida para perro", "alimento para perro", "concentrado para perro", "dog food"],
    ["comida para gato", "alimento para gato", "concentrado para gato", "cat food"],
]

#: A name with one of these is an accessory, unless the query asks for one.
ACCESSORIES = """
soporte rack base mueble control remoto adaptador cable protector funda montaje pedestal bracket mount antena repuesto
filtro cargador forro case cover kit convertidor extension regulador estuche mica tira luces iluminacion limpiador
limpieza correa vaso jarra removedor cuchilla bolsa bolsas tapa soportes juego juegos videojuego videojuegos game games
dualsense headset audifono audifonos portal remote player visor vr vr2 disco unidad lector libro libros receta recetas
crema shampoo acondicionador tratamiento spray gel gancho ganchos pinza pinzas peine peines cepillo cepillos tornillo
tornillos tornilleria arandela arandelas broca brocas punta puntas porta pad mousepad alfombra alfombras botella
botellas burbujas minnie mickey
""".split()

STOPWORDS = "de para con el la los las y o un una pulgadas plg inch pulg".split()

#: Units that, right after a number, say that it is no size of the product.
UNITS = "ml g gr kg mg mah w watt watts v hz cc".split()

BRAND = "owala"
BRAND_PRODUCTS = "botella botellas pachon pachones termo termos vaso vasos tumbler tumblers mug mugs".split()
BRAND_ACCESSORIES = "funda fundas protector protectora protectores boot boots accesorio accesorios limpiador limpiadores cepillo cepillos repuesto repuestos".split()

#: A query that equals an alias of this needs one of the words in the name.
CONSOLE, CONSOLE_WORDS = "ps5", ["consola", "console"]

#: Queries that equal an alias of these may match "... para <product>".
FOR_PHRASES = ["secadora de pelo", "plancha de pelo", "treats para perro", "comida para perro", "comida para gato"]

COOLER_QUERIES = [["aire", "acondicionado"], ["air", "conditioner"], ["ac", "portatil"], ["ac", "portable"]]
COOLER_NAME = r"\baires?\s+acondicionados?\b|\bair\s+conditioner\b|\bac\s+portatil\b|\bportable\s+ac\b"
COOLER_PORTABLE = ["portatil", "portable"]


@dataclass(frozen=True)
class Lexicon:
    synonyms: list[list[str]] = field(default_factory=lambda: SYNONYMS)
    aliases: list[list[str]] = field(default_factory=lambda: ALIASES)
    accessories: frozenset[str] = frozenset(ACCESSORIES)
    stopwords: frozenset[str] = frozenset(STOPWORDS)

    def group(self, token: str) -> list[str]:
        """The synonyms of a token, itself included."""
        return next((g for g in self.synonyms if token in g), [token])


DEFAULT = Lexicon()
