"""Relevance for tables of queries against the predicate that is compiled for one query."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mercadia import samples
from mercadia.operators import many
from mercadia.operators.relevance import relevant, with_tokens
from mercadia.plans.query import QueryPlan

NAMES = [n for _, n, _ in samples.RELEVANCE] + [
    "Televisor LED 55 pulgadas", "Soporte para TV 55", "Licuadora 500 W roja", "Vaso para licuadora", "Cafetera 12 tazas", "Filtro para la cafetera", "Motor para uso con la licuadora", "Consola PS5 slim",
    "Juego PS5", "PlayStation 5 consola", "Aire acondicionado portátil 12000 BTU", "Aire acondicionado split", "Secadora de cabello 2000w", "Boquilla para secadora de pelo", "Owala termo 24 oz", "Funda para botella Owala",
    "Owala FreeSip", "Tenis Nike 42", "Zapatillas deportivas rojas", "Camiseta azul", "Pañales etapa 4", "Galletas para perro 500 g", "termo 500ml", "termo 500", "Pintura roja 28 ml", "ring 28 azul", "ring 128 azul", "x28 ring",
    "Anillo٢٨ ring 28٣", "", "para", "para para tele", "PARA  USO CON EL LOS televisores", "blender negro", "superlicuadorax", "tv", "xtv ledy", "Mochila backpack negra", "café molido", "plancha alisadora", "a b", "xa by", None,
]
QUERIES = [q for q, _, _ in samples.RELEVANCE] + [
    "televisor 55", "licuadora", "licuadora roja", "de para", "", "   ", "owala", "owala termo", "ps5", "playstation 5", "aire acondicionado", "ac portatil", "aire acondicionado portatil", "secadora de pelo", "termo 500", "ring 28", "28",
    "cafetera", "soporte tv", "filtro", "tenis", "playera azul", "panales", "galletas para perro", "cafe", "plat", "mochila negra", "PAÑALES", "a b", "no such thing", "plancha de pelo", "tele",
]


def brute(spark, names, queries, plans=None):
    plans = plans or [None] * len(queries)
    tagged = with_tokens(spark.createDataFrame([(n,) for n in names], "name string"))
    verdicts = [relevant(q, F.col("name_norm"), F.col("name_toks"), p).alias(f"q{k}") for k, (q, p) in enumerate(zip(queries, plans, strict=True))]
    return {(k, r["name"]) for r in tagged.select("name", *verdicts).collect() for k in range(len(queries)) if r[f"q{k}"]}


def matched(spark, names, rows, schema):
    offers = spark.createDataFrame([(n, "clash") for n in names], "name string, query string").repartition(3)
    got = many.match_table(offers, spark.createDataFrame(rows, schema)).collect()
    found = {(r["query_id"], r["name"]) for r in got}
    return found, len(got)


@pytest.mark.parametrize("limits", [None, (5, 3, 1)])
def test_against_one_query(spark, limits, monkeypatch):
    names, queries = list(dict.fromkeys(NAMES)), list(dict.fromkeys(QUERIES))
    if limits:  # salted keys, joins by shuffle, and names that meet their queries by broadcast
        for name, value in zip(("SALT_ROWS", "BROADCAST_ROWS", "CROWD"), limits, strict=True):
            monkeypatch.setattr(many, name, value)
    expect = brute(spark, names, queries)
    found, n = matched(spark, names, list(enumerate(queries)), "query_id int, query string")
    assert found == expect and n == len(expect) > 150


def test_plans(spark):
    names = list(dict.fromkeys(NAMES))
    plans = [
        QueryPlan("licuadora", "licuadora", [], [["blender", "licuadora roja"], ["500 w", "vaso"]], ["cafetera", "roja"]), QueryPlan("tele", "tele", [], [["tv", "a b"]], ["soporte", "licuadora 500"]), QueryPlan("tv led", "tv led", [], [["tv led"], ["55", "ledy"]], []),
        QueryPlan("tenis nike", "", [], [["tenis"]], ["tenis"]), QueryPlan("x", "x", [], [[""], ["tv"]], [""]), QueryPlan("de", "de", [], [["tv"]], ["tv"]), QueryPlan("y", "y", [], [["superlicuadora", "28"]], []),
    ]
    kind = "query_id int, query string, plan struct<required_any_groups: array<array<string>>, exclude_terms: array<string>>"
    found, n = matched(spark, names, [(k, p.original_query, (p.required_any_groups, p.exclude_terms)) for k, p in enumerate(plans)] + [(99, "ring", None)], kind)
    assert {x for x in found if x[0] < 99} == brute(spark, names, [p.original_query for p in plans], plans)
    assert n == len(found) and {x[1] for x in found if x[0] == 99} >= {"ring 28 azul"}


def test_random_names(spark):
    draw = random.Random(3)
    pool = "tv televisor licuadora para la soporte 55 500 w ml rojo roja red negro perro galletas termo ps5 consola owala aire acondicionado portatil x55 licua playstation 5 uso con".split()
    names = list({" ".join(draw.choices(pool, k=draw.randint(1, 6))) for _ in range(300)})
    queries = list({" ".join(draw.choices(pool, k=draw.randint(1, 3))) for _ in range(60)})
    expect = brute(spark, names, queries)
    found, n = matched(spark, names, list(enumerate(queries)), "query_id int, query string")
    assert found == expect and n == len(expect)


def test_cheapest_and_empty(spark):
    rows = [(n, float(p), k) for k, (n, p) in enumerate(itertools.product(["red widget", "Red Widget", "blue widget", None], [3, 1, 2, 1]))]
    offers = spark.createDataFrame(rows, "name string, price double, pos int")
    queries = spark.createDataFrame([(1, "widget"), (2, "rojo"), (3, "azul"), (4, "none")], "query_id int, query string")
    got = {r["query_id"]: (r["price"], r["pos"]) for r in many.cheapest(offers, queries, "pos").collect()}
    assert got == {1: (1.0, 1), 2: (1.0, 1), 3: (1.0, 9)}
    assert many.match_table(offers.limit(0), queries).count() == 0 == many.match_table(offers, queries.limit(0)).count()
