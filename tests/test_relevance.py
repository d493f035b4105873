from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mercadia.functions.textnorm import normalize, normalized, token_list, tokens
from mercadia.operators.relevance import relevant, with_tokens
from mercadia.plans.query import QueryPlan, clamp, clean_list, query_variants, sanitize, search_queries

GOLDEN = [
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
    ("pantalla 50", "Pantalla 50 ml", False),
]
PLANNED = [
    ("plancha de pelo", [], ["ropa"], "Plancha de Pelo para Ropa", False), ("crema alisadora", [], ["crema"], "Crema Alisadora", True),
    ("plancha de pelo", [["cabello"]], [], "Cabello largo", False), ("rizador", [["tenaza"]], [], "Tenaza Conair", True),
    ("rizador pro", [["tenaza"], ["conair"]], [], "Tenaza Conair", True), ("rizador pro", [["tenaza"], ["philips"]], [], "Tenaza Conair", False),
]


def _verdicts(spark, rows):
    names = with_tokens(spark.createDataFrame([(k, r[-2]) for k, r in enumerate(rows)], "k int, name string")).cache()
    out = {}
    for k, row in enumerate(rows):
        plan = QueryPlan(row[0], row[0], [], row[1], row[2]) if len(row) == 5 else None
        out[k] = names.where(F.col("k") == k).select(relevant(row[0], F.col("name_norm"), F.col("name_toks"), plan)).first()[0]
    return out


def test_golden_names(spark):
    got = _verdicts(spark, GOLDEN)
    assert [r for k, r in enumerate(GOLDEN) if got[k] != r[-1]] == []


def test_golden_plans(spark):
    got = _verdicts(spark, PLANNED)
    assert [r for k, r in enumerate(PLANNED) if got[k] != r[-1]] == []


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("cafetera", ["cafetera", "percoladora", "coffee maker", "coffee machine", "maquina de cafe"]),
        ("ps5", ["ps5", "playstation 5", "play station 5", "playstation5", "play 5", "consola ps5"]),
        ("televisor 55", ["televisor 55"]),
        ("tenis nike", ["tenis nike", "zapatos deportivos nike", "sneakers nike", "zapatillas deportivas nike"]),
        ("  ", []),
    ],
)
def test_search_queries(query, found):
    assert search_queries(query) == found


def test_variants():
    assert query_variants("de la") == [()]
    for q in ("ps5", "consola ps5 negra", "tenis nike", "cafetera"):
        found = query_variants(q)
        assert len(found) <= 16 and len(set(found)) == len(found) and found[0] == tuple(t for t in tokens(q))


def test_plan_rules():
    plan = sanitize({"original_query": "x", "search_queries": ["A  b", "á B", "c" * 81, 5], "required_any_groups": [["q"], [], "no", ["r", "R"]], "confidence": "1.7"})
    assert (plan.search_queries, plan.required_any_groups, plan.confidence, plan.canonical_query) == (["A b", "5"], [["q"], ["r"]], 1.0, "x")
    assert (clamp(-1, 0, 1), clamp("x", 0, 1), clamp(None, 0, 1), clean_list("no", 3)) == (0.0, 0.0, 0.0, [])


def test_normalized_column_agrees_with_python(spark):
    texts = ["Ñandú ÁÉÍÓÚ", "ﬁne Å ø ß", None, "", "İstanbul", "été", "Crème Brûlée 50ml"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", token_list(normalized(F.col("t")))).collect()
    assert all(got == tokens(t) for t, got in rows)
    assert all(normalize(normalize(t)) == normalize(t) for t in texts)


def test_plan_columns_equal_the_driver_forms(spark):
    """The forms over tables of plans give what the forms for one query give."""
    import json
    from dataclasses import asdict

    from pyspark.sql import functions as F

    from mercadia import samples
    from mercadia.plans import columns
    from mercadia.plans import query as plans

    odd = [
        *samples.PLANS, {}, {"search_queries": ["", " a  b ", "A B", "á b", "x" * 81, "x" * 80, 5, None], "confidence": "0.4", "source": ""},
        {"required_any_groups": [["a"], ["b", "B"], "c", ["d"], [], ["e"], ["f"]], "exclude_terms": [f"t{k}" for k in range(40)], "confidence": -3, "original_query": "q", "canonical_query": 0},
        {"required_any_groups": "text", "search_queries": {"a": 1}, "confidence": None, "canonical_query": "c"},
    ]
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(odd)], "id int, body string")
    fallback = F.array(*map(F.lit, plans.search_queries("tenis nike")))
    clean = columns.sanitized(F.col("body"))
    got = rows.select("id", clean.alias("p"), columns.merged(F.lit("tenis nike"), clean, fallback, F.lit("s")).alias("m")).collect()
    for r in got:
        plan = plans.sanitize(odd[r["id"]])
        assert r["p"].asDict(True) == asdict(plan), odd[r["id"]]
        assert r["m"].asDict(True) == asdict(plans.merge("tenis nike", plan, plans.local_plan("tenis nike"), "s"))
    answers = [*samples.RESPONSES, {"output_text": 5, "output": [{"type": "message"}, {"type": "message", "content": [{"text": 3}, {"text": "x"}]}]}, {"output": None}]
    texts = spark.createDataFrame([(k, json.dumps(a)) for k, a in enumerate(answers)] + [(99, "no json"), (98, None)], "id int, body string").select("id", columns.output_text(F.col("body")).alias("t"))
    assert {r["id"]: r["t"] for r in texts.collect()} == {k: plans.output_text(a) for k, a in enumerate(answers)} | {98: "", 99: ""}
