"""One landed payload of each form gives the same products."""

from __future__ import annotations

import json

from tallyrack.sources import payloads

PRODUCTS = [
    {"id": "a1", "Name": "Blue Burst", "brandName": "Steady", "type": "Flower", "strainType": "Hybrid", "THC": {"range": [24.1, 24.1], "unit": "PERCENTAGE"}},
    {"id": "b2", "name": "Grape Cake", "brand": {"name": "Leal"}, "category": {"id": 7, "title": "Flower"}, "cannabisType": "Indica", "potencyThc": 27},
    {"id": "c3", "title": "Unknown \U0001f33f", "brand": None, "kind": "Edible", "thc": None},
]
WANT = {
    ("a1", "Blue Burst", "Steady", "Flower", "Hybrid", "24.1"),
    ("b2", "Grape Cake", "Leal", "Flower", "Indica", "27"),
    ("c3", "Unknown \U0001f33f", None, "Edible", None, None),
}


def flattened(value):
    """A graph of values by index, as such streams send it."""
    values = []

    def put(v):
        at = len(values)
        values.append(None)
        if isinstance(v, dict):
            values[at] = {f"_{put(k)}": put(x) for k, x in v.items()}
        elif isinstance(v, list):
            values[at] = [put(x) for x in v]
        else:
            values[at] = v
        return at

    def fields(v):
        return {k: fields(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [fields(x) for x in v] if isinstance(v, list) else v

    put(fields(value))
    return values


def rows(df, key="page"):
    return {(r["id"], r["title"], r["brand"], r["category"], r["lineage"], r["thc"]) for r in payloads.latest(df, key).collect()}


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page int, body string").repartition(2)


def test_json_at_any_depth(spark):
    deep = {"data": {"menu": {"sections": [{"items": PRODUCTS[:2]}]}, "raw": json.dumps(PRODUCTS[2:])}, "name": "no product", "type": "menu"}
    page = f'<html><script id="__NEXT_DATA__" type="application/json">{json.dumps(deep)}</script></html>'
    for body in (json.dumps(deep), page, json.dumps(PRODUCTS)):
        assert rows(payloads.products(frame(spark, body, None, "", "{torn", "[]", "3"), "page", "body")) == WANT
    assert payloads.products(frame(spark, "x").limit(0), "page", "body").count() == 0


def test_an_array_of_products_is_not_gone_into(spark):
    outer = dict(PRODUCTS[0], variants=[{"name": "1 g", "type": "size"}])
    assert [r["id"] for r in payloads.products(frame(spark, json.dumps([outer])), "page", "body").collect()] == ["a1"]


def test_flight_rows(spark):
    flight = "\n".join(['0:["$","div",null,{}]', '1:I["module",[]]', "2:T5,hello", "3:" + json.dumps({"shelf": PRODUCTS[:2]}), "a:" + json.dumps([["x", {"items": PRODUCTS[2:]}]]), "b:[torn"])
    assert rows(payloads.products(frame(spark, flight), "page", "body")) == WANT


def test_turbo_streams(spark):
    whole = json.dumps(flattened({"loaderData": {"menu": {"items": PRODUCTS}}}))
    assert rows(payloads.turbo_products(frame(spark, whole, None, "{}", "torn"), "page", "body")) == WANT
    # a promise is settled on a later line, whose values are appended
    head = flattened({"menu": "later", "items": PRODUCTS[:1]})
    head[head.index("later")] = ["P", 9]
    tail, start = flattened({"items": PRODUCTS[1:]}), len(head)
    shift = lambda v: {f"_{int(k[1:]) + start}": x + start for k, x in v.items()} if isinstance(v, dict) else [x + start for x in v] if isinstance(v, list) else v
    text = json.dumps(head) + "\nE3:[]\nP9:" + json.dumps([shift(v) for v in tail])
    assert rows(payloads.turbo_products(frame(spark, text), "page", "body")) == WANT
    # a value may itself be settled later
    late = [{"_1": 2}, "items", [3], {"_4": 5, "_6": 7, "_8": 9}, "id", "z", "name", "Zoap", "brand", ["P", 1]]
    assert rows(payloads.turbo_products(frame(spark, json.dumps(late) + '\nP1:["Late"]'), "page", "body")) == {("z", "Zoap", "Late", None, None, None)}


def test_resources(spark):
    """Products put together over payloads, their brand and category by what they point at."""
    to = lambda kind, i: {"data": {"type": kind, "id": i}}
    first = {"data": [{"type": "products", "id": 1, "attributes": {"name": "Blue Burst", "potency_thc": None}, "relationships": {"category": to("product_categories", 7), "brand": to("brands", "9")}}], "included": [{"type": "product_categories", "id": "7", "attributes": {"name": "Flower"}}]}
    second = {"data": [{"type": "products", "id": "1", "attributes": {"potency_thc": 24.1, "name": "Other name"}}, {"type": "products", "id": "2", "attributes": {"title": "Grape Cake", "type": "Edible"}}], "included": [{"type": "brands", "id": 9, "attributes": {"title": "Steady"}}]}
    got = payloads.resource_products(frame(spark, json.dumps(first), json.dumps(second), None), "page", "body").collect()
    assert {tuple(r) for r in got} == {("1", "Blue Burst", "Steady", "Flower", None, "24.1"), ("2", "Grape Cake", None, "Edible", None, None)}


def test_no_python_in_the_plan(spark):
    import contextlib
    import io

    for df in (payloads.products(frame(spark, "[]"), "page", "body"), payloads.turbo_products(frame(spark, "[]"), "page", "body"), payloads.resource_products(frame(spark, "[]"), "page", "body")):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
        assert "Python" not in out.getvalue() and "Arrow" not in out.getvalue()
