"""Products out of payloads in the forms that menus send them: VARIANT columns, generators and joins.

A payload is plain JSON, a page that carries JSON in its data script, rows of a page's flight (an id,
a colon and JSON), a flattened graph whose objects name keys and values by index (a turbo stream),
or resources that point at each other by type and id.  Nothing is read row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import written

#: Keys by which an object is taken for a product, and the fields of a product, the first
#: that has a value first; keys of a value that is wrapped in an object.
NAMES, KINDS = ["name", "title", "productname"], ["brand", "category", "type", "kind", "thc", "potencythc", "productcategory", "classificationname"]
FIELDS = {
    "id": ["id", "productid", "sku"], "title": ["name", "title", "productname"], "brand": ["brand", "brandname"],
    "category": ["category", "type", "kind", "productcategoryname", "classificationname"], "lineage": ["straintype", "cannabistype", "lineage"], "thc": ["thc", "potencythc", "thccontent", "thcmax"],
}
WRAPPED = ["value", "name", "title", "label", "range"]
DEPTH = 8
FLIGHT_ROW = r"^[0-9a-f]{1,8}:[\[{]"


def _strings(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def _members(v: Column) -> Column:
    """An object's fields as (key, value); null for anything else."""
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _scalar(v: Column) -> Column:
    """The text of a string, a number or a boolean; null for null, objects and arrays."""
    kind = F.schema_of_variant(v)
    return F.when(~kind.rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, "$", "string"))


def _plain_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), "[^a-z]", "")


def _first_of(names: list[str], of) -> Column:
    """The first value that is not null of ``of`` over names."""
    return F.get(F.filter(F.transform(_strings(names), of), lambda x: x.isNotNull()), 0)


def _field(members: Column, name: Column) -> Column:
    return F.get(F.filter(members, lambda e: _plain_key(e["key"]) == name), 0)["value"]


def _flat(v: Column) -> Column:
    """The text of a value: itself, the first of an array, or what an object wraps."""
    simple = lambda x: F.coalesce(_scalar(x), _scalar(F.get(_items(x), 0)))
    members = _members(v)
    return F.coalesce(simple(v), _first_of(WRAPPED, lambda n: simple(_field(members, n))))


def _product(members: Column) -> Column:
    """Whether an object's fields are those of a product."""
    known = F.transform(members, lambda e: _plain_key(e["key"]))
    return F.arrays_overlap(known, _strings(NAMES)) & F.arrays_overlap(known, _strings(KINDS))


def documents(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, part, v): the JSON documents of each payload; what does not parse is left out."""
    text = F.col(payload)
    script = F.regexp_extract(text, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    rows = F.filter(F.split(text, r"\n(?=[0-9a-f]{1,8}:)"), lambda r: r.rlike(FLIGHT_ROW))
    flight = F.transform(rows, lambda r: F.trim(F.regexp_replace(r, r"^[0-9a-f]{1,8}:", "")))
    parts = F.when(script != "", F.array(script)).when(F.size(flight) > 0, flight).otherwise(F.array(text))
    found = payloads.select(F.col(key).alias("key"), F.posexplode(parts).alias("part", "json"))
    return found.select("key", "part", F.try_parse_json("json").alias("v")).where("v is not null")


def nodes(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, part, path, listed, v): each value inside a document down to ``depth``, the document first.

    ``listed``: it is an item of an array; ``path`` holds places, so it orders the nodes.  JSON in a string
    is opened like an object.  An array that has products is not gone into further."""
    place = lambda i: F.lpad(i.cast("string"), 6, "0")
    kind = "path string, listed boolean, v variant, open boolean"
    rows = docs.select("key", "part", F.lit("").alias("path"), F.lit(False).alias("listed"), "v", F.lit(True).alias("open"))
    for _ in range(depth):
        inner = F.try_parse_json(F.when(F.schema_of_variant(F.col("v")) == "STRING", F.when(F.try_variant_get("v", "$", "string").rlike(r"^[\[{]"), F.try_variant_get("v", "$", "string"))))
        rows = rows.withColumn("w", F.when(F.col("open"), F.coalesce(inner, F.col("v"))).otherwise(F.col("v")))
        items, members = _items(F.col("w")), _members(F.col("w"))
        sold = F.coalesce(F.exists(items, lambda x: _product(_members(x))), F.lit(False))
        child = lambda x, i, listed, on: F.struct(F.concat(F.col("path"), F.lit("/"), place(i)).alias("path"), listed.alias("listed"), x.alias("v"), on.alias("open"))
        below = F.coalesce(
            F.transform(items, lambda x, i: child(x, i, F.lit(True), ~sold)),  # noqa: B023
            F.transform(members, lambda e, i: child(e["value"], i, F.lit(False), F.lit(True))),
            F.array().cast(f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>"),
        )
        self = F.struct("path", "listed", F.col("w").alias("v"), F.lit(False).alias("open"))
        rows = rows.select("key", "part", F.explode(F.when(F.col("open"), F.concat(F.array(self), below)).otherwise(F.array(self))).alias("n")).select("key", "part", "n.*")
    return rows.select("key", "part", "path", "listed", "v")


def _picked(members: Column) -> list[Column]:
    return [_first_of(names, lambda n: _flat(_field(members, n))).alias(c) for c, names in FIELDS.items()]


def products(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, id, title, brand, category, lineage, thc): products in arrays at any depth of JSON, of a page's
    data script or of flight rows."""
    found = nodes(documents(payloads, key, payload)).where("listed").withColumn("members", _members(F.col("v"))).where(_product(F.col("members")))
    return found.select(F.col("key").alias(key), "part", "path", *_picked(F.col("members")))


def graph(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, place, to, v): the values of flattened graphs.  The first line is an array of all values, later
    lines append to it and settle promises.  ``to`` is the place that a value stands for: its own,
    or what a promise was settled with (null if it never was)."""
    lines = F.filter(F.split(payload, "\n"), lambda s: F.trim(s) != "")
    rows = payloads.select(F.col(key).alias("key"), lines.alias("lines")).where(F.size("lines") > 0)
    later = F.filter(F.slice("lines", 2, F.size("lines")), lambda s: s.rlike(r"^P[0-9]+:"))
    rows = rows.select("key", _items(F.try_parse_json(F.get("lines", 0))).alias("head"), later.alias("later")).where("head is not null")
    head = rows.select("key", F.posexplode("head").alias("place", "v"))
    chunks = rows.select("key", F.size("head").alias("n"), F.posexplode("later").alias("nth", "line"))
    chunks = chunks.select("key", "n", "nth", F.regexp_extract("line", "^P([0-9]+):", 1).cast("int").alias("id"), F.try_parse_json(F.regexp_replace("line", "^P[0-9]+:", "")).alias("v"))
    chunks = chunks.withColumn("items", F.coalesce(_items(F.col("v")), F.array().cast("array<variant>")))
    before = F.sum(F.size("items")).over(Window.partitionBy("key").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("begin", F.col("n") + F.coalesce(before, F.lit(0)).cast("int"))
    settled = chunks.select("key", "id", F.coalesce(F.try_variant_get("v", "$", "int"), F.when(F.size("items") > 0, F.col("begin"))).alias("at")).groupBy("key", "id").agg(F.max("at").alias("at"))
    more = chunks.select("key", "begin", F.posexplode("items").alias("i", "v")).select("key", (F.col("begin") + F.col("i")).alias("place"), "v")
    every = head.unionByName(more)
    tag = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$[0]", "string"))
    promised = F.when(tag.isin("P", "Z"), F.try_variant_get("v", "$[1]", "int"))
    every = every.withColumn("id", promised).join(settled, ["key", "id"], "left")
    return written(every.select("key", "place", F.when(F.col("id").isNull(), F.col("place")).otherwise(F.col("at")).alias("to"), "v"))


def turbo_products(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """As ``products``, of flattened graphs, in which objects name their keys and values, and arrays their
    items, by place.  Places are resolved by joins on (payload, place), never inside one row."""
    values = graph(payloads, key, payload)
    number = lambda v: F.try_variant_get(v, "$", "int")
    scalars = values.select("key", "place", _scalar(F.col("v")).alias("text")).where("text is not null")
    items = _items(F.col("v"))
    arrays = values.where((F.size(items) > 0) & number(F.get(items, 0)).isNotNull()).select("key", "place", items.alias("items"))
    listed = arrays.select("key", F.explode("items").alias("i")).select("key", number(F.col("i")).alias("place")).distinct()
    first = arrays.select("key", F.col("place").alias("of"), number(F.get("items", 0)).alias("place"))
    # what stands at a place as text: itself, the first of an array, behind a promise
    hop = lambda df, c: df.join(values.select("key", F.col("place").alias(c), F.col("to").alias("place")), ["key", c])
    texts = scalars.unionByName(hop(first.withColumnRenamed("place", "item"), "item").join(scalars, ["key", "place"]).select("key", F.col("of").alias("place"), "text"))
    texts = written(texts)
    members = values.select("key", "place", F.explode(_members(F.col("v"))).alias("e")).where(F.col("e.key").rlike("^_[0-9]+$"))
    members = members.select("key", F.col("place").alias("of"), F.substring("e.key", 2, 12).cast("int").alias("place"), number(F.col("e.value")).alias("child")).where("child >= 0")
    members = members.join(scalars, ["key", "place"]).select("key", "of", _plain_key(F.col("text")).alias("name"), "child")
    wanted = sorted({n for names in (*FIELDS.values(), NAMES, KINDS, WRAPPED) for n in names})
    members = written(hop(members.where(F.col("name").isin(*wanted)), "child").select("key", "of", "name", "place"))
    rank = lambda names: F.array_position(_strings(names), F.col("name"))
    wrapped = members.where(F.col("name").isin(*WRAPPED)).join(texts, ["key", "place"]).groupBy("key", F.col("of").alias("place")).agg(F.min_by("text", rank(WRAPPED)).alias("text"))
    flat = texts.unionByName(wrapped.join(texts, ["key", "place"], "left_anti"))
    names = members.groupBy("key", "of").agg(F.collect_set("name").alias("names"))
    sold = names.where(F.arrays_overlap("names", _strings(NAMES)) & F.arrays_overlap("names", _strings(KINDS))).select("key", "of")
    sold = sold.join(listed.select("key", F.col("place").alias("of")), ["key", "of"], "left_semi")
    fields = sold.join(members, ["key", "of"]).join(flat, ["key", "place"], "left")
    # the first of a field's names that has a text
    best = [F.min_by(F.when(F.col("name").isin(*n), F.col("text")), F.when(F.col("name").isin(*n) & F.col("text").isNotNull(), rank(n))).alias(c) for c, n in FIELDS.items()]
    return fields.groupBy("key", "of").agg(*best).select(F.col("key").alias(key), F.col("of").alias("part"), F.lit("").alias("path"), *FIELDS)


def resources(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, at, type, id, attributes, related): all objects with a type, an id and attributes; ``at``
    orders them."""
    found = nodes(documents(payloads, key, payload)).withColumn("members", _members(F.col("v")))
    has = lambda n: F.exists("members", lambda e: e["key"] == n)
    found = found.where(has("type") & has("id") & has("attributes"))
    return found.select("key", F.struct("key", "part", "path").alias("at"), F.try_variant_get("v", "$.type", "string").alias("type"), _scalar(F.try_variant_get("v", "$.id", "variant")).alias("id"), _members(F.try_variant_get("v", "$.attributes", "variant")).alias("attributes"), _members(F.try_variant_get("v", "$.relationships", "variant")).alias("related")).where("type is not null and id is not null and attributes is not null")


def resource_products(payloads: DataFrame, key: str, payload: str) -> DataFrame:
    """(id, title, brand, category, lineage, thc): products that are resources, put together by id over all
    payloads: of each attribute the first value that is not null; what a product points at (its
    brand, its category) by the name of the resource."""
    found = resources(payloads, key, payload)
    sold = found.where(F.lower("type").isin("product", "products"))
    attributes = sold.select("id", "at", F.explode("attributes").alias("e")).select("id", "at", _plain_key(F.col("e.key")).alias("name"), _flat(F.col("e.value")).alias("value"), F.lit(0).alias("rank"))
    named = found.select("type", F.col("id").alias("target"), "at", _first_of(NAMES, lambda n: _flat(_field(F.col("attributes"), n))).alias("value")).where("value is not null")
    named = named.groupBy("type", "target").agg(F.min_by("value", "at").alias("value"))
    related = sold.select("id", "at", F.explode("related").alias("e")).select("id", "at", _plain_key(F.col("e.key")).alias("name"), F.try_variant_get("e.value", "$.data.type", "string").alias("type"), _scalar(F.try_variant_get("e.value", "$.data.id", "variant")).alias("target"))
    related = related.join(named, ["type", "target"]).select("id", "at", "name", "value", F.lit(1).alias("rank"))
    every = attributes.where("value is not null").unionByName(related)
    first = every.groupBy("id", "name").agg(F.min_by("value", F.struct("rank", "at")).alias("value")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    picked = [_first_of(names, lambda n: F.col("m")[n]).alias(c) for c, names in FIELDS.items() if c != "id"]
    return sold.select("id").distinct().join(first, "id", "left").select("id", *picked)


def latest(products_: DataFrame, key: str) -> DataFrame:
    """One row a product of a payload: where it is listed several times, as it is first listed."""
    order = F.row_number().over(Window.partitionBy(key, "id", "title").orderBy("part", "path"))
    return products_.withColumn("nth", order).where("nth = 1").drop("nth", "part", "path")
