"""Matching, merging and comparing tables; data-quality rules; pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, names
from ..operators import audit, index, lots, merges, quality, review
from ..sources import payloads, readers
from .tables import listings, shops, table


def _halves(spark, sf_dir):
    """Two snapshots of a register out of one table: before and after."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.round("c_acctbal", 2).alias("bal"))
    before = c.where("c_custkey % 7 <> 0")
    moved = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    return before, c.where("c_custkey % 11 <> 0").withColumn("c_mktsegment", moved)


def register_changes(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    return merges.changes(before, after, "c_custkey", ["c_nationkey", "c_mktsegment", "bal"])


def refresh_verdict(spark, sf_dir):
    return merges.verdict(register_changes(spark, sf_dir), ["bal"])


def upserted_register(spark, sf_dir):
    before, after = _halves(spark, sf_dir)
    return merges.upsert(after, before, "c_custkey", [], ["c_mktsegment"])


def unique_matches(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.floor(F.col("c_acctbal") / 50).cast("bigint").alias("b"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 50).cast("bigint").alias("b"))
    return merges.one_to_one(a, b, ["n", "b"])


def best_matches(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), "s_acctbal")
    b = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_acctbal")
    # balances within 50 of each other stand in the same or in neighbouring blocks of 50
    block = F.floor(F.col("s_acctbal") / 50)
    a = a.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    b = b.withColumn("block", F.floor(F.col("c_acctbal") / 50))
    score = F.round(1 / (1 + F.abs(F.col("s_acctbal") - F.col("c_acctbal"))), 9)
    return merges.best_match(a, b, ["n", "block"], score, "s_suppkey", "c_custkey", 0.02)


def market_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_shipdate")
    cut = F.lit("1995-06-17").cast("timestamp")
    return merges.market_diff(rows.where(F.col("l_shipdate") < cut), rows.where(F.col("l_shipdate") >= cut), "l_suppkey", "l_partkey")


def carried_listings(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    taken, before = rows.where(F.col("o_orderdate") >= cut), rows.where(F.col("o_orderdate") < cut)
    paused = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return merges.carried(taken, before, "o_custkey", F.col("o_orderdate") < F.lit("1994-01-01").cast("timestamp"), paused)


def registered_only(spark, sf_dir):
    kept, _ = merges.in_register(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("c_custkey")), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")
    return kept


def merged_products(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"ord": (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.round(F.col("l_discount") * 100), "stock": F.col("l_returnflag") == "N", "thc": F.when(F.col("l_discount") > 0, F.col("l_discount"))})
    return merges.merged_sizes(rows, ["l_suppkey", "p_brand"], "ord", "stock", ["thc"], "l_quantity")


def shared_menus(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", keys.menu_identity(F.regexp_replace("url", r"\d+$", "")).alias("menu"))
    return merges.shared(rows, "menu", "page_id").select("owners").groupBy("owners").agg(F.count("*").alias("menus"))


def repeated_panels(spark, sf_dir):
    return merges.repeated_panels(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_tax", "l_partkey")


def foreign_shelves(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.substring(F.round("o_totalprice", 0).cast("bigint").cast("string"), 1, 5).alias("brand"))
    out = merges.foreign_share(rows, "o_custkey", "brand", 3, 0.5)
    return out.select("o_custkey", "brands", "known")


def registry_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", "p_partkey")
    return merges.registry_dedupe(rows, "p_brand", F.col("p_name"), "p_partkey").select("p_brand", "p_partkey")


def exact_or_subset(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    books = table(spark, sf_dir, "part").groupBy(F.lower(F.element_at(F.split("p_name", " "), 1)).alias("book")).agg(F.min("p_partkey").alias("ord")).select(F.col("book").alias("book_key"), "ord")
    return merges.exact_then_subset(parts, books, "name", "book_key", lambda c: F.split(F.col(c), r"\s+"), "ord")


def debut_listings(spark, sf_dir):
    debuts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("debut"), F.collect_set("p_type").alias("keys"))
    by_key = debuts.select("debut", F.explode("keys").alias("p_type")).groupBy("p_type").agg(F.min("debut").alias("debut"))
    return listings(spark, sf_dir).join(by_key, "p_type", "left").groupBy("p_type").agg(F.count("*").alias("n"), F.min("debut").alias("debut"))


def signal_shops(spark, sf_dir):
    signals = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("c_custkey")).distinct()
    rows = signals.join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return rows.groupBy("o_orderpriority", "c_mktsegment").agg(F.count("*").alias("shops"))


def rule_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    rules = [
        quality.Rule("discount-range", F.col("l_discount").between(0, 0.09)),
        quality.Rule("tax-range", F.col("l_tax") <= 0.07, "warn"),
        quality.Rule("flag-known", F.col("l_returnflag").isin("A", "N")),
    ]
    found = quality.violations(rows, "id", rules)
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.min("key").alias("first"))


def duplicate_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"], "user-and-type", "warn")


def orphan_keys(spark, sf_dir):
    return quality.orphans(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").where("c_acctbal > 0"), "user_id", "c_custkey", "user-known")


def page_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", readers.html_title(F.col("html")).alias("title"), F.size(readers.html_links(F.col("html"))).alias("links"))


def page_evidence(spark, sf_dir):
    return readers.page_evidence(table(spark, sf_dir, "pages")).select("page_id", "phone", "links", "provider", "delivery")


def page_products(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("Name"), F.col("value").alias("THC"), F.lit("flower").alias("category"))).alias("items"))).alias("payload"))
    found = payloads.products(rows, "event_id", "payload")
    return found.groupBy("title").agg(F.count("*").alias("n"), F.round(F.sum(F.col("thc").cast("double")), 2).alias("total"))


def _landed(spark, sf_dir):
    """Parts as products of landed payloads, fifty to each, in three forms: below two objects, as JSON in
    a string, and as flight rows."""
    product = F.struct(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("Id"), F.col("p_name").alias("ProductName"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.col("p_type").alias("category"),
        F.struct(F.array(F.col("p_size")).alias("range")).alias("THC"),
    )
    rows = table(spark, sf_dir, "part").groupBy(F.expr("p_partkey div 50").alias("page")).agg(F.to_json(F.collect_list(product)).alias("items"))
    nested, text = F.concat(F.lit('{"data":{"name":"menu","shelves":[{"items":'), "items", F.lit("}]}}")), F.to_json(F.struct(F.struct(F.col("items").alias("raw")).alias("state")))
    flight = F.concat(F.lit('0:["$","div"]\n1:I["m"]\n2:{"shelf":'), "items", F.lit("}"))
    return rows.select("page", F.when(F.col("page") % 3 == 0, nested).when(F.col("page") % 3 == 1, text).otherwise(flight).alias("payload"))


def landed_products(spark, sf_dir):
    found = payloads.products(_landed(spark, sf_dir), "page", "payload")
    return found.select("page", "id", "title", "brand", "category", F.col("thc").cast("int").alias("thc"))


def graph_products(spark, sf_dir):
    """The same parts as a flattened graph: an array of places, then each product and its values."""
    rows = table(spark, sf_dir, "part").select(F.expr("p_partkey div 50").alias("page"), F.expr("p_partkey % 50").alias("n"), "p_partkey", "p_name", "p_brand", "p_type")
    # values 0 to 4 are the list of products and four keys; each product is an object and its four texts
    first = 5 + 5 * (F.col("rank") - 1)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("n")))
    entry = F.format_string('{"_1":%d,"_2":%d,"_3":%d,"_4":%d},"p%d",%s,%s,%s', first + 1, first + 2, first + 3, first + 4, F.col("p_partkey"), *[F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2) for c in ("p_name", "p_brand", "p_type")])
    listed = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), ",").alias("entries"), F.array_join(F.transform(F.array_sort(F.collect_list("rank")), lambda r: 5 + 5 * (r - 1)), ",").alias("places"))
    payload = F.concat(F.lit("[["), "places", F.lit('],"id","name","brand","category",'), "entries", F.lit("]"))
    return payloads.turbo_products(listed.select("page", payload.alias("payload")), "page", "payload").select("page", "id", "title", "brand", "category")


def similar_names(spark, sf_dir):
    """Brands' product names that are alike."""
    rows = table(spark, sf_dir, "part").select("p_brand", F.lower("p_name").alias("name"))
    return review.similar_pairs(rows, "p_brand", "name")


def typo_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", keys.strain_key(F.col("p_name")).alias("a")).distinct()
    return names.typo_pairs(rows, "p_brand", "a", "b")


def batch_lots(spark, sf_dir):
    """Lots of each brand's strain over all shops."""
    rows = listings(spark, sf_dir).select(
        keys.history_key(F.col("p_brand"), F.col("p_name"), F.col("p_brand")).alias("key"), F.col("l_suppkey").alias("shop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.round("l_quantity", 1).alias("thc"),
        F.create_map(F.lit("A"), F.col("l_discount"), F.lit("B"), F.col("p_size") / 100.0).alias("panel"), (F.col("l_returnflag") == "R").alias("certified"),
    )
    return lots.lots(rows.where("key is not null")).select("key", "lot", "thc", "shops", "rows")


def strain_coverage(spark, sf_dir):
    """How many shops carry how many strains, the count capped at 10 and more."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("shops"))
    return rows.groupBy(F.least("shops", F.lit(10)).alias("shops")).agg(F.count("*").alias("strains"))


def unseen_names(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = listings(spark, sf_dir).where("l_returnflag = 'R'").select("p_name").distinct()
    return a.join(rows, "p_name", "left_anti")


def audit_matches(spark, sf_dir):
    """Customers of the register against suppliers of a public list: addresses of number, country and
    street, of which some have a unit or a letter too few.  SQL has no such likeness; the tests
    compare the operator with all pairs."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.initcap("n_name").alias("country"))
    street = lambda key, word: F.concat((F.col(key) % 400).cast("string"), F.lit(" "), F.when(F.col(key) % 7 == 0, F.substring(F.col("country"), F.lit(2), F.length("country"))).otherwise(F.col("country")), F.lit(word))
    shop = lambda key: [F.concat(F.lit("Shop "), (F.col(key) % 30).cast("string"), F.lit(" & Sons")).alias("name"), F.col("country").alias("city"), F.concat(F.lit("1"), F.lpad((F.col(key) % 50).cast("string"), 4, "0")).alias("zip")]
    left = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), street("c_custkey", " Street, Suite 4").alias("address"), *shop("c_custkey"))
    right = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("other"), street("s_suppkey", " St").alias("address"), *shop("s_suppkey"))
    found = audit.weighted_matches(left, right)
    return found.select("id", "other", *[F.round(c, 9).alias(c) for c in ("score", "address_score", "name_score", "city_score")], "zip_equal", "confident")


def territory_union(spark, sf_dir):
    rows = shops(spark, sf_dir).select("s_suppkey", "r_name")
    both = rows.where("r_name = 'ASIA'").withColumn("territory", F.lit("east")).unionByName(rows.where("r_name = 'EUROPE'").withColumn("territory", F.lit("west")))
    return index.by_region(both, "territory")


HALVES = "c AS (SELECT c_custkey, c_nationkey, c_mktsegment, round(c_acctbal, 2) AS bal FROM customer), b AS (SELECT * FROM c WHERE c_custkey % 7 <> 0), a AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, bal FROM c WHERE c_custkey % 11 <> 0)"
CHANGES = (
    HALVES
    + ", d AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' WHEN concat_ws(',', CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN a.bal IS DISTINCT FROM b.bal THEN 'bal' END) <> '' THEN 'changed' ELSE 'same' END AS change, CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN concat_ws(',', CASE WHEN a.c_nationkey IS DISTINCT FROM b.c_nationkey THEN 'c_nationkey' END, CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END, CASE WHEN a.bal IS DISTINCT FROM b.bal THEN 'bal' END) ELSE '' END AS fields FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)"
)
LISTINGS = "l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"

ALL = {
    "register_changes": (register_changes, f"WITH {CHANGES} SELECT * FROM d"),
    "refresh_verdict": (refresh_verdict, f"WITH {CHANGES} SELECT CASE WHEN bool_or(change IN ('added', 'removed') OR (change = 'changed' AND fields <> 'bal')) THEN 'substantive' WHEN bool_or(change = 'changed') THEN 'provenance' ELSE 'none' END AS verdict FROM d"),
    "upserted_register": (upserted_register, f"WITH {HALVES} SELECT a.c_custkey, a.c_nationkey, coalesce(a.c_mktsegment, b.c_mktsegment) AS c_mktsegment, a.bal FROM a LEFT JOIN b USING (c_custkey)"),
    "unique_matches": (
        unique_matches,
        "WITH a AS (SELECT c_custkey, c_nationkey AS n, CAST(floor(c_acctbal / 50) AS BIGINT) AS b FROM customer), s AS (SELECT s_suppkey, s_nationkey AS n, CAST(floor(s_acctbal / 50) AS BIGINT) AS b FROM supplier) SELECT n, b, c_custkey, s_suppkey FROM (SELECT *, count(*) OVER (PARTITION BY n, b) AS k FROM a) x JOIN (SELECT *, count(*) OVER (PARTITION BY n, b) AS k FROM s) y USING (n, b) WHERE x.k = 1 AND y.k = 1",
    ),
    "best_matches": (best_matches, "SELECT s_suppkey, c_custkey, score FROM (SELECT *, round(1 / (1 + abs(s_acctbal - c_acctbal)), 9) AS score FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE score >= 0.02 QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY score DESC, c_custkey) = 1"),
    "market_changes": (
        market_changes,
        "WITH x AS (SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (l_shipdate < TIMESTAMP '1995-06-17') AS n_before, count(DISTINCT l_partkey) FILTER (l_shipdate >= TIMESTAMP '1995-06-17') AS n_after FROM lineitem GROUP BY l_suppkey) SELECT *, CASE WHEN n_before = 0 THEN 'new' WHEN n_after = 0 THEN 'vanished' WHEN n_after * 2 < n_before THEN 'collapsed' WHEN n_after < n_before THEN 'shrank' WHEN n_after > n_before THEN 'grew' ELSE 'same' END AS state FROM x WHERE n_before + n_after > 0",
    ),
    "carried_listings": (
        carried_listings,
        "WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') SELECT * FROM t UNION ALL SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM t) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    ),
    "registered_only": (registered_only, "SELECT event_id, user_id AS c_custkey FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "merged_products": (
        merged_products,
        f"WITH {LISTINGS} SELECT l_suppkey, p_brand, bool_or(l_returnflag = 'N') AS stock, arg_min(l_discount, (l_orderkey * 10 + l_linenumber) * 100 + round(l_discount * 100)) FILTER (l_discount > 0) AS thc, sum(l_quantity) AS l_quantity, count(*) AS n FROM l GROUP BY l_suppkey, p_brand",
    ),
    "shared_menus": (
        shared_menus,
        r"""WITH u AS (SELECT page_id, regexp_replace(url, '[0-9]+$', '') AS u FROM pages),
        m AS (SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www[.]', ''), ':443$|:80$', '')
          || regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/+$', '') || regexp_extract(u, '([?#].*)$', 1) AS menu FROM u)
        SELECT owners, count(*) AS menus FROM (SELECT count(DISTINCT page_id) AS owners FROM m WHERE menu IS NOT NULL GROUP BY menu) WHERE owners > 1 GROUP BY owners""",
    ),
    "repeated_panels": (repeated_panels, "SELECT l_suppkey, l_tax, count(DISTINCT l_partkey) AS strains FROM lineitem WHERE l_tax IS NOT NULL GROUP BY l_suppkey, l_tax HAVING count(DISTINCT l_partkey) >= 5"),
    "foreign_shelves": (
        foreign_shelves,
        "WITH p AS (SELECT DISTINCT o_custkey, substr(CAST(CAST(round(o_totalprice, 0) AS BIGINT) AS VARCHAR), 1, 5) AS brand FROM orders), v AS (SELECT brand, count(*) AS n FROM p GROUP BY brand), s AS (SELECT o_custkey, count(*) AS brands, count(*) FILTER (n > 1) AS known FROM p JOIN v USING (brand) GROUP BY o_custkey) SELECT * FROM s WHERE brands >= 3 AND known / brands < 0.5",
    ),
    "registry_rows": (registry_rows, "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) = 1"),
    "exact_or_subset": (
        exact_or_subset,
        "WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), b AS (SELECT lower(split_part(p_name, ' ', 1)) AS book_key, min(p_partkey) AS ord FROM part GROUP BY 1), e AS (SELECT name, book_key AS book, 'EXACT' AS how FROM n JOIN b ON name = book_key), r AS (SELECT name FROM n WHERE name NOT IN (SELECT name FROM e)) SELECT * FROM e UNION ALL SELECT name, arg_min(book_key, ord) AS book, 'TOKEN_SUBSET' AS how FROM r JOIN b ON list_contains(string_split_regex(name, '\\s+'), book_key) GROUP BY name",
    ),
    "debut_listings": (
        debut_listings,
        f"WITH {LISTINGS}, d AS (SELECT p_brand, min(p_partkey) AS debut FROM part GROUP BY p_brand), k AS (SELECT p_type, min(debut) AS debut FROM (SELECT DISTINCT p_brand, p_type FROM part) JOIN d USING (p_brand) GROUP BY p_type) SELECT l.p_type, count(*) AS n, min(debut) AS debut FROM l LEFT JOIN k ON l.p_type = k.p_type GROUP BY l.p_type",
    ),
    "signal_shops": (signal_shops, "SELECT o_orderpriority, c_mktsegment, count(DISTINCT c_custkey) AS shops FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"),
    "rule_violations": (
        rule_violations,
        "WITH r AS (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem), v AS (SELECT 'discount-range' AS rule, 'fail' AS severity, id FROM r WHERE NOT l_discount BETWEEN 0 AND 0.09 UNION ALL SELECT 'tax-range', 'warn', id FROM r WHERE NOT l_tax <= 0.07 UNION ALL SELECT 'flag-known', 'fail', id FROM r WHERE l_returnflag NOT IN ('A', 'N')) SELECT rule, severity, count(*) AS n, min(id) AS first FROM v GROUP BY ALL",
    ),
    "duplicate_keys": (duplicate_keys, "SELECT 'user-and-type' AS rule, user_id || '|' || event_type AS key, 'warn' AS severity FROM events GROUP BY user_id, event_type HAVING count(*) > 1"),
    "orphan_keys": (orphan_keys, "SELECT DISTINCT 'user-known' AS rule, CAST(user_id AS VARCHAR) AS key, 'fail' AS severity FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"),
    "page_titles": (
        page_titles,
        r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, CAST(len(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS INTEGER) AS links FROM pages""",
    ),
    "page_evidence": (page_evidence, None),
    "page_products": (page_products, "SELECT event_type AS title, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type"),
    "landed_products": (landed_products, "SELECT p_partkey // 50 AS page, 'p' || p_partkey AS id, p_name AS title, p_brand AS brand, p_type AS category, p_size AS thc FROM part"),
    "graph_products": (graph_products, "SELECT p_partkey // 50 AS page, 'p' || p_partkey AS id, p_name AS title, p_brand AS brand, p_type AS category FROM part"),
    "similar_names": (similar_names, None),
    "typo_pairs": (
        typo_pairs,
        "WITH r AS (SELECT DISTINCT p_brand, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS a FROM part), p AS (SELECT x.p_brand, x.a, y.a AS b FROM r x JOIN r y ON x.p_brand = y.p_brand AND x.a < y.a) SELECT * FROM p WHERE levenshtein(a, b) <= CASE WHEN least(length(a), length(b)) >= 9 THEN 2 WHEN least(length(a), length(b)) >= 7 THEN 1 ELSE 0 END AND least(length(a), length(b)) >= 7",
    ),
    # figures are whole there and panels of two compounds are no twins: a lot is a strain's figure
    "batch_lots": (
        batch_lots,
        f"WITH {LISTINGS}, g AS (SELECT p_brand || '|' || lower(p_name) AS key, round(l_quantity, 1) AS thc, count(DISTINCT l_suppkey) AS shops, count(*) AS rows FROM l GROUP BY ALL) SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY thc DESC) - 1 AS INTEGER) AS lot, thc, shops, rows FROM g",
    ),
    "strain_coverage": (strain_coverage, "SELECT least(shops, 10) AS shops, count(*) AS strains FROM (SELECT l_partkey, count(DISTINCT l_suppkey) AS shops FROM lineitem GROUP BY l_partkey) GROUP BY 1"),
    "unseen_names": (unseen_names, f"WITH {LISTINGS} SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM l WHERE l_returnflag = 'R')"),
    "territory_union": (
        territory_union,
        "SELECT territory, count(*) AS shops FROM (SELECT CASE r_name WHEN 'ASIA' THEN 'east' ELSE 'west' END AS territory FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')) GROUP BY territory",
    ),
    "audit_matches": (audit_matches, None),
}
