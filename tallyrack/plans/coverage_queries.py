"""Coverage of the market."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage
from .tables import listings, table


def shelf_smells(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.round("value", 0).alias("v"))
    return coverage.shelf_smells(rows, "user_id", "k", "v", [float(x) for x in range(0, 40)])


def identical_name_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    return coverage.identical_sets(rows, "o_custkey", "o_orderpriority", 3).select("shops").groupBy("shops").agg(F.count("*").alias("sets"))


def opposed_types(spark, sf_dir):
    rows = listings(spark, sf_dir).select("l_suppkey", F.when(F.col("p_type") == "ECONOMY", "SATIVA").when(F.col("p_type") == "SMALL", "INDICA").alias("lineage"))
    return coverage.opposed(rows, "l_suppkey", "lineage")


def order_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return coverage.reasons(rows, ("open", F.col("o_orderstatus") == "O"), ("cheap", F.col("o_totalprice") < 50_000), ("urgent", F.startswith("o_orderpriority", F.lit("1"))))


def strain_priorities(spark, sf_dir):
    return coverage.priorities(listings(spark, sf_dir), ["p_brand", "p_name"], "l_suppkey", 100)


def catalogue_gap(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return coverage.gap_histogram(rows, rows.where("l_returnflag = 'A' and l_quantity > 45"), "l_partkey", "l_suppkey")


def endpoint_gaps(spark, sf_dir):
    reads = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("rows"), F.bool_and(F.col("o_orderstatus") == "F").alias("refused"))
    return coverage.endpoint_gaps(table(spark, sf_dir, "customer"), reads, "c_custkey", "rows", "refused", 5)


def only_values(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).alias("a"), F.when(F.col("o_totalprice") > 300_000, F.col("o_orderpriority")).alias("b"))
    return coverage.unique_or_null(rows, ["o_custkey"], "a", "b")


def brand_coverage(spark, sf_dir):
    return coverage.cumulative_coverage(listings(spark, sf_dir), "p_brand", "l_suppkey", 10)


def overlaid_register(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_nationkey")).alias("nation"))
    found = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))
    return coverage.overlay(base, found, "c_custkey", ["segment", "nation"], ["segment", "nation"])


L = "l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"

ALL = {
    "shelf_smells": (
        shelf_smells,
        "WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS k, round(value, 0) AS v FROM events), n AS (SELECT k, count(DISTINCT user_id) AS n FROM e GROUP BY k), s AS (SELECT user_id, count(*) AS rows, count(DISTINCT e.k) AS names, count(DISTINCT CASE WHEN n = 1 THEN e.k END) AS own, avg(CASE WHEN v IS NOT NULL THEN CASE WHEN v NOT BETWEEN 0 AND 39 THEN 1 ELSE 0 END END) AS odd FROM e JOIN n ON e.k = n.k GROUP BY user_id) SELECT user_id, 'odd-sizes' AS smell FROM s WHERE odd > 0.2 UNION ALL SELECT user_id, 'all-unique' FROM s WHERE names >= 8 AND own > 0.8 * names UNION ALL SELECT user_id, 'tiny' FROM s WHERE rows <= 2",
    ),
    "identical_name_sets": (
        identical_name_sets,
        "WITH s AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, chr(10) ORDER BY o_orderpriority) AS g, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey), c AS (SELECT g, count(*) AS shops FROM s WHERE n >= 3 GROUP BY g HAVING count(*) > 1) SELECT shops, count(*) AS sets FROM c GROUP BY shops",
    ),
    "opposed_types": (opposed_types, f"WITH {L} SELECT l_suppkey FROM l GROUP BY l_suppkey HAVING bool_or(p_type = 'ECONOMY') AND bool_or(p_type = 'SMALL')"),
    "order_reasons": (
        order_reasons,
        "SELECT CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_totalprice < 50000 THEN 'cheap' WHEN starts_with(o_orderpriority, '1') THEN 'urgent' ELSE 'fine' END AS reason, count(*) AS n FROM orders GROUP BY 1",
    ),
    "strain_priorities": (strain_priorities, f"WITH {L} SELECT p_brand, p_name, count(DISTINCT l_suppkey) AS shops, count(*) AS listings FROM l GROUP BY ALL ORDER BY shops DESC, listings DESC, p_brand, p_name LIMIT 100"),
    "catalogue_gap": (
        catalogue_gap,
        "WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS s FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45) GROUP BY l_partkey) SELECT least(s, 10) AS shops, count(*) AS keys FROM g GROUP BY 1",
    ),
    "endpoint_gaps": (
        endpoint_gaps,
        "WITH r AS (SELECT o_custkey, count(*) AS rows, bool_and(o_orderstatus = 'F') AS refused FROM orders GROUP BY o_custkey) SELECT * FROM (SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'never' WHEN refused THEN 'refused' WHEN rows = 0 THEN 'empty' WHEN rows < 5 THEN 'short' END AS gap FROM customer LEFT JOIN r ON c_custkey = o_custkey) WHERE gap IS NOT NULL",
    ),
    "only_values": (
        only_values,
        "WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'P') AS a, list(DISTINCT o_orderpriority) FILTER (o_totalprice > 300000) AS b FROM orders GROUP BY o_custkey) SELECT o_custkey, CASE WHEN len(a) = 1 THEN a[1] WHEN coalesce(len(a), 0) = 0 AND len(b) = 1 THEN b[1] END AS value FROM s",
    ),
    "brand_coverage": (
        brand_coverage,
        f"WITH {L}, t AS (SELECT p_brand, row_number() OVER (ORDER BY count(DISTINCT l_suppkey) DESC, p_brand) AS place FROM l GROUP BY p_brand QUALIFY place <= 10), f AS (SELECT l_suppkey, min(place) AS place FROM l JOIN t USING (p_brand) GROUP BY l_suppkey) SELECT CAST(place AS INTEGER) AS place, CAST(sum(count(f.l_suppkey)) OVER (ORDER BY place) AS BIGINT) AS covered FROM t LEFT JOIN f USING (place) GROUP BY place",
    ),
    "overlaid_register": (
        overlaid_register,
        "WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 OR c_acctbal > 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 2 <> 0 OR c_acctbal > 0 THEN c_nationkey END AS nation FROM customer) SELECT *, CASE WHEN segment IS NOT NULL AND nation IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM b",
    ),
}
