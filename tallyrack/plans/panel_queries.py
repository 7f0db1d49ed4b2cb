"""Lab panels, batches and lists of moves over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history, lots, panels
from .tables import SHELF_SQL, listings, shelf, table


def _items(spark, sf_dir):
    return listings(spark, sf_dir)


def panel_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("CASE l_linenumber % 3 WHEN 0 THEN 'LAB_COA' WHEN 1 THEN 'MENU_LISTING' ELSE 'REFERENCE' END AS source", "CASE l_orderkey % 3 WHEN 0 THEN 'HTTPS://lab/1' WHEN 1 THEN 'see label' END AS url")
    source, url = F.col("source"), F.col("url")
    return rows.groupBy(panels.provenance(source, url).alias("provenance"), panels.lab_only(source, url).alias("lab")).agg(F.count("*").alias("n"))


def strains_text(spark, sf_dir):
    rows = _items(spark, sf_dir).select("l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") > 45).alias("sample"))
    return panels.strains_text(rows, "l_suppkey", "name", "ord", F.col("sample"))


def batch_panels(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE concat(CAST(l_partkey AS STRING), '/', CAST(CAST(round(l_discount * 100) AS INT) AS STRING)) END AS panel", "l_orderkey * 10 + l_linenumber AS listing")
    return panels.batch_panels(rows, "panel", "listing", "l_suppkey", "listing")


def same_batch_report(spark, sf_dir):
    rows = _items(spark, sf_dir).select((F.col("p_size") * 100 + F.round(F.col("l_discount") * 100).cast("int")).alias("panel"), "l_suppkey", F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("brand"))
    return panels.same_batch_report(rows, "panel", "l_suppkey", "brand")


def package_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "array(concat('p', CAST(o_custkey % 300 AS STRING)), concat('r', CAST(o_custkey % 50 AS STRING)), CAST(NULL AS STRING)) AS tags")
    redirects = table(spark, sf_dir, "part").where("p_partkey < 40").selectExpr("concat('r', CAST(p_partkey AS STRING)) AS link", "concat('p', CAST(p_partkey AS STRING)) AS tag")
    packages = table(spark, sf_dir, "part").selectExpr("concat('P', CAST(p_partkey AS STRING)) AS tag", "p_partkey % 3 <> 0 AS found", "p_brand AS facility")
    return panels.packages_of(rows, redirects, packages, "o_orderkey", "tags").select("o_orderkey", "tag", "facility")


def tagged_lots(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("p_brand").alias("key"), F.round("l_quantity", 0).alias("thc"), "l_partkey", "l_returnflag")
    lots = rows.where("l_returnflag = 'R'").select("key", "thc").distinct()
    return panels.tagged_lots(lots, rows.where("l_returnflag = 'A'").select("key", "thc", F.col("l_partkey").alias("tag")).distinct()).groupBy("key", "thc").agg(F.count("*").alias("tags"))


def seen_names(spark, sf_dir):
    rows = _items(spark, sf_dir)
    standing = rows.where("l_quantity > 25").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("shops"))
    return panels.names_seen(rows.select("l_partkey", "p_type"), standing, "l_partkey", "p_type", 3).select("l_partkey", "name")


def lot_names(spark, sf_dir):
    rows = _items(spark, sf_dir).select("l_partkey", F.lower("p_name").alias("strain"), F.col("p_brand").alias("head"), F.when((F.col("l_partkey") % 3 == 0) | (F.col("l_linenumber") == 1), F.concat_ws(" ", "p_brand", "p_name")).otherwise(F.col("p_name")).alias("name"))
    return panels.lot_names(rows, "l_partkey", "strain", "name", "head")


def expiring(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("CASE o_custkey % 4 WHEN 0 THEN concat('Expiring in ', CAST(o_orderkey % 30 AS STRING), ' days; expires in 9 days') WHEN 1 THEN 'expiring in 1 day!' WHEN 2 THEN 'expired' END AS d")
    return rows.groupBy(panels.expires_in(F.col("d")).alias("days")).agg(F.count("*").alias("n"))


def recent_batches(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("p_brand").alias("key"), F.col("p_size").alias("thc"), F.col("l_suppkey").alias("lic"), F.to_date("l_shipdate").alias("seen"))
    return panels.recent_batches(rows, F.lit("1996-06-15").cast("date"))


def carrying_shops(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("p_name").alias("key"), F.col("l_suppkey").alias("lic"), F.col("l_quantity").alias("thc"), "l_returnflag")
    return panels.carrying(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'")).groupBy("key", "thc").agg(F.count("*").alias("shops"))


def batch_days(spark, sf_dir):
    rows = _items(spark, sf_dir).select(F.col("p_name").alias("key"), F.col("l_suppkey").alias("lic"), F.col("l_quantity").alias("thc"), F.to_date("l_shipdate").alias("day"), "l_returnflag")
    found = panels.first_on_shelf(rows.where("l_returnflag = 'R'"), rows.groupBy("key", "lic").agg(F.min("day").alias("first")), rows.groupBy("key", "lic", "thc").agg(F.min("day").alias("first")))
    return found.groupBy("key", "exact").agg(F.count("*").alias("n"), F.min("since").alias("earliest"))


def enriched_moves(spark, sf_dir):
    shelves = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("CAST(p_partkey AS STRING) AS key", "p_brand AS brand", "p_name AS name", "concat('s', CAST(p_partkey AS STRING)) AS slug")
    moves = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_partkey AS STRING) AS key", "CASE WHEN p_partkey % 3 = 0 THEN array('none', CAST(p_partkey + 1 AS STRING), CAST(p_partkey + 3 AS STRING)) END AS keys", "upper(p_brand) AS brand", "concat(' ', p_name) AS name")
    return panels.enriched(moves, shelves).select("id", "slug")


def kept_history(spark, sf_dir):
    spans = history.presence(shelf(spark, sf_dir))
    return panels.kept_history(spans, F.lit("2024-03-25").cast("date"))


def kept_reads(spark, sf_dir):
    return panels.kept_reads(shelf(spark, sf_dir).select("lic", "day").distinct())


def seeded_debuts(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return panels.seeded(history.presence(rows), history.candidates(rows)).groupBy("known", "debut").agg(F.count("*").alias("keys"))


def listed_moves(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "p_name AS name", "p_size AS now", "p_size % 7 AS shelves", "p_size * 2 AS peak", "p_type AS lineage")
    return panels.ordered_moves(rows, "now", "PROMO").select("name", "now", "shelves").limit(10)


def ranked_compounds(spark, sf_dir):
    """An order's lines as a profile: brands as compounds, quantities as figures, some of them unknown."""
    rows = listings(spark, sf_dir).where("l_linenumber <= 4").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.expr("concat('C', l_partkey % 3)").alias("name"), F.expr("if(l_partkey % 5 = 0, null, if(l_partkey % 7 = 0, 0.0D, l_partkey % 11))").alias("percent")))).alias("p"))
    return rows.select("l_orderkey", F.array_join(lots.ranked_profile(F.col("p")), ",").alias("ranked"))


def natural_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('Bätch ', CAST(p_partkey AS STRING), if(p_partkey % 3 = 0, '000000000000', ''), ' ', p_name) AS name")
    return rows.withColumn("sort_key", panels.natural(F.col("name"))).select("p_partkey", "sort_key")


L = "l AS (SELECT *, l_orderkey * 10 + l_linenumber AS ord FROM lineitem JOIN part ON l_partkey = p_partkey)"
ALL = {
    "panel_provenance": (
        panel_provenance,
        "SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'LAB_COA' WHEN l_linenumber % 3 = 2 THEN 'REFERENCE' WHEN l_orderkey % 3 = 0 THEN 'MENU_WITH_CERTIFICATE' ELSE 'MENU_LISTING' END AS provenance, l_linenumber % 3 = 0 OR l_orderkey % 3 = 0 AS lab, count(*) AS n FROM lineitem GROUP BY ALL",
    ),
    "strains_text": (
        strains_text,
        f"WITH {L}, f AS (SELECT l_suppkey, lower(p_name) AS fold, min(ord) AS o, arg_min(CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END, struct_pack(a := ord, b := CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END)) AS line, min(struct_pack(a := ord, b := CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END)) AS m FROM l WHERE NOT l_quantity > 45 GROUP BY ALL) SELECT l_suppkey, string_agg(line, chr(10) ORDER BY m) AS names FROM f GROUP BY l_suppkey",
    ),
    "batch_panels": (
        batch_panels,
        "SELECT CASE WHEN l_linenumber % 5 = 0 THEN CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) ELSE l_partkey || '/' || CAST(round(l_discount * 100) AS INT) END AS batch, count(DISTINCT l_suppkey) AS shops, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY batch",
    ),
    "same_batch_report": (
        same_batch_report,
        "SELECT *, CASE WHEN brands <= 1 THEN 'clean' ELSE 'mixed' END AS kind FROM (SELECT CAST(p_size * 100 + round(l_discount * 100) AS INTEGER) AS panel, count(DISTINCT l_suppkey) AS shops, count(DISTINCT CASE WHEN p_size % 3 > 0 THEN p_brand END) AS brands, count(*) AS rows FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE shops > 1",
    ),
    "package_tags": (
        package_tags,
        "WITH t AS (SELECT DISTINCT o_orderkey, unnest([o_custkey % 300, CASE WHEN o_custkey % 50 BETWEEN 1 AND 39 THEN o_custkey % 50 END]) AS k FROM orders) SELECT o_orderkey, 'P' || k AS tag, p_brand AS facility FROM t JOIN part ON p_partkey = k WHERE p_partkey % 3 <> 0",
    ),
    "tagged_lots": (
        tagged_lots,
        f"WITH {L}, a AS (SELECT DISTINCT p_brand AS key, round(l_quantity, 0) AS thc FROM l WHERE l_returnflag = 'R') SELECT key, thc, count(DISTINCT l_partkey) AS tags FROM a JOIN l ON p_brand = key AND round(l_quantity, 0) = thc AND l_returnflag = 'A' GROUP BY ALL",
    ),
    "seen_names": (seen_names, f"WITH {L} SELECT l_partkey, min(p_type) AS name FROM l GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) FILTER (l_quantity > 25) >= 3"),
    "lot_names": (lot_names, f"WITH {L} SELECT DISTINCT l_partkey, p_name AS name FROM l"),
    "expiring": (
        expiring,
        "SELECT CAST(CASE o_custkey % 4 WHEN 0 THEN least(o_orderkey % 30, 9) WHEN 1 THEN 1 END AS INTEGER) AS days, count(*) AS n FROM orders GROUP BY 1",
    ),
    "recent_batches": (recent_batches, f"WITH {L} SELECT p_brand AS key, p_size AS thc, count(DISTINCT l_suppkey) AS shops, min(CAST(l_shipdate AS DATE)) AS since FROM l WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-06-09' AND DATE '1996-06-15' GROUP BY ALL"),
    "carrying_shops": (
        carrying_shops,
        f"WITH {L}, b AS (SELECT DISTINCT p_name AS key, l_quantity AS thc FROM l WHERE l_returnflag = 'R') SELECT key, thc, count(DISTINCT l_suppkey) AS shops FROM b JOIN l ON p_name = key AND l_quantity = thc AND l_returnflag = 'N' GROUP BY ALL",
    ),
    "batch_days": (
        batch_days,
        f"WITH {L}, b AS (SELECT DISTINCT p_name AS key, l_quantity AS thc FROM l WHERE l_returnflag = 'R'), s AS (SELECT p_name AS key, l_suppkey AS lic, min(CAST(l_shipdate AS DATE)) AS stood FROM l GROUP BY ALL), f AS (SELECT p_name AS key, l_suppkey AS lic, l_quantity AS thc, min(CAST(l_shipdate AS DATE)) AS since FROM l GROUP BY ALL) SELECT key, since > stood AS exact, count(*) AS n, min(since) AS earliest FROM b JOIN f USING (key, thc) JOIN s USING (key, lic) GROUP BY ALL",
    ),
    "enriched_moves": (
        enriched_moves,
        "WITH s AS (SELECT p_partkey AS k, lower(p_brand) AS b, lower(p_name) AS n FROM part WHERE p_partkey % 2 = 0), d AS (SELECT b, n, min('s' || k) AS slug FROM s GROUP BY ALL) SELECT p_partkey AS id, coalesce(CASE WHEN p_partkey % 2 = 0 THEN 's' || p_partkey END, CASE WHEN p_partkey % 3 = 0 AND p_partkey + 1 IN (SELECT k FROM s) THEN 's' || (p_partkey + 1) WHEN p_partkey % 3 = 0 AND p_partkey + 3 IN (SELECT k FROM s) THEN 's' || (p_partkey + 3) END, d.slug) AS slug FROM part LEFT JOIN d ON lower(p_brand) = d.b AND lower(p_name) = d.n",
    ),
    "kept_history": (kept_history, f"WITH {SHELF_SQL} SELECT * FROM spans WHERE last IS NULL OR last >= DATE '2024-01-25'"),
    "kept_reads": (kept_reads, f"WITH {SHELF_SQL} SELECT lic, day FROM (SELECT DISTINCT lic, day FROM shelf) QUALIFY row_number() OVER (PARTITION BY lic ORDER BY day DESC) <= 8"),
    "seeded_debuts": (
        seeded_debuts,
        f"WITH {SHELF_SQL}, k AS (SELECT key, min(first) AS known FROM spans GROUP BY key) SELECT known, EXISTS (SELECT 1 FROM candidates c WHERE c.key = k.key AND c.seen = k.known AND c.state = 'confirmed') AS debut, count(*) AS keys FROM k GROUP BY ALL",
    ),
    "listed_moves": (listed_moves, "SELECT p_name AS name, p_size AS now, p_size % 7 AS shelves FROM part WHERE p_type = 'PROMO' ORDER BY now DESC, shelves DESC, name LIMIT 10"),
    "ranked_compounds": (
        ranked_compounds,
        """WITH c AS (SELECT l_orderkey, l_linenumber, 'C' || (l_partkey % 3) AS name, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 7 = 0 THEN 0 ELSE l_partkey % 11 END AS percent FROM lineitem WHERE l_linenumber <= 4),
        o AS (SELECT l_orderkey, name, min(l_linenumber) AS place, max(percent) AS percent FROM c GROUP BY ALL HAVING count(DISTINCT percent) + CASE WHEN count(percent) < count(*) THEN 1 ELSE 0 END = 1),
        m AS (SELECT *, max(coalesce(percent, 0)) OVER (PARTITION BY l_orderkey) > 0 AS measured FROM o)
        SELECT l_orderkey, coalesce(string_agg(name, ',' ORDER BY CASE WHEN measured THEN -percent END, place, name) FILTER (WHERE NOT measured OR percent > 0), '') AS ranked
        FROM (SELECT DISTINCT l_orderkey FROM c) LEFT JOIN m USING (l_orderkey) GROUP BY l_orderkey""",
    ),
    "natural_names": (natural_names, """WITH n AS (SELECT p_partkey, CAST(p_partkey AS HUGEINT) * CASE WHEN p_partkey % 3 = 0 THEN 1000000000000 ELSE 1 END AS n, p_name FROM part)
        SELECT p_partkey, 'batch ' || lpad(CAST(len(CAST(n AS VARCHAR)) AS VARCHAR), 6, '0') || n || ' ' || p_name AS sort_key FROM n"""),
}
