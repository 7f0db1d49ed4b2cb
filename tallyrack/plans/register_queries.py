"""The register: customers as a registry's rows, in every form that the mappers know."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import opening
from ..operators import quality, register
from .tables import listings, table


def _pick(by: str, *values: str | None) -> str:
    """SQL of both engines: one of the values, by a number's remainder."""
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values))
    return f"CASE {by} % {len(values)} {cases} END"


#: Inputs, and beside them what they must become.
TYPES = ("CAURD", "Conditional Adult-Use Retail Dispensary", "Microbusiness", "Registered Organization - Adult-Use", "Registered Organization", "Delivery", "On-Site Consumption", "Adult-Use Retail Dispensary License", "Cultivator")
TYPE_KINDS = ("CAURD", "CAURD", "MICROBUSINESS", "REGISTERED_ORGANIZATION_ADULT_USE", "REGISTERED_ORGANIZATION_MEDICAL", "DELIVERY_ONLY", "ONSITE_CONSUMPTION", "ADULT_USE_RETAIL_DISPENSARY", None)
STATUSES = ("Active", "Revoked", "License Surrendered", "Suspended", "Expired", "Provisional", "Pending", None)
STATUS_KINDS = ("ACTIVE", "REVOKED", "SURRENDERED", "SUSPENDED", "EXPIRED", "PROVISIONAL", "PENDING", None)
COUNTIES = ("Kings County", "brooklyn", "New York", "THE BRONX", "westchester", "st. lawrence", " ")
COUNTY_KINDS = ("Kings", "Kings", "New York", "Bronx", "Westchester", "St. Lawrence", None)
REGISTRY = [
    "c_custkey",
    "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('L', CAST(c_custkey - c_custkey % 3 AS STRING)) END AS license",
    "concat(c_name, " + _pick("c_custkey", ", LLC", " Inc.", " Co.", "") + ") AS entity",
    "CASE WHEN c_custkey % 5 = 1 THEN concat('Shop ', CAST(c_custkey AS STRING)) WHEN c_custkey % 5 = 0 THEN 'N/A' END AS dba",
    _pick("c_custkey", *TYPES) + " AS type",
    _pick("c_custkey", *STATUSES) + " AS status",
    _pick("c_custkey", "Permanently Closed", "Temporarily Closed", "Open", None) + " AS operational",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat(CAST(c_custkey % 1000 AS STRING), ' Main St') END AS line1",
    _pick("c_custkey", "Albany", "Troy", None) + " AS city",
    _pick("c_custkey", *COUNTIES) + " AS county",
    _pick("c_custkey", "10001-1234", " 12180", "x") + " AS zip",
    _pick("c_custkey", "shop.com", "https://x.org/a", "none of it") + " AS website",
    _pick("c_custkey", "3/7/2026", "2026-02-30", None) + " AS issued",
    _pick("c_custkey", "Mar 7, 2027", "2027-12-31") + " AS expires",
    "CAST(NULL AS STRING) AS opened",
]
REGISTRY_SQL = f"r AS (SELECT {', '.join(REGISTRY)} FROM customer)"


def registry(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*REGISTRY)


def shop_records(spark, sf_dir):
    out = register.shop_records(registry(spark, sf_dir), F.lit("2026-06-01").cast("timestamp"))
    return out.select("id", "licenseNumber", "licenseType", "licenseStatus", "operationalStatus", "address.county", "address.borough", "address.zip", "contact.website", "dates.licenseIssued", "dates.licenseExpiration")


def retail_scope(spark, sf_dir):
    found = register.retail_scope(registry(spark, sf_dir), register.county(F.col("county")).isin("Kings", "Bronx", "Westchester"), ["dispensary", "caurd", "microbusiness"])
    return found.select("license", "c_custkey", "line1")


BEFORE = ["c_custkey AS license", _pick("c_custkey", "OPEN", "UNKNOWN", "OPEN", None) + " AS status", _pick("c_custkey", "1 A St", "", "2 B St", None, "3 C St") + " AS line1", "CAST('2026-01-01' AS DATE) AS expires"]
AFTER = ["c_custkey AS license", _pick("c_custkey", "OPEN", "OPEN", "UNKNOWN") + " AS status", _pick("c_custkey", "1 A St", "9 Z St", "2 B St", "4 D St") + " AS line1", "CAST('2026-01-01' AS DATE) + CAST(c_custkey % 150 AS INT) AS expires"]


def week_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return register.week_changes(rows.where("c_custkey % 10 <> 0").selectExpr(*BEFORE), rows.where("c_custkey % 12 <> 0").selectExpr(*AFTER), F.lit("2026-02-01").cast("date"))


def licence_locations(spark, sf_dir):
    rows = registry(spark, sf_dir).select("license", "c_custkey", register.county(F.col("county")).alias("county"), register.region(register.county(F.col("county"))).alias("region")).where("license is not null")
    out = register.locations(rows, "license", "c_custkey", "county", "region")
    return out.select("license", "locations", F.array_join("countys", ",").alias("counties"), F.array_join("regions", ",").alias("regions"))


def geocoded_shops(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    point = lambda m: rows.where(f"c_custkey % {m} = 0").select("c_custkey", (F.col("c_acctbal") / m).alias("lat"), (F.col("c_nationkey") / m).alias("lng"))
    return register.geocoded(rows.select("c_custkey"), point(2), point(3), "c_custkey")


def map_points(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name", "s_nationkey", "CASE WHEN s_suppkey % 4 > 0 THEN s_acctbal / 100 END AS lat", "CASE WHEN s_suppkey % 5 > 0 THEN -s_nationkey END AS lng", "s_acctbal > 0 AS open")
    box = register.in_box(F.col("lat"), F.col("lng"), -5, 60, -20, 0)
    return register.map_points(register.narrowed(rows, region=F.col("s_nationkey") < 15, open=F.col("open"), stock=None, box=box), "lat", "lng", "s_suppkey", "s_name")


def territory_shops(spark, sf_dir):
    rows = registry(spark, sf_dir).select("c_custkey", "entity", register.county(F.col("county")).alias("county"), F.when(F.col("c_custkey") % 2 == 0, F.date_add(F.lit("2026-01-01").cast("date"), (F.col("c_custkey") % 40).cast("int"))).alias("opened"))
    found = register.narrowed(rows, county=F.col("county") == "Kings", text=F.contains(F.lower("entity"), F.lit("llc")))
    return register.by_opening(found, "opened", "entity", "c_custkey").select("c_custkey", "county", "opened")


def region_order(spark, sf_dir):
    county = register.county(F.col("county"))
    return registry(spark, sf_dir).groupBy(register.region(county).alias("region"), register.region_rank(register.region(county)).alias("place")).agg(F.count("*").alias("shops")).orderBy("place", "region")


def producer_outreach(spark, sf_dir):
    rows = listings(spark, sf_dir).select(F.col("p_brand").alias("brand"), F.col("l_suppkey").alias("shop"), F.col("p_name").alias("strain"), "l_quantity")
    brands = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("producer"), F.col("p_brand").alias("brand"))
    producers = brands.select("producer").unionByName(table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("producer"))).distinct()
    return register.outreach(producers, brands, rows, F.col("l_quantity") > 49)


def field_coverage(spark, sf_dir):
    rows = registry(spark, sf_dir)
    return register.coverage_change(rows.where("c_custkey % 2 = 0"), rows, "license", "dba", "line1", "issued")


def shared_phones(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(CAST(round(c_acctbal / 50) AS BIGINT) AS STRING) END AS phone")
    return register.used_often(rows, "phone")


READS = [
    "c_custkey AS license", _pick("c_custkey", "no-products", "error-503", "ok", "robots-disallowed") + " AS status",
    _pick("c_custkey", "robots-unreachable", None, "robots-unavailable-503", "denied", "robots-unavailable-403") + " AS robots", "c_nationkey % 2 = 0 AS again", "CASE WHEN c_custkey % 6 = 0 THEN 3 END AS flower",
]


def due_again(spark, sf_dir):
    return register.due_again(table(spark, sf_dir, "customer").selectExpr(*READS))


def fresh_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_partkey % 50 AS document", "concat('https://h/', CAST(l_orderkey AS STRING)) AS url", "l_returnflag")
    return register.new_links(rows.where("l_returnflag = 'R'"), rows, "l_suppkey", "document", F.lit("2026-06-01").cast("date"))


def opted_out(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "CASE c_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag")
    return register.opt_outs(rows, "flag")


def all_pages(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return register.pages_of(shop=(table(spark, sf_dir, "supplier"), "s_suppkey"), brand=(parts, "p_brand"), strain=(parts, "p_name"))


def numbered_rows(spark, sf_dir):
    return register.numbered_keys(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", [F.col("p_partkey")])


def hours_violations(spark, sf_dir):
    slot = "named_struct('open', {}, 'close', {})"
    opens, closes = _pick("c_custkey", "09:00", "18:00", "20:00", None), _pick("c_custkey", "09:00", "02:00", "21:30", "17:00", "09:00", "12:00")
    week = f"map('mon', named_struct('state', 'OPEN', 'slots', array({slot.format(opens, closes)})), 'tue', named_struct('state', 'CLOSED', 'slots', array()))"
    return quality.hours_violations(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{week} as week"), "c_custkey", "week")


def municipality_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", _pick("c_custkey", "BOROUGH", "TOWN", None) + " AS kind", _pick("c_nationkey", "Westchester", "Kings") + " AS county", "CASE WHEN c_custkey % 5 > 0 THEN CAST('2021-12-01' AS DATE) + CAST(c_custkey % 60 AS INT) END AS optOutDate")
    return quality.violations(rows, "c_custkey", quality.municipality_rules())


def reference_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "named_struct('kind', " + _pick("p_partkey", "EXTERNAL_DATASET", "OWN") + ", 'sampleCount', CASE WHEN p_partkey % 7 > 0 THEN p_size % 15 END, 'datasetLicence', " + _pick("p_partkey", "CC-BY", None, "") + ") AS basis",
        "array(named_struct('name', " + _pick("p_partkey", "OTHER", "LIMONENE") + ", 'rawName', " + _pick("p_partkey", "Oxide", None, "") + ")) AS profile", _pick("p_partkey", "HIGH", "LOW", "MEDIUM", "HIGH", None) + " AS confidence",
    )
    return quality.violations(rows, "p_partkey", quality.reference_rules())


def producer_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS licenseNumber", "named_struct('status', " + _pick("s_suppkey", "VERIFIED_OFFICIAL", "OTHER") + ") AS verification", _pick("s_suppkey", "ACTIVE", "EXPIRED", None) + " AS licenseStatus", "s_suppkey % 4 AS locationCount",
        "CASE s_nationkey % 3 WHEN 0 THEN array('Kings', 'Bronx') WHEN 1 THEN array('Erie') END AS counties", "s_name AS entityName", _pick("s_suppkey", "MICROBUSINESS", "MICROBUSINESS", "CULTIVATOR") + " AS licenseType",
        "array(named_struct('name', CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE 'else' END, 'match', " + _pick("s_suppkey", "EXACT", "EXACT", "LIKE", None) + ")) AS brands",
    )
    shops = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS licenseNumber")
    return quality.violations(rows, "licenseNumber", quality.producer_rules()).unionByName(quality.microbusinesses_missing(rows, shops))


def shared_menu_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_custkey % 9 > 0 THEN concat('m', CAST(o_custkey - o_custkey % 2 AS STRING)) END AS menu", "o_orderstatus = 'F' AS marked")
    return quality.shared_menu_violations(rows, "o_orderkey", "o_custkey", "menu", F.col("marked"))


def menu_conflicts(spark, sf_dir):
    """How many listings break the rule on shared menus, which way."""
    return shared_menu_violations(spark, sf_dir).groupBy("rule").agg(F.count("*").alias("n"))


COUNTY = _pick("c_custkey", *COUNTY_KINDS)
BOROUGH = _pick("c_custkey", "Brooklyn", "Brooklyn", "Manhattan", "The Bronx", None, None, None)
REGION = _pick("c_custkey", "Brooklyn", "Brooklyn", "Manhattan", "The Bronx", "Westchester", "St. Lawrence", None)
WEEK = f"WITH b AS (SELECT {', '.join(BEFORE)} FROM customer WHERE c_custkey % 10 <> 0), a AS (SELECT {', '.join(AFTER)} FROM customer WHERE c_custkey % 12 <> 0), j AS (SELECT a.license, a.status AS s, b.status AS t, a.line1 AS x, b.line1 AS y, a.expires FROM a JOIN b ON a.license = b.license) "

#: Hours in every form that the grammar has; beside the queries, SQL works the states out by itself.
HOURS = ("Mon-Fri: 9:00 AM - 9:00 PM; Sat & Sun: Closed", "Fri-Mon: 6:00 PM - 2:00 AM", "Tues, Thurs: 10 AM - 1 PM, 2 PM - 7:30 PM", "Mon: by appointment", None, "Sun: 12:00 PM - 6:00 PM; Mon-Sat: 8:00 AM - 8:00 AM")


def shop_hours(spark, sf_dir):
    """What the text of hours says of each day, a row a customer."""
    rows = opening.with_hours(table(spark, sf_dir, "customer").selectExpr("c_custkey", _pick("c_custkey", *HOURS) + " AS hours"), "hours")
    shown = lambda d: F.when(F.col(f"week.{d}.state") == "CLOSED", "closed").otherwise(F.array_join(F.transform(f"week.{d}.slots", lambda s: F.concat(s["open"], F.lit("-"), s["close"])), " "))
    return rows.select("c_custkey", *[shown(d).alias(d) for d in opening.DAYS], F.array_join("warnings", "|").alias("warnings"))


def open_visits(spark, sf_dir):
    """Whether the customer's shop was open at each of its events, counted by nation and weekday."""
    rows = opening.with_hours(table(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "c_nationkey", _pick("c_custkey", *HOURS) + " AS hours"), "hours")
    met = table(spark, sf_dir, "events").select("user_id", "ts").join(rows.select("user_id", "c_nationkey", "week"), "user_id")
    return opening.open_now(met.withColumn("weekday", opening.ny_weekday(F.col("ts"))), ["c_nationkey", "weekday"], "week", F.col("ts"))


ALL = {
    "shop_records": (
        shop_records,
        f"WITH {REGISTRY_SQL} SELECT regexp_replace(regexp_replace(lower(concat_ws(' ', CASE WHEN c_custkey % 5 = 1 THEN dba ELSE entity END, city)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS id, license AS licenseNumber, {_pick('c_custkey', *TYPE_KINDS)} AS licenseType, {_pick('c_custkey', *STATUS_KINDS)} AS licenseStatus, "
        f"CASE WHEN c_custkey % 4 = 0 THEN 'PERMANENTLY_CLOSED' WHEN c_custkey % 4 = 1 THEN 'TEMPORARILY_CLOSED' WHEN c_custkey % 8 IN (1, 2) THEN 'PERMANENTLY_CLOSED' ELSE 'UNKNOWN' END AS operationalStatus, {COUNTY} AS county, {BOROUGH} AS borough, {_pick('c_custkey', '10001', '12180', None)} AS zip, {_pick('c_custkey', 'https://shop.com', 'https://x.org/a', None)} AS website, "
        "CASE WHEN c_custkey % 3 = 0 THEN DATE '2026-03-07' END AS licenseIssued, CASE WHEN c_custkey % 2 = 0 THEN DATE '2027-03-07' ELSE DATE '2027-12-31' END AS licenseExpiration FROM r",
    ),
    "retail_scope": (
        retail_scope,
        f"WITH {REGISTRY_SQL}, s AS (SELECT * FROM r WHERE {COUNTY} IN ('Kings', 'Bronx', 'Westchester') AND c_custkey % 9 IN (0, 1, 2, 7) AND license IS NOT NULL QUALIFY row_number() OVER (PARTITION BY license ORDER BY length(concat_ws(' ', line1, city, zip)) DESC, coalesce(line1, ''), coalesce(city, '')) = 1) SELECT license, c_custkey, line1 FROM s WHERE line1 IS NOT NULL",
    ),
    "week_changes": (
        week_changes,
        WEEK + "SELECT license, 'new' AS change FROM a WHERE license NOT IN (SELECT license FROM b) UNION ALL SELECT license, 'left' FROM b WHERE license NOT IN (SELECT license FROM a) UNION ALL SELECT license, 'opened' FROM j WHERE t IS DISTINCT FROM 'OPEN' AND s = 'OPEN' UNION ALL SELECT license, 'closed' FROM j WHERE t = 'OPEN' AND s <> 'OPEN' UNION ALL SELECT license, 'moved' FROM j WHERE x <> y AND x <> '' AND y <> '' "
        "UNION ALL SELECT license, 'expired' FROM a WHERE expires < DATE '2026-02-01' UNION ALL SELECT license, 'expiring' FROM a WHERE expires >= DATE '2026-02-01' AND expires <= DATE '2026-04-02'",
    ),
    "licence_locations": (
        licence_locations,
        f"WITH {REGISTRY_SQL}, x AS (SELECT license, c_custkey, {COUNTY} AS county, {REGION} AS region FROM r WHERE license IS NOT NULL), c AS (SELECT license, county, min(c_custkey) AS f FROM x WHERE county IS NOT NULL GROUP BY ALL), g AS (SELECT license, region, min(c_custkey) AS f FROM x WHERE region IS NOT NULL GROUP BY ALL) SELECT license, count(*) AS locations, (SELECT string_agg(county, ',' ORDER BY f) FROM c WHERE c.license = x.license) AS counties, (SELECT string_agg(region, ',' ORDER BY f) FROM g WHERE g.license = x.license) AS regions FROM x GROUP BY license",
    ),
    "geocoded_shops": (geocoded_shops, "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 2 WHEN c_custkey % 3 = 0 THEN c_acctbal / 3 END AS lat, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey / 2 WHEN c_custkey % 3 = 0 THEN c_nationkey / 3 END AS lng, CASE WHEN c_custkey % 2 = 0 THEN 'primary' WHEN c_custkey % 3 = 0 THEN 'fallback' ELSE 'none' END AS found_by FROM customer"),
    "map_points": (map_points, "SELECT s_suppkey, s_name, s_acctbal / 100 AS lat, -s_nationkey AS lng FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 5 > 0 AND s_nationkey < 15 AND s_acctbal > 0 AND s_acctbal / 100 BETWEEN -5 AND 60"),
    "territory_shops": (territory_shops, "SELECT c_custkey, 'Kings' AS county, CASE WHEN c_custkey % 2 = 0 THEN DATE '2026-01-01' + CAST(c_custkey % 40 AS INT) END AS opened FROM customer WHERE c_custkey % 7 < 2 AND (c_custkey % 4 = 0 OR lower(c_name) LIKE '%llc%')"),
    "region_order": (region_order, f"SELECT region, CAST(CASE region WHEN 'Manhattan' THEN 0 WHEN 'Brooklyn' THEN 1 WHEN 'The Bronx' THEN 3 WHEN 'Westchester' THEN 5 ELSE 6 END AS INTEGER) AS place, count(*) AS shops FROM (SELECT {REGION} AS region FROM customer) GROUP BY region"),
    "producer_outreach": (
        producer_outreach,
        "WITH b AS (SELECT DISTINCT p_size % 7 AS producer, p_brand AS brand FROM part), p AS (SELECT DISTINCT producer FROM b UNION SELECT r_regionkey + 100 FROM region), l AS (SELECT p_brand AS brand, l_suppkey AS shop, p_name AS strain, l_quantity > 49 AS told FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT producer, brand, strain, bool_or(told) AS told FROM b JOIN l USING (brand) GROUP BY ALL), "
        "h AS (SELECT producer, count(DISTINCT shop) AS shops FROM b JOIN l USING (brand) GROUP BY producer), c AS (SELECT producer, count(*) AS strains, count(*) FILTER (NOT told) AS undescribed FROM s GROUP BY producer) SELECT producer, coalesce(shops, 0) AS shops, coalesce(strains, 0) AS strains, coalesce(undescribed, 0) AS undescribed FROM p LEFT JOIN h USING (producer) LEFT JOIN c USING (producer)",
    ),
    "field_coverage": (field_coverage, f"WITH {REGISTRY_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) FILTER (c_custkey % 2 = 0) AS before, count({c}) AS after FROM r" for c in ("license", "dba", "line1", "issued"))),
    "shared_phones": (shared_phones, "SELECT CAST(CAST(round(c_acctbal / 50) AS BIGINT) AS VARCHAR) AS phone, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 GROUP BY phone HAVING count(*) > 2"),
    "due_again": (due_again, "SELECT c_custkey AS license, CASE c_custkey % 4 WHEN 0 THEN 'no-products' WHEN 1 THEN 'error-503' ELSE 'robots-disallowed' END AS status FROM customer WHERE (c_custkey % 4 IN (0, 1) AND c_nationkey % 2 = 0 AND c_custkey % 6 <> 0) OR (c_custkey % 4 = 3 AND c_custkey % 5 IN (0, 2))"),
    "fresh_links": (fresh_links, "SELECT l_suppkey, l_partkey % 50 AS document, min('https://h/' || l_orderkey) AS url, DATE '2026-06-01' AS first_seen FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_suppkey = l.l_suppkey AND k.l_partkey % 50 = l.l_partkey % 50) GROUP BY ALL"),
    "opted_out": (opted_out, "SELECT c_name AS name, true AS flag FROM customer WHERE c_nationkey % 3 = 0"),
    "all_pages": (all_pages, "SELECT 'shop' AS kind, CAST(s_suppkey AS VARCHAR) AS key FROM supplier UNION SELECT 'brand', p_brand FROM part UNION SELECT 'strain', p_name FROM part"),
    "numbered_rows": (numbered_rows, "SELECT p_partkey, p_name, CASE WHEN n = 1 THEN p_name ELSE p_name || '~' || n END AS row_key FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)"),
    "hours_violations": (
        hours_violations,
        "WITH h AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 540 WHEN 1 THEN 1080 WHEN 2 THEN 1200 END AS o, [540, 120, 1290, 1020, 540, 720][c_custkey % 6 + 1] AS c FROM customer) SELECT CASE WHEN o = c THEN 'hours-empty' ELSE 'hours-next-day' END AS rule, c_custkey || ':mon:0' AS key, CASE WHEN o = c THEN 'fail' ELSE 'warn' END AS severity FROM h WHERE o = c OR (c < o AND c > 360)",
    ),
    "municipality_violations": (
        municipality_violations,
        "SELECT 'no-borough-there' AS rule, CAST(c_custkey AS VARCHAR) AS key, 'fail' AS severity FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 2 = 0 UNION ALL SELECT 'opt-out-in-time', CAST(c_custkey AS VARCHAR), 'fail' FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 60 > 30",
    ),
    "reference_violations": (
        reference_violations,
        "WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 > 0 THEN p_size % 15 ELSE 0 END AS n, p_partkey % 5 AS c FROM part) SELECT 'borrowed-needs-licence' AS rule, CAST(k AS VARCHAR) AS key, 'fail' AS severity FROM r WHERE k % 2 = 0 AND k % 3 > 0 UNION ALL SELECT 'other-needs-name', CAST(k AS VARCHAR), 'fail' FROM r WHERE k % 2 = 0 AND k % 3 > 0 UNION ALL SELECT 'high-needs-samples', CAST(k AS VARCHAR), 'fail' FROM r WHERE c IN (0, 3) AND n < 10 UNION ALL SELECT 'few-samples-are-low', CAST(k AS VARCHAR), 'fail' FROM r WHERE n <= 1 AND c <> 1",
    ),
    "producer_violations": (
        producer_violations,
        "SELECT 'verified-is-active' AS rule, CAST(s_suppkey AS VARCHAR) AS key, 'fail' AS severity FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 > 0 UNION ALL SELECT 'a-location-a-county', CAST(s_suppkey AS VARCHAR), 'fail' FROM supplier WHERE (s_nationkey % 3 = 0 AND s_suppkey % 4 < 2) OR (s_nationkey % 3 = 1 AND s_suppkey % 4 < 1) UNION ALL SELECT 'exact-is-exact', CAST(s_suppkey AS VARCHAR), 'fail' FROM supplier WHERE s_suppkey % 4 < 2 AND s_suppkey % 3 > 0 "
        "UNION ALL SELECT DISTINCT 'microbusiness-in-register', CAST(s_suppkey AS VARCHAR), 'warn' FROM supplier WHERE s_nationkey % 3 = 0 AND s_suppkey % 3 < 2 AND s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
    ),
    "menu_conflicts": (
        menu_conflicts,
        "WITH r AS (SELECT o_custkey, CASE WHEN o_custkey % 9 > 0 THEN o_custkey - o_custkey % 2 END AS m, o_orderstatus = 'F' AS marked FROM orders), s AS (SELECT m FROM r WHERE m IS NOT NULL GROUP BY m HAVING count(DISTINCT o_custkey) > 1) SELECT CASE WHEN marked THEN 'marked-not-shared' ELSE 'shared-not-marked' END AS rule, count(*) AS n FROM r WHERE marked <> coalesce(m IN (SELECT m FROM s), false) GROUP BY 1",
    ),
    "shop_hours": (
        shop_hours,
        "WITH r AS (SELECT c_custkey, c_custkey % 6 AS k FROM customer), late AS (SELECT '18:00-02:00' AS s), day AS (SELECT '09:00-21:00' AS s), two AS (SELECT '10:00-13:00 14:00-19:30' AS s) "
        "SELECT c_custkey, CASE k WHEN 0 THEN day.s WHEN 1 THEN late.s END AS mon, CASE k WHEN 0 THEN day.s WHEN 2 THEN two.s END AS tue, CASE k WHEN 0 THEN day.s END AS wed, CASE k WHEN 0 THEN day.s WHEN 2 THEN two.s END AS thu, "
        "CASE k WHEN 0 THEN day.s WHEN 1 THEN late.s END AS fri, CASE k WHEN 0 THEN 'closed' WHEN 1 THEN late.s END AS sat, CASE k WHEN 0 THEN 'closed' WHEN 1 THEN late.s WHEN 5 THEN '12:00-18:00' END AS sun, "
        "CASE k WHEN 3 THEN 'Could not parse registry hours for Mon: by appointment' WHEN 5 THEN 'Registry hours have identical open/close for Mon-Sat (08:00); left unknown' ELSE '' END AS warnings FROM r, late, day, two",
    ),
    "open_visits": (
        open_visits,
        "WITH e AS (SELECT user_id, timezone('America/New_York', timezone('UTC', CAST(ts AS TIMESTAMP))) AS l FROM events), v AS (SELECT c_nationkey, c_custkey % 6 AS k, CAST(isodow(l) - 1 AS INTEGER) AS d, hour(l) * 60 + minute(l) AS m FROM e JOIN customer ON user_id = c_custkey), "
        "s AS (SELECT c_nationkey, d, CASE k WHEN 0 THEN CASE WHEN d < 5 AND m >= 540 AND m < 1260 THEN 'open' ELSE 'closed' END "
        "WHEN 1 THEN CASE WHEN (m >= 1080 AND d IN (4, 5, 6, 0)) OR (m < 120 AND d IN (5, 6, 0, 1)) THEN 'open' WHEN d IN (4, 5, 6, 0) THEN 'closed' ELSE 'unknown' END "
        "WHEN 2 THEN CASE WHEN d NOT IN (1, 3) THEN 'unknown' WHEN (m >= 600 AND m < 780) OR (m >= 840 AND m < 1170) THEN 'open' ELSE 'closed' END "
        "WHEN 5 THEN CASE WHEN d < 6 THEN 'unknown' WHEN m >= 720 AND m < 1080 THEN 'open' ELSE 'closed' END ELSE 'unknown' END AS s FROM v) "
        "SELECT c_nationkey, d AS weekday, count(*) FILTER (s = 'open') AS open, count(*) FILTER (s = 'closed') AS closed, count(*) FILTER (s = 'unknown') AS unknown FROM s GROUP BY ALL",
    ),
}
