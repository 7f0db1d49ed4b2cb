"""The given tables as the shapes that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a listing: the supplier's shelf carries the part."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate", "l_returnflag")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type", "p_size")
    return items.join(parts, "l_partkey")


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with nation and region."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))


def shelf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: a user's shelf on a day holds the keys of that day's events."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lic"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("key"))
    return rows.where("key is not null").distinct()


def goods(spark: SparkSession, sf_dir: str, weeks: int = 5) -> DataFrame:
    """Line items as readings a week: a supplier's shelf holds what it shipped in the last weeks.
    Three parts are one strain in different packages, and a brand has every 25th strain."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("lic"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"), F.col("l_partkey").cast("bigint").alias("part")).distinct()
    days = F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda k: F.date_add("week", 7 * k))
    strain = F.expr("part div 3")
    number = F.regexp_replace(strain.cast("string"), "([0-9])", "$1x")  # equal digits do not stand together
    package = F.get(F.array(F.lit(""), F.lit(" flower"), F.lit(" smalls")), (F.col("part") % 3).cast("int"))
    key = F.concat(F.lit("brand"), F.lpad((strain % 25).cast("string"), 2, "0"), F.lit("|item "), number, package)
    return items.select("lic", key.alias("key"), F.explode(days).alias("day")).distinct()


#: The same readings in DuckDB, with each shop's previous and next ones; queries add to it.
SHELF_SQL = """
shelf AS (
  SELECT DISTINCT user_id AS lic, CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS key
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
), sweeps AS (
  SELECT day, row_number() OVER (ORDER BY day) AS sweep FROM (SELECT DISTINCT day FROM shelf)
), reads AS (
  SELECT lic, day, sweep, size, lag(day) OVER w AS r1, lag(day, 2) OVER w AS r2, lead(day) OVER w AS next_day,
    lag(sweep) OVER w AS r1_sweep, lead(sweep) OVER w AS next_sweep, lag(size) OVER w AS r1_size
  FROM (SELECT lic, day, count(*) AS size FROM shelf GROUP BY lic, day) JOIN sweeps USING (day)
  WINDOW w AS (PARTITION BY lic ORDER BY day)
), standing AS (
  SELECT s.*, r.sweep, r.r1, r.r2, r.next_day, r.next_sweep FROM (
    SELECT *, lag(day) OVER (PARTITION BY lic, key ORDER BY day) AS before, lead(day) OVER (PARTITION BY lic, key ORDER BY day) AS after FROM shelf
  ) s JOIN reads r USING (lic, day)
), came AS (
  SELECT lic, day, count(*) FILTER (before IS NULL OR (before < r1 AND (r2 IS NULL OR before < r2))) AS new,
    count(*) FILTER (before IS NULL OR before < r1) AS added FROM standing GROUP BY lic, day
), went AS (
  SELECT lic, next_day AS day, count(*) AS departed FROM standing WHERE next_day IS NOT NULL AND (after IS NULL OR after > next_day) GROUP BY ALL
), activity AS (
  SELECT *, NOT (unsteady OR rewritten OR departed > greatest(0.3 * coalesce(r1_size, 0), 5)) AS trusted FROM (
    SELECT r.*, c.new, c.added, coalesce(g.departed, 0) AS departed, r2 IS NULL OR sweep - r1_sweep > 3 AS unsteady,
      new > greatest(0.15 * size, 5) AS rewritten
    FROM reads r JOIN came c USING (lic, day) LEFT JOIN went g USING (lic, day))
), candidates AS (
  SELECT lic, key, day AS seen, before IS NOT NULL AS returned, CASE
      WHEN next_sweep IS NULL THEN CASE WHEN (SELECT max(sweep) FROM sweeps) - sweep < 3 THEN 'waiting' ELSE 'expired' END
      WHEN next_sweep - sweep > 3 THEN 'expired' WHEN after = next_day THEN 'confirmed' ELSE 'flicker' END AS state,
    next_day
  FROM standing JOIN (SELECT lic, day FROM activity WHERE NOT unsteady AND NOT rewritten) USING (lic, day)
  WHERE before IS NULL OR (before < r1 AND (r2 IS NULL OR before < r2))
), spans AS (
  SELECT lic, key, min(day) AS first, CASE WHEN max(day) < max(newest) THEN max(day) END AS last
  FROM (SELECT *, max(day) OVER (PARTITION BY lic) AS newest FROM shelf) GROUP BY lic, key
), today AS (SELECT max(day) AS d FROM shelf)
"""

#: ``goods`` in DuckDB, followed by what is derived from any shelf.
GOODS_SQL = """
shelf AS (
  SELECT DISTINCT l_suppkey AS lic, CAST(date_trunc('week', l_shipdate) AS DATE) + CAST(7 * k AS INTEGER) AS day,
    'brand' || lpad(CAST(l_partkey // 3 % 25 AS VARCHAR), 2, '0') || '|item ' || regexp_replace(CAST(l_partkey // 3 AS VARCHAR), '([0-9])', '\\1x', 'g') || ['', ' flower', ' smalls'][l_partkey % 3 + 1] AS key
  FROM lineitem, range(5) t(k)
)""" + SHELF_SQL[SHELF_SQL.index(", sweeps AS") :]
