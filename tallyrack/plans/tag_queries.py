"""Printed tags and what is known of them, out of line items: parts are tags, weeks are readings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tags
from ..operators.rounds import written
from .tables import table


def _rows(spark, sf_dir):
    """A part is printed in the weeks in which it was shipped; the first line of an order is an answer."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("tag"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("day"), "l_linenumber", "l_returnflag")
    shelf = items.where("l_linenumber > 1").select("tag", "day").distinct()
    weeks = shelf.select("day").distinct().withColumn("before", F.lag("day").over(Window.orderBy("day")))  # a row a week
    printed = shelf.join(F.broadcast(weeks), "day").select("tag", "day", F.lit("shelf").alias("kind"), F.lit(None).cast("boolean").alias("found"), "before")
    told = items.where("l_linenumber = 1").groupBy("tag", "day").agg(F.min("l_returnflag").alias("f"))
    found = F.when(F.col("f") == "A", True).when(F.col("f") == "R", False)
    return written(printed.unionByName(told.select("tag", "day", F.lit("answer").alias("kind"), found.alias("found"), F.lit(None).cast("date").alias("before"))))


def tag_events(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return tags.events(rows, F.lit(rows.agg(F.max("day").alias("d")).first()["d"]))


def tag_plan(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return tags.asked(rows, rows.where("kind = 'shelf'").agg(F.max("day").alias("d")).first()["d"], 150)


WITH = """WITH i AS (SELECT 'T' || l_partkey AS tag, CAST(date_trunc('week', l_shipdate) AS DATE) AS day, l_linenumber AS n, l_returnflag AS f FROM lineitem),
        weeks AS (SELECT day, lag(day) OVER (ORDER BY day) AS before FROM (SELECT DISTINCT day FROM i WHERE n > 1)),
        answers AS (SELECT tag, day, CASE min(f) WHEN 'A' THEN true WHEN 'R' THEN false END AS found FROM i WHERE n = 1 GROUP BY tag, day),
        r AS (SELECT tag, day, 0 AS k, CAST(NULL AS BOOLEAN) AS found, before FROM (SELECT DISTINCT tag, day FROM i WHERE n > 1) JOIN weeks USING (day) UNION ALL SELECT tag, day, 1, found, NULL FROM answers),
        t AS (SELECT *, max(CASE WHEN k = 1 THEN day END) OVER w AS told_day, max(CASE WHEN k = 0 THEN day END) OVER w AS printed, (SELECT max(day) FROM r) AS until
          FROM r WINDOW w AS (PARTITION BY tag ORDER BY day, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT t.*, a.found AS told, k = 0 AND a.found IS NULL AS waits, lead(t.day) OVER (PARTITION BY t.tag ORDER BY t.day, k) AS next_day FROM t LEFT JOIN answers a ON a.tag = t.tag AND a.day = told_day),
        x AS (SELECT v.*, v.waits AND NOT coalesce(p.waits AND v.printed = v.before, false) AS starts FROM v LEFT JOIN v p ON p.tag = v.tag AND p.day = v.printed AND p.k = 0)"""

ALL = {
    "tag_events": (
        tag_events,
        WITH + """ SELECT tag, day, 'waits' AS event, day AS since FROM x WHERE starts UNION ALL SELECT tag, day, 'answered', NULL FROM answers WHERE found IS NOT NULL
        UNION ALL SELECT tag, day + 30, 'due', NULL FROM x WHERE k = 1 AND NOT found AND day + 30 <= until AND NOT EXISTS (SELECT 1 FROM answers a WHERE a.tag = x.tag AND a.day > x.day AND a.day < x.day + 30)
        UNION ALL SELECT tag, day + 60, 'forgotten', NULL FROM x WHERE CASE WHEN k = 1 THEN found ELSE told END IS NULL AND day + 60 <= until AND (next_day IS NULL OR next_day >= day + 60)""",
    ),
    "tag_plan": (
        tag_plan,
        WITH + """, now AS (SELECT x.*, (SELECT max(s.day) FROM x s WHERE s.tag = x.tag AND s.starts AND s.day <= x.day) AS since FROM x WHERE k = 0 AND day = (SELECT max(day) FROM x WHERE k = 0)),
        fresh AS (SELECT tag, row_number() OVER (ORDER BY since DESC, tag DESC) AS place FROM now WHERE waits), again AS (SELECT tag, row_number() OVER (ORDER BY told_day, tag) AS place FROM now WHERE NOT told AND told_day + 30 <= day),
        n AS (SELECT least((SELECT count(*) FROM again), 150, greatest(30, 150 - (SELECT count(*) FROM fresh))) AS n)
        SELECT tag, 'waits' AS why, CAST(place AS INTEGER) AS place FROM fresh, n WHERE place <= 150 - n UNION ALL SELECT tag, 'again', CAST(place AS INTEGER) FROM again, n WHERE place <= n""",
    ),
}
