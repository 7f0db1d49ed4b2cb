"""Readings of shelves over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import families, history, merges, signals
from ..operators.rounds import written
from .tables import GOODS_SQL, SHELF_SQL, goods, shelf

WITH = "WITH" + SHELF_SQL
#: Debuts of goods: strains are told by their number alone.  Shops are read once a week, so none is a window.
WITH_DEBUTS = "WITH" + GOODS_SQL + """, known AS (SELECT key, regexp_replace(key, ' (flower|smalls)$', '') AS strain, min(day) AS known, count(DISTINCT lic) AS shelves FROM shelf GROUP BY key),
        begun AS (SELECT lic, min(day) AS begun FROM shelf GROUP BY lic),
        near AS (SELECT DISTINCT c.key, k.known FROM candidates c JOIN known k USING (key) JOIN sweeps a ON a.day = c.seen JOIN sweeps b ON b.day = k.known WHERE state = 'confirmed' AND a.sweep - b.sweep <= 2),
        debuts AS (SELECT k.key, k.known AS first, k.strain, k.shelves FROM near n JOIN known k USING (key)
          WHERE (SELECT bool_and(begun < s.day) FROM shelf s JOIN begun USING (lic) WHERE s.key = k.key AND s.day = k.known)
          AND NOT EXISTS (SELECT 1 FROM known o WHERE o.strain = k.strain AND o.known < k.known)),
        heads AS (SELECT * FROM debuts QUALIFY row_number() OVER (PARTITION BY strain ORDER BY first, shelves DESC, key) = 1),
        kin AS (SELECT h.key AS head, h.first, k.key AS member FROM heads h JOIN known k ON k.strain = h.strain)"""


def _last_day(readings):
    """The last sweep as a literal: one value, fetched once."""
    return F.lit(readings.agg(F.max("day").alias("d")).first()["d"])


def shop_reads(spark, sf_dir):
    return history.reads(shelf(spark, sf_dir)).select("lic", "day", "sweep", "size", "r1", "r2")


def shelf_activity(spark, sf_dir):
    return history.activity(shelf(spark, sf_dir)).select("lic", "day", "size", "new", "added", "departed", "unsteady", "rewritten", "trusted")


def _like(a, b):
    return names.similar(F.concat(F.lit("|"), a), F.concat(F.lit("|"), b))


def arrivals(spark, sf_dir):
    return history.candidates(shelf(spark, sf_dir), _like)


def _branded(spark, sf_dir):
    """Readings of keys with a brand in front, and which version read on which day."""
    rows = shelf(spark, sf_dir).withColumn("key", F.concat((F.col("key").cast("int") % 3).cast("string"), F.lit("|"), "key"))
    return rows, rows.select("day", F.floor(F.dayofmonth("day") / 2).alias("reader")).distinct()


def deeper_reads(spark, sf_dir):
    rows, readers = _branded(spark, sf_dir)
    return history.activity(rows, readers).where("deeper").select("lic", "day", "new", "departed", "trusted")


def rescued_arrivals(spark, sf_dir):
    rows, readers = _branded(spark, sf_dir)
    return history.candidates(rows, readers=readers).groupBy("seen", "state").agg(F.count("*").alias("n"))


def presence(spark, sf_dir):
    return history.presence(shelf(spark, sf_dir))


def confirmed_waves(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    day = _last_day(rows)
    found = history.candidates(rows, _like).where("state = 'confirmed'")
    return history.waves(history.signed(found, rows).join(history.windowed(rows, day), "lic", "left_anti"), day, "signature")


def wave_series(spark, sf_dir):
    return history.wave_series(history.candidates(shelf(spark, sf_dir)).where("state in ('confirmed', 'flicker')"))


def windowed_shops(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return history.windowed(rows, _last_day(rows)).select("lic", "reads", F.round("turn", 9).alias("turn"))


def running_low_or_gone(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return history.low_or_gone(rows, _last_day(rows), _like).select("key", "peak", "peak_day", "now", "state")


def peak_presence(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return history.peaks(history.presence(rows), history.sweeps(rows), _last_day(rows)).select("key", "peak", "peak_day", "now")


def quiet_streaks(spark, sf_dir):
    return history.quiet(history.activity(shelf(spark, sf_dir))).select("lic", "quiet_reads", "changed", "reads", "last_read", "size")


def shop_vitality(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return history.vitality(rows, _last_day(rows)).select("lic", "state", "size", "quiet_reads", "quiet_days", "dry_days", "last_read")


def shelf_signatures(spark, sf_dir):
    from ..functions.keys import shelf_signature

    rows = shelf(spark, sf_dir)
    return rows.groupBy("lic", "day").agg(shelf_signature(F.col("key")).alias("signature"))


def identical_shelves(spark, sf_dir):
    signed = shelf_signatures(spark, sf_dir)
    return signed.groupBy("day", "signature").agg(F.count("*").alias("shops")).where("shops > 1")


def standing_per_day(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    spans = history.presence(rows).select(F.concat_ws("|", "lic", "key").alias("k"), "first", "last")
    return merges.covering(spans, history.sweeps(rows), "k")


def _figures(spark, sf_dir):
    """Readings with a figure: an event's value, to a tenth of itself."""
    from .tables import table

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("lic"), F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("key"), F.round("value", 1).alias("thc"))
    return rows.where("key is not null")


def market_figures(spark, sf_dir):
    return signals.market_figures(_figures(spark, sf_dir))


def figure_shifts(spark, sf_dir):
    return signals.shifts(_figures(spark, sf_dir)).select("lic", "key", "seen", F.size("old").alias("n_old"), F.size("figures").alias("n_new"))


def new_batches(spark, sf_dir):
    return signals.new_batches(_figures(spark, sf_dir))


def debuts(spark, sf_dir):
    rows = written(goods(spark, sf_dir))
    return families.debuts(rows, families.alike_pairs(families.first_seen(rows)))


def debut_families(spark, sf_dir):
    rows = written(goods(spark, sf_dir))
    known = families.first_seen(rows)
    pairs = families.alike_pairs(known)
    carried = rows.groupBy("key").agg(F.countDistinct("lic").alias("shelves"))
    return families.families(families.debuts(rows, pairs).join(carried, "key"), known, pairs)


def debut_list(spark, sf_dir):
    rows = written(goods(spark, sf_dir))
    return families.debut_list(rows, _last_day(rows)).withColumn("keys", F.array_join("keys", ","))


def deliveries(spark, sf_dir):
    rows = shelf(spark, sf_dir)
    return signals.deliveries(rows, _last_day(rows))


def interpolated_values(spark, sf_dir):
    from .tables import table

    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("event_id") % 10).alias("m"))
    known, points = events.where("m = 0"), events.where("m <> 0")
    out = merges.asof_between(points, known, "user_id", "event_id", "value")
    return out.select("user_id", "event_id", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round("value", 6).alias("value"))




def _same(a, b):
    """The same batch, in DuckDB, of figures to a tenth: equal, or a whole number and what rounds or is cut to it."""
    return f"(round(abs({a} - {b}), 2) < 0.1 OR ({a} = floor({a}) AND {b} <> floor({b}) AND {a} IN (floor({b}), floor({b} + 0.5))) OR ({b} = floor({b}) AND {a} <> floor({a}) AND {b} IN (floor({a}), floor({a} + 0.5))))"


#: Shops of which a window is seen, in DuckDB.
PARTIAL = """, t AS (SELECT lic, day, least(added, departed) / size AS turn FROM activity, today WHERE day BETWEEN d - 13 AND d AND r1_size > 0 AND size / r1_size BETWEEN 1 / 1.25 AND 1.25),
        tr AS (SELECT lic, turn, row_number() OVER (PARTITION BY lic ORDER BY turn, day) AS k, count(*) OVER (PARTITION BY lic) AS n FROM t),
        part AS (SELECT lic FROM tr WHERE n >= 4 AND k = (n - 1) // 2 + 1 AND turn >= 0.1)"""

ALL = {
    "shop_reads": (shop_reads, WITH + "SELECT lic, day, sweep, size, r1, r2 FROM reads"),
    "shelf_activity": (shelf_activity, WITH + "SELECT lic, day, size, new, added, departed, unsteady, rewritten, trusted FROM activity"),
    "arrivals": (arrivals, WITH + "SELECT lic, key, seen, returned, state, CASE WHEN state = 'confirmed' THEN next_day END AS confirmed FROM candidates"),
    "presence": (presence, WITH + "SELECT lic, key, first, last FROM spans"),
    "confirmed_waves": (
        confirmed_waves,
        WITH + PARTIAL + """, sig AS (SELECT lic, day AS seen, string_agg(key, ',' ORDER BY key) AS s FROM shelf GROUP BY ALL)
        SELECT key, count(DISTINCT s) AS shelves, min(seen) AS first FROM candidates JOIN sig USING (lic, seen), today WHERE state = 'confirmed' AND seen BETWEEN d - 6 AND d AND lic NOT IN (SELECT lic FROM part) GROUP BY key HAVING count(DISTINCT s) >= 3""",
    ),
    "wave_series": (
        wave_series,
        WITH + """, a AS (SELECT DISTINCT key, seen, lic FROM candidates WHERE state IN ('confirmed', 'flicker'))
        SELECT x.key, x.seen, CAST(count(DISTINCT y.lic) AS INTEGER) AS shelves FROM (SELECT DISTINCT key, seen FROM a) x JOIN a y ON x.key = y.key AND y.seen BETWEEN x.seen - 6 AND x.seen GROUP BY ALL""",
    ),
    "windowed_shops": (
        windowed_shops,
        WITH + """, t AS (SELECT lic, day, least(added, departed) / size AS turn FROM activity, today
          WHERE day BETWEEN d - 13 AND d AND r1_size > 0 AND size / r1_size BETWEEN 1 / 1.25 AND 1.25),
        r AS (SELECT lic, turn, row_number() OVER (PARTITION BY lic ORDER BY turn, day) AS k, count(*) OVER (PARTITION BY lic) AS n FROM t)
        SELECT lic, n AS reads, round(turn, 9) AS turn FROM r WHERE n >= 4 AND k = (n - 1) // 2 + 1 AND turn >= 0.1""",
    ),
    "peak_presence": (
        peak_presence,
        WITH + """, n AS (SELECT key, s.day, count(*) AS n FROM spans JOIN sweeps s ON s.day >= first AND (last IS NULL OR s.day <= last), today WHERE s.day BETWEEN d - 13 AND d GROUP BY ALL),
        p AS (SELECT key, n AS peak, day AS peak_day FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, day) = 1)
        SELECT p.*, w.now FROM p JOIN (SELECT key, count(*) FILTER (last IS NULL) AS now FROM spans GROUP BY key) w USING (key)""",
    ),
    "running_low_or_gone": (
        running_low_or_gone,
        WITH + PARTIAL + """, sure AS (SELECT s.* FROM spans s LEFT JOIN activity a ON a.lic = s.lic AND a.r1 = s.last WHERE last IS NULL OR a.trusted),
        safe AS (SELECT * FROM sure WHERE lic NOT IN (SELECT lic FROM part)),
        n AS (SELECT key, s.day, count(*) AS n FROM safe JOIN sweeps s ON s.day >= first AND (last IS NULL OR s.day <= last), today WHERE s.day BETWEEN d - 13 AND d GROUP BY ALL),
        p AS (SELECT key, n AS peak, day AS peak_day FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, day) = 1),
        w AS (SELECT key, count(*) FILTER (last IS NULL) AS stands, max(last) AS seen FROM safe GROUP BY key HAVING count(*) >= 3),
        b AS (SELECT key, count(*) AS behind FROM sure WHERE last IS NULL AND lic IN (SELECT lic FROM part) GROUP BY key)
        SELECT * FROM (SELECT key, peak, peak_day, stands + coalesce(behind, 0) AS now, CASE WHEN stands + coalesce(behind, 0) BETWEEN 1 AND 4 AND peak >= 5 THEN 'low' WHEN stands + coalesce(behind, 0) = 0 AND seen >= d - 13 THEN 'gone' END AS state
        FROM p JOIN w USING (key) LEFT JOIN b USING (key), today WHERE peak >= 3 AND stands < 5) WHERE state IS NOT NULL""",
    ),
    "deeper_reads": (
        deeper_reads,
        WITH + """ SELECT lic, day, new, departed, false AS trusted FROM activity WHERE r1 IS NOT NULL AND day(day) // 2 <> day(r1) // 2 AND new >= 5 AND departed * 3 < new AND size >= 1.1 * greatest(r1_size, 1)""",
    ),
    "rescued_arrivals": (
        rescued_arrivals,
        WITH + """, deep AS (SELECT lic, day FROM activity WHERE r1 IS NOT NULL AND day(day) // 2 <> day(r1) // 2 AND new >= 5 AND departed * 3 < new AND size >= 1.1 * greatest(r1_size, 1)),
        c AS (SELECT c.*, CAST(key AS INTEGER) % 3 AS brand, (lic, seen) IN (SELECT (lic, day) FROM deep) AS deeper FROM candidates c),
        bn AS (SELECT lic, seen, brand, count(*) AS n FROM c WHERE deeper GROUP BY ALL),
        line AS (SELECT lic, seen, brand FROM (SELECT *, sum(n) OVER (PARTITION BY lic, seen) AS total FROM bn) WHERE n >= 3 AND n >= 0.5 * total),
        kept AS (SELECT * FROM c WHERE deeper AND (lic, seen, brand) IN (SELECT (lic, seen, brand) FROM line)),
        others AS (SELECT lic, key, seen AS a, CASE WHEN state = 'confirmed' THEN seen + 6 ELSE least(coalesce(next_day, seen + 7) - 1, seen + 6) END AS z FROM c WHERE NOT deeper UNION ALL SELECT lic, key, seen, seen FROM kept),
        good AS (SELECT seen, state FROM c WHERE NOT deeper UNION ALL SELECT seen, state FROM kept UNION ALL
          SELECT seen, state FROM c WHERE deeper AND (lic, seen, brand) NOT IN (SELECT (lic, seen, brand) FROM line) AND EXISTS (SELECT 1 FROM others o WHERE o.key = c.key AND o.lic <> c.lic AND c.seen BETWEEN o.a AND o.z))
        SELECT seen, state, count(*) AS n FROM good GROUP BY ALL""",
    ),
    "quiet_streaks": (
        quiet_streaks,
        WITH + """, k AS (SELECT *, row_number() OVER (PARTITION BY lic ORDER BY day) AS k FROM activity)
        SELECT lic, CAST(max(k) - max(CASE WHEN k = 1 OR added + departed > 0 THEN k END) AS INTEGER) AS quiet_reads, max(CASE WHEN k = 1 OR added + departed > 0 THEN day END) AS changed,
          CAST(max(k) AS INTEGER) AS reads, max(day) AS last_read, arg_max(size, day) AS size FROM k GROUP BY lic""",
    ),
    "shop_vitality": (
        shop_vitality,
        WITH + """, k AS (SELECT *, row_number() OVER (PARTITION BY lic ORDER BY day) AS k FROM activity),
        q AS (SELECT lic, max(k) - max(CASE WHEN k = 1 OR added + departed > 0 THEN k END) AS quiet_reads, max(CASE WHEN k = 1 OR added + departed > 0 THEN day END) AS changed,
          max(k) AS reads, max(day) AS last_read, min(day) AS first_read, arg_max(size, day) AS size, max(sweep) AS last_sweep FROM k GROUP BY lic),
        l AS (SELECT lic, count(*) AS n, count(*) FILTER (trusted) AS sure FROM activity, today WHERE r1 IS NOT NULL AND day >= d - 13 GROUP BY lic),
        c AS (SELECT lic, max(seen) AS delivered FROM candidates WHERE state IN ('confirmed', 'waiting') GROUP BY lic),
        t AS (SELECT lic, day, least(added, departed) / size AS turn FROM activity, today WHERE day BETWEEN d - 13 AND d AND r1_size > 0 AND size / r1_size BETWEEN 1 / 1.25 AND 1.25),
        r AS (SELECT lic, turn, row_number() OVER (PARTITION BY lic ORDER BY turn, day) AS k, count(*) OVER (PARTITION BY lic) AS n FROM t),
        v AS (SELECT lic, true AS partial FROM r WHERE n >= 4 AND k = (n - 1) // 2 + 1 AND turn >= 0.1),
        f AS (SELECT q.*, partial, d - changed AS still, d - coalesce(delivered, first_read) AS dry, coalesce(n > 0 AND sure >= 0.6 * n, false) AS steady,
          CASE WHEN size >= 30 THEN 0 WHEN size >= 10 THEN 1 ELSE 2 END AS scant, (SELECT max(sweep) FROM sweeps) AS top
          FROM q LEFT JOIN l USING (lic) LEFT JOIN c USING (lic) LEFT JOIN v USING (lic), today),
        g AS (SELECT *, CASE WHEN quiet_reads >= 3 AND still >= 7 THEN 1 + least(scant + CASE WHEN still >= 14 THEN 1 ELSE 0 END, 2) ELSE 0 END AS frozen,
          CASE WHEN NOT steady OR dry < 7 THEN 0 WHEN dry < 14 THEN 1 ELSE 2 END AS dried FROM f)
        SELECT lic, CASE WHEN top - last_sweep >= 3 THEN 'unread' WHEN reads <= 3 THEN 'new' WHEN partial THEN 'partial'
          WHEN frozen > 0 AND frozen >= dried THEN ['quiet', 'asleep', 'dead'][frozen] WHEN dried > 0 THEN ['stale', 'asleep'][dried]
          WHEN steady OR frozen > 0 THEN 'active' ELSE 'unsteady' END AS state, size, CAST(quiet_reads AS INTEGER) AS quiet_reads, CAST(still AS INTEGER) AS quiet_days, CAST(dry AS INTEGER) AS dry_days, last_read FROM g""",
    ),
    "shelf_signatures": (shelf_signatures, WITH + "SELECT lic, day, substr(sha1(string_agg(key, chr(10) ORDER BY key)), 1, 10) AS signature FROM shelf GROUP BY lic, day"),
    "identical_shelves": (
        identical_shelves,
        WITH + "SELECT day, signature, count(*) AS shops FROM (SELECT lic, day, substr(sha1(string_agg(key, chr(10) ORDER BY key)), 1, 10) AS signature FROM shelf GROUP BY lic, day) GROUP BY day, signature HAVING count(*) > 1",
    ),
    "standing_per_day": (standing_per_day, WITH + "SELECT s.day, count(*) AS n FROM spans JOIN sweeps s ON s.day >= first AND (last IS NULL OR s.day <= last) GROUP BY s.day"),
    "market_figures": (
        market_figures,
        "WITH f AS (SELECT json_extract_string(props, '$.k') AS key, CAST(ts AS DATE) AS day, round(value, 1) AS thc FROM events) SELECT key, thc, min(day) AS first FROM f WHERE key IS NOT NULL AND thc > 0 AND thc <> floor(thc) GROUP BY key, thc",
    ),
    "figure_shifts": (
        figure_shifts,
        WITH + """, f AS (SELECT user_id AS lic, json_extract_string(props, '$.k') AS key, CAST(ts AS DATE) AS day, coalesce(list_sort(list(DISTINCT round(value, 1)) FILTER (round(value, 1) > 0)), []) AS figures
          FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL),
        g AS (SELECT *, lag(day) OVER w AS before, lag(figures) OVER w AS old FROM f WINDOW w AS (PARTITION BY lic, key ORDER BY day))
        SELECT lic, key, g.day AS seen, CAST(len(old) AS INTEGER) AS n_old, CAST(len(figures) AS INTEGER) AS n_new FROM g JOIN reads USING (lic, day) WHERE before = r1 AND len(figures) > 0 AND figures <> old""",
    ),
    "new_batches": (
        new_batches,
        WITH + """, f AS (SELECT user_id AS lic, json_extract_string(props, '$.k') AS key, CAST(ts AS DATE) AS day, coalesce(list_sort(list(DISTINCT round(value, 1)) FILTER (round(value, 1) > 0)), []) AS figures
          FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL),
        g AS (SELECT *, lag(day) OVER w AS before, lag(figures) OVER w AS old, lead(day) OVER w AS after, lead(figures) OVER w AS next_figures FROM f WINDOW w AS (PARTITION BY lic, key ORDER BY day)),
        x AS (SELECT g.*, r.sweep, r.next_day, r.next_sweep, coalesce(before = r.r1 AND len(old) > 0 AND len(figures) > 0, false) AS compared FROM g JOIN reads r USING (lic, day) JOIN activity a USING (lic, day) WHERE NOT a.unsteady AND NOT a.rewritten),
        y AS (SELECT *, CASE WHEN compared THEN list_filter(figures, lambda v: v <> floor(v) AND len(list_filter(old, lambda o: SAME(v, o))) = 0) END AS fresh FROM x),
        wild AS (SELECT lic, day FROM y WHERE compared GROUP BY ALL HAVING count(*) FILTER (len(fresh) > 0) >= 5 AND count(*) FILTER (len(fresh) > 0) > 0.3 * count(*)),
        z AS (SELECT y.*, unnest(CASE WHEN c.key IS NOT NULL THEN list_filter(figures, lambda v: v <> floor(v)) WHEN compared THEN fresh END) AS thc
          FROM y LEFT JOIN candidates c ON c.lic = y.lic AND c.key = y.key AND c.seen = y.day WHERE (y.lic, y.day) NOT IN (SELECT (lic, day) FROM wild)),
        s AS (SELECT lic, key, day, thc, next_day, CASE WHEN next_sweep IS NULL THEN CASE WHEN (SELECT max(sweep) FROM sweeps) - sweep < 3 THEN 'waiting' ELSE 'expired' END WHEN next_sweep - sweep > 3 THEN 'expired'
          WHEN after = next_day AND len(list_filter(next_figures, lambda v: SAME(v, thc))) > 0 THEN 'confirmed' ELSE 'flicker' END AS state FROM z),
        m AS (SELECT key, thc AS known, min(day) AS first FROM (SELECT key, day, unnest(figures) AS thc FROM f) WHERE thc <> floor(thc) GROUP BY ALL)
        SELECT lic, s.key, day AS seen, thc, state, CASE WHEN state = 'confirmed' THEN next_day END AS confirmed FROM s JOIN m ON m.key = s.key AND first < day GROUP BY ALL HAVING NOT bool_or(SAME(thc, known))""".replace("SAME(v, o)", _same("v", "o")).replace("SAME(v, thc)", _same("v", "thc")).replace("SAME(thc, known)", _same("thc", "known")),
    ),
    "debuts": (debuts, WITH_DEBUTS + " SELECT key, first FROM debuts"),
    "debut_families": (debut_families, WITH_DEBUTS + " SELECT head, first, member FROM kin"),
    "debut_list": (
        debut_list,
        WITH_DEBUTS + """, c AS (SELECT key AS member, count(*) FILTER (last IS NULL) AS stands, count(*) AS shelves FROM spans GROUP BY key),
        n AS (SELECT head, any_value(first) AS first, arg_max(member, (stands, shelves, head = member, member)) AS named, string_agg(member, ',' ORDER BY member) AS keys FROM kin JOIN c USING (member) GROUP BY head),
        p AS (SELECT head, lic, bool_or(last IS NULL) AS stands FROM kin JOIN spans ON key = member GROUP BY ALL),
        s AS (SELECT head, count(*) AS seen_at, count(*) FILTER (stands) AS now FROM p GROUP BY head)
        SELECT head AS key, keys, named, first, CAST(d - first AS INTEGER) AS days, seen_at, now FROM n JOIN s USING (head), today WHERE now > 0 OR d - first < 7""",
    ),
    "deliveries": (
        deliveries,
        WITH + "SELECT lic, max(seen) AS delivered, CAST(any_value(d) - max(seen) AS INTEGER) AS dry_days FROM candidates, today WHERE state IN ('confirmed', 'waiting') GROUP BY lic",
    ),
    "interpolated_values": (
        interpolated_values,
        """WITH p AS (SELECT user_id, event_id FROM events WHERE event_id % 10 <> 0), k AS (SELECT user_id, event_id AS x, value AS y FROM events WHERE event_id % 10 = 0),
        j AS (SELECT p.*, (SELECT max_by(y, x) FROM k WHERE k.user_id = p.user_id AND x <= event_id) AS b, (SELECT max(x) FROM k WHERE k.user_id = p.user_id AND x <= event_id) AS bx,
          (SELECT min_by(y, x) FROM k WHERE k.user_id = p.user_id AND x >= event_id) AS a, (SELECT min(x) FROM k WHERE k.user_id = p.user_id AND x >= event_id) AS ax FROM p)
        SELECT user_id, event_id, round(b, 6) AS before, round(a, 6) AS after, round(coalesce(b + (a - b) * (event_id - bx) / (ax - bx), b, a), 6) AS value FROM j""",
    ),
}
