"""What a sequence of shelf readings says, without a loop over days.

A reading is a row (lic, day, key): on that day the shop was read and had the key on its shelf.
The daily fold's rules are stated here over whole histories with windows, so a replay of any
length is one plan, partitioned by shop or by key; README lists the rules that are not built.  Time
is counted in readings and sweeps (days on which any shop was read), never in wall-clock time.

Keys of functions: lic, day (date), key.  Other names are parameters where it matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import shelf_signature
from .rounds import written

#: Fixed values of the rules.
RECENT_SWEEPS = 3
NEW_SHARE, REWRITE_LEAST = 0.15, 5
GONE_SHARE = 0.3
CONFIRM_WITHIN = 3
WAVE_SHELVES, WAVE_DAYS = 3, 7
MOVES_DAYS, LOW_BELOW, LOW_PEAK, GONE_PEAK = 14, 5, 5, 3
WINDOW_TURN, WINDOW_READS, WINDOW_SIZE = 0.1, 4, 1.25
QUIET_DAYS, ASLEEP_DAYS, QUIET_READS, STALE_DAYS = 7, 14, 3, 7
TRUSTED_SHARE = 0.6
LOPSIDED_LEAST, DEEPER_GROWTH = 5, 1.1
LINEUP_LEAST, LINEUP_SHARE = 3, 0.5
SMALL_SHELF, TINY_SHELF = 30, 10


def sweeps(shelf: DataFrame) -> DataFrame:
    """(day, sweep): days on which any shop was read, numbered.  A row a day, so one window over
    all of it is small whatever the number of readings."""
    return shelf.select("day").distinct().withColumn("sweep", F.row_number().over(Window.orderBy("day")))


def reads(shelf: DataFrame) -> DataFrame:
    """(lic, day, sweep, size, r1, r2, next_day and their sweeps): a shop's readings in order."""
    sizes = shelf.groupBy("lic", "day").agg(F.countDistinct("key").alias("size"))
    # one row a day: small by construction
    sizes = sizes.join(F.broadcast(sweeps(shelf)), "day")
    w = Window.partitionBy("lic").orderBy("day")
    return sizes.withColumns(
        {
            "r1": F.lag("day").over(w), "r2": F.lag("day", 2).over(w), "next_day": F.lead("day").over(w), "next_next_day": F.lead("day", 2).over(w),
            "r1_sweep": F.lag("sweep").over(w), "next_sweep": F.lead("sweep").over(w), "r1_size": F.lag("size").over(w),
        }
    )


def standing(shelf: DataFrame) -> DataFrame:
    """Each reading's row with what stood before: ``before`` is the key's last day on this shelf,
    ``after`` its next one."""
    w = Window.partitionBy("lic", "key").orderBy("day")
    rows = shelf.select("lic", "key", "day").distinct()
    rows = rows.withColumns({"before": F.lag("day").over(w), "after": F.lead("day").over(w)})
    return rows.join(reads(shelf), ["lic", "day"])


def is_new(before: Column, r1: Column, r2: Column) -> Column:
    """Never seen here, or gone for longer than a flicker (not on either of the last two readings)."""
    return before.isNull() | ((before < r1) & (r2.isNull() | (before < r2)))


def activity(shelf: DataFrame, readers: DataFrame | None = None) -> DataFrame:
    """Per reading: size, new, added, departed, how many new keys stood on the next one (``held``),
    and whether its departures can be trusted.

    ``readers``: (day, reader), one row a day: which version read the shelves.  Where it changed and
    a shelf grew in one direction, the menu was read deeper, and nothing was delivered."""
    rows = standing(shelf)
    fresh = F.coalesce(is_new(F.col("before"), F.col("r1"), F.col("r2")), F.lit(True))
    leaves = F.col("next_day").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("next_day")))
    per_reading = ["lic", "day", "sweep", "size", "r1", "r2", "next_day", "r1_sweep", "next_sweep", "r1_size"]
    out = rows.groupBy(*per_reading).agg(
        F.count_if(fresh).alias("new"), F.count_if(F.col("before").isNull() | (F.col("before") < F.col("r1"))).alias("added"),
        F.count_if(fresh & (F.col("after") == F.col("next_day"))).alias("held"), F.count_if(leaves).alias("leaving"),
    )
    # what left is known on the next reading
    out = out.withColumn("departed", F.coalesce(F.lag("leaving").over(Window.partitionBy("lic").orderBy("day")), F.lit(0))).drop("leaving")
    unsteady = F.col("r2").isNull() | (F.col("sweep") - F.col("r1_sweep") > RECENT_SWEEPS)
    rewritten = F.col("new") > F.greatest(NEW_SHARE * F.col("size"), F.lit(float(REWRITE_LEAST)))
    lost = F.col("departed") > F.greatest(GONE_SHARE * F.coalesce("r1_size", F.lit(0)), F.lit(float(REWRITE_LEAST)))
    deeper = F.lit(False)
    if readers is not None:
        # a row a day
        for name in ("day", "r1"):
            out = out.join(F.broadcast(readers.select(F.col("day").alias(name), F.col("reader").alias(f"reader_{name}"))), name, "left")
        changed = F.coalesce(F.col("reader_day") != F.col("reader_r1"), F.lit(False))
        grown = F.col("size") >= DEEPER_GROWTH * F.greatest(F.coalesce("r1_size", F.lit(0)), F.lit(1))
        deeper = changed & (F.col("new") >= LOPSIDED_LEAST) & (F.col("departed") * 3 < F.col("new")) & grown
    out = out.withColumns({"unsteady": unsteady, "rewritten": rewritten, "deeper": deeper, "trusted": ~(unsteady | rewritten | lost | deeper)})
    return out.drop("reader_day", "reader_r1")


def lately_gone(shelf: DataFrame) -> DataFrame:
    """(lic, day, gone): at each reading, keys that stood on one of the two before it and not on it."""
    rows = standing(shelf)
    at = lambda d: F.when(F.col(d).isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col(d))), F.col(d))
    days = F.array_compact(F.array(at("next_day"), at("next_next_day")))
    return rows.select("lic", F.explode(days).alias("day"), F.col("key").alias("gone")).distinct()


def like_others(rows: DataFrame, others: DataFrame, on: list[str], like: Callable[[Column, Column], Column]) -> DataFrame:
    """(on, key): rows that have another key, alike, among ``others`` (on, other).

    The brand in front of a key's bar is part of the join; only where one of the two has none any
    brand will do.  The likeness is found once for each two keys, however often they meet."""
    brand = lambda c: F.when(F.col(c).contains("|"), F.substring_index(c, "|", 1)).otherwise("")
    mine = rows.select(*on, "key").distinct().withColumn("brand", brand("key"))
    theirs = others.select(*on, "other").distinct().withColumn("brand", brand("other"))
    signed, any_brand = F.col("brand") != "", F.col("brand") == ""
    met = mine.where(signed).join(theirs.where(signed), [*on, "brand"]).select(*on, "key", "other")
    met = met.unionByName(mine.where(any_brand).drop("brand").join(theirs.drop("brand"), on)).unionByName(mine.where(signed).drop("brand").join(theirs.where(any_brand).drop("brand"), on))
    met = written(met.where("key <> other"))
    pairs = met.select("key", "other").distinct()
    return met.join(pairs.where(like(F.col("key"), F.col("other"))), ["key", "other"], "left_semi").select(*on, "key").distinct()


def candidates(shelf: DataFrame, like: Callable[[Column, Column], Column] | None = None, readers: DataFrame | None = None, acts: DataFrame | None = None) -> DataFrame:
    """New keys on steady shelves that were not rewritten, and what the next reading made of
    them: confirmed, flicker, expired (not read again in time) or waiting.

    ``like``: a test of two keys; a new key like one that has lately gone is that one renamed.
    ``readers`` as in ``activity``: of a shelf that was read deeper only line-ups are kept (a brand
    with three new keys or more that are half of all), and keys that came on another shelf within
    seven days.  ``acts``: the ``activity`` of the shelf and readers, where it is known already."""
    if like is not None:
        shelf = written(shelf.select("lic", "day", "key").distinct())
    acts = (activity(shelf, readers) if acts is None else acts).where("not unsteady and not rewritten")
    rows = standing(shelf).where(is_new(F.col("before"), F.col("r1"), F.col("r2")))
    came = rows.join(acts.select("lic", "day", "deeper"), ["lic", "day"])
    if like is not None:
        came = written(came)
        same = like_others(came, lately_gone(shelf).withColumnRenamed("gone", "other"), ["lic", "day"], like)
        came = came.join(same, ["lic", "day", "key"], "left_anti")
    if readers is not None:
        came = _rescued(came)
    gap = F.col("next_sweep") - F.col("sweep")
    last = sweeps(shelf).agg(F.max("sweep").alias("last_sweep"))
    came = came.crossJoin(F.broadcast(last)).withColumn("stays", F.col("after") == F.col("next_day"))  # one row
    if like is not None:
        # a key that went on under another name has stayed
        there = standing(shelf).select("lic", F.col("day").alias("next_day"), F.col("key").alias("other"))
        again = like_others(came.where("not coalesce(stays, false)"), there, ["lic", "next_day"], like).withColumn("again", F.lit(True))
        came = came.join(again, ["lic", "key", "next_day"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)) | F.coalesce("again", F.lit(False)))
    state = (
        F.when(gap.isNull(), F.when(F.col("last_sweep") - F.col("sweep") < CONFIRM_WITHIN, "waiting").otherwise("expired"))
        .when(gap > CONFIRM_WITHIN, "expired")
        .when(F.col("stays"), "confirmed")
        .otherwise("flicker")
    )
    return came.select("lic", "key", F.col("day").alias("seen"), F.col("before").isNotNull().alias("returned"), state.alias("state"), F.when(state == "confirmed", F.col("next_day")).alias("confirmed"))


def _rescued(came: DataFrame) -> DataFrame:
    """New keys without those of shelves that were read deeper, but for line-ups and keys that other
    shelves have got too."""
    brand = F.substring_index("key", "|", 1)
    plain, deep = came.where("not deeper"), came.where("deeper").withColumn("brand", brand)
    counted = deep.groupBy("lic", "day", "brand").agg(F.count("*").alias("n"))
    most = counted.groupBy("lic", "day").agg(F.sum("n").alias("total"))
    lineups = counted.join(most, ["lic", "day"]).where((F.col("brand") != "") & (F.col("n") >= LINEUP_LEAST) & (F.col("n") >= LINEUP_SHARE * F.col("total")))
    kept = deep.join(lineups.select("lic", "day", "brand"), ["lic", "day", "brand"], "left_semi")
    rest = deep.join(lineups.select("lic", "day", "brand"), ["lic", "day", "brand"], "left_anti")
    # on other shelves: what came in the week and was confirmed, or has not been settled yet by that day; line-ups of the day
    gap = F.coalesce(F.col("next_sweep") - F.col("sweep"), F.lit(CONFIRM_WITHIN + 1))
    fine = (F.col("after") == F.col("next_day")) & (gap <= CONFIRM_WITHIN)
    others = plain.select(F.col("lic").alias("other"), "key", F.col("day").alias("from_day"), F.when(F.coalesce(fine, F.lit(False)), F.date_add("day", WAVE_DAYS - 1)).otherwise(F.least(F.date_sub(F.coalesce("next_day", F.date_add("day", WAVE_DAYS)), 1), F.date_add("day", WAVE_DAYS - 1))).alias("to_day"))
    others = others.unionByName(kept.select(F.col("lic").alias("other"), "key", F.col("day").alias("from_day"), F.col("day").alias("to_day")))
    met = rest.join(others, "key").where((F.col("lic") != F.col("other")) & F.col("day").between(F.col("from_day"), F.col("to_day")))
    back = rest.join(met.select("lic", "day", "key").distinct(), ["lic", "day", "key"], "left_semi")
    names = plain.columns
    return plain.unionByName(kept.select(*names)).unionByName(back.select(*names))


def presence(shelf: DataFrame) -> DataFrame:
    """(lic, key, first, last): last is null where the key stood on the shop's last reading; the
    first day is kept over returns."""
    newest = shelf.groupBy(F.col("lic").alias("shop")).agg(F.max("day").alias("newest"))
    out = shelf.groupBy("lic", "key").agg(F.min("day").alias("first"), F.max("day").alias("at")).join(newest, F.col("lic").eqNullSafe(F.col("shop")))
    return out.select("lic", "key", "first", F.when(F.col("at") < F.col("newest"), F.col("at")).alias("last"))


def waves(arrivals: DataFrame, day: Column, shelf: str = "lic") -> DataFrame:
    """Keys that arrived on several different shelves in the seven days to ``day``.  ``shelf`` is what
    tells shelves apart: with ``signed`` arrivals, shops that show one shelf count once."""
    recent = arrivals.where((F.col("seen") <= day) & (F.col("seen") >= F.date_sub(day, WAVE_DAYS - 1)))
    return recent.groupBy("key").agg(F.countDistinct(shelf).alias("shelves"), F.min("seen").alias("first")).where(F.col("shelves") >= WAVE_SHELVES)


def signed(arrivals: DataFrame, shelf: DataFrame) -> DataFrame:
    """Arrivals with the signature of the shelf on which they were seen."""
    marks = shelf.groupBy("lic", F.col("day").alias("seen")).agg(shelf_signature(F.col("key")).alias("signature"))
    return arrivals.join(marks, ["lic", "seen"])


def wave_series(arrivals: DataFrame, shelf: str = "lic") -> DataFrame:
    """For every key and day on which it arrived somewhere: on how many shelves in seven days."""
    days = arrivals.select("key", "seen", shelf).distinct()
    # an arrival counts for the days of the week from it on
    reach = days.select("key", shelf, F.explode(F.sequence(F.col("seen"), F.date_add("seen", WAVE_DAYS - 1))).alias("seen"))
    counted = reach.groupBy("key", "seen").agg(F.countDistinct(shelf).cast("int").alias("shelves"))
    return counted.join(days.select("key", "seen").distinct(), ["key", "seen"], "left_semi")


def _turns(day: Column) -> dict[str, Column]:
    """Aggregates over a shop's activity: how many readings of like size in two weeks, and the lower
    median of their turnover.  A shop has one reading a day, so there are at most 14."""
    lately = F.col("day").between(F.date_sub(day, MOVES_DAYS - 1), day)
    like = lately & (F.col("size") > 0) & (F.col("r1_size") > 0) & (F.col("size") / F.col("r1_size")).between(1 / WINDOW_SIZE, WINDOW_SIZE)
    turns = F.sort_array(F.collect_list(F.when(like, F.least("added", "departed") / F.col("size"))))
    middle = F.get(turns, F.floor((F.size(turns) - 1) / 2).cast("int"))
    return {"turns": F.size(turns).cast("bigint"), "turn": middle}


def windowed(shelf: DataFrame, day: Column) -> DataFrame:
    """Shops of which only a window onto a larger menu is seen: at like size, the lower median of
    their turnover in two weeks is a tenth or more."""
    out = activity(shelf).groupBy("lic").agg(*[c.alias(n) for n, c in _turns(day).items()])
    return out.where((F.col("turns") >= WINDOW_READS) & (F.col("turn") >= WINDOW_TURN)).select("lic", F.col("turns").alias("reads"), "turn")


def windowed_on(shelf: DataFrame, asked: DataFrame, acts: DataFrame | None = None) -> DataFrame:
    """``windowed`` as it was on many days: the rows (lic, at) of ``asked`` whose shop was a window on
    the day ``at``.  A row meets the at most 14 readings of its two weeks out of the at most 28 of the
    two numbered fortnights that these touch.  ``acts``: the shelf's ``activity``, where it is known."""
    fortnight = lambda day: F.floor(F.unix_date(day) / MOVES_DAYS)
    low = F.date_sub("at", MOVES_DAYS - 1)
    touched = asked.select("lic", "at").distinct().withColumn("fortnight", F.explode(F.array_distinct(F.array(fortnight(low), fortnight(F.col("at"))))))
    rows = (activity(shelf) if acts is None else acts).withColumn("fortnight", fortnight(F.col("day")))
    rows = rows.join(touched, ["lic", "fortnight"]).where(F.col("day").between(low, F.col("at")))
    out = rows.groupBy("lic", "at").agg(*[c.alias(n) for n, c in _turns(F.col("at")).items()])
    return out.where((F.col("turns") >= WINDOW_READS) & (F.col("turn") >= WINDOW_TURN)).select("lic", "at", F.col("turns").alias("reads"), "turn")


def peaks(spans: DataFrame, days: DataFrame, day: Column) -> DataFrame:
    """Per key: on how many shelves it stood on its best day of the last two weeks, the earliest
    such day, and on how many it stands now.

    ``spans``: lic, key, first, last.  Each span is expanded over the at most 14 days of the
    window that it covers, not joined with all days."""
    low = F.date_sub(day, MOVES_DAYS - 1)
    inside = spans.where((F.col("first") <= day) & (F.col("last").isNull() | (F.col("last") >= low)))
    covered = inside.select("key", F.explode(F.sequence(F.greatest("first", low), F.least(F.coalesce("last", day), day))).alias("day"))
    counted = covered.join(F.broadcast(days.select("day")), "day").groupBy("key", "day").agg(F.count("*").alias("n"))
    best = counted.groupBy("key").agg(F.max(F.struct("n", (-F.unix_date("day")).alias("d"))).alias("b"))
    now = spans.groupBy("key").agg(F.count_if(F.col("last").isNull()).alias("now"), F.max("last").alias("last_seen"))
    best = best.select("key", F.col("b.n").alias("peak"), F.date_from_unix_date((-F.col("b.d")).cast("int")).alias("peak_day"))
    return best.join(now, "key")


def trusted_spans(shelf: DataFrame) -> DataFrame:
    """``presence`` without departures that their reading cannot be trusted with."""
    acts = activity(shelf).select("lic", F.col("r1").alias("last"), "trusted")
    out = presence(shelf).join(acts, ["lic", "last"], "left")
    return out.where(F.col("last").isNull() | F.coalesce("trusted", F.lit(False))).select("lic", "key", "first", "last")


def low_or_gone(shelf: DataFrame, day: Column, like: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Keys that run low (five shelves and more, now one to four) or are gone (from three).

    Departures that are not trusted count as neither, nor do shops of which only a window is seen,
    but what stands there stands.  ``like``: a key that left a shop with a like one on its shelf
    stands there under another name."""
    windows = windowed(shelf, day).select("lic")
    spans = trusted_spans(shelf)
    sure = spans.join(windows, "lic", "left_anti")
    wide = sure.groupBy("key").agg(F.count("*").alias("spans")).where(F.col("spans") >= GONE_PEAK)
    found = peaks(sure, sweeps(shelf), day).join(wide.select("key"), "key", "left_semi").where((F.col("peak") >= GONE_PEAK) & (F.col("now") < LOW_BELOW))
    there = spans.where("last is null")
    behind = there.join(windows, "lic", "left_semi").groupBy("key").agg(F.count("*").alias("behind"))
    found = found.join(behind, "key", "left").withColumn("now", F.col("now") + F.coalesce("behind", F.lit(0))).drop("behind")
    if like is not None:
        left = sure.where("last is not null").join(found.select("key"), "key", "left_semi")
        renamed = like_others(left, there.select("lic", F.col("key").alias("other")), ["lic"], like).groupBy("key").agg(F.count("*").alias("renamed"))
        found = found.join(renamed, "key", "left").withColumn("now", F.col("now") + F.coalesce("renamed", F.lit(0))).drop("renamed")
    low = (F.col("now") > 0) & (F.col("now") < LOW_BELOW) & (F.col("peak") >= LOW_PEAK)
    gone = (F.col("now") == 0) & (F.col("last_seen") >= F.date_sub(day, MOVES_DAYS - 1))
    return found.withColumn("state", F.when(low, "low").when(gone, "gone")).where("state is not null")


def _quiet(ranked: DataFrame) -> dict[str, Column]:
    """Aggregates over a shop's activity with each reading's number ``k``."""
    moved = (F.col("added") + F.col("departed") > 0) | (F.col("k") == 1)
    return {
        "quiet_reads": F.max("k") - F.coalesce(F.max(F.when(moved, F.col("k"))), F.lit(1)), "changed": F.max(F.when(moved, F.col("day"))),
        "reads": F.max("k"), "last_read": F.max("day"), "first_read": F.min("day"), "size": F.max_by("size", "day"),
    }


def quiet(activity_rows: DataFrame) -> DataFrame:
    """Per shop: how many of its last readings changed nothing (the first reading never counts),
    and the day of the last change."""
    ranked = activity_rows.withColumn("k", F.row_number().over(Window.partitionBy("lic").orderBy("day")))
    return ranked.groupBy("lic").agg(*[c.alias(n) for n, c in _quiet(ranked).items()])


def vitality(shelf: DataFrame, day: Column) -> DataFrame:
    """How alive each shop is: unread, new, partial, active, unsteady, stale, quiet, asleep, dead.

    One aggregate by shop over one pass of ``activity``."""
    ranked = activity(shelf).withColumn("k", F.row_number().over(Window.partitionBy("lic").orderBy("day")))
    newest = sweeps(shelf).agg(F.max("sweep").alias("top"))
    ranked = ranked.crossJoin(F.broadcast(newest))  # one row
    gap = F.col("next_sweep") - F.col("sweep")
    waits = gap.isNull() & (F.col("top") - F.col("sweep") < CONFIRM_WITHIN) & (F.col("new") > 0)
    came = ~F.col("unsteady") & ~F.col("rewritten") & (waits | ((gap <= CONFIRM_WITHIN) & (F.col("held") > 0)))
    lately = F.col("r1").isNotNull() & (F.col("day") >= F.date_sub(day, MOVES_DAYS - 1))
    rows = ranked.groupBy("lic").agg(
        *[c.alias(n) for n, c in (_quiet(ranked) | _turns(day)).items()],
        F.count_if(lately).alias("n"), F.count_if(lately & F.col("trusted")).alias("sure"), F.max(F.when(came, F.col("day"))).alias("delivered"),
        F.max("sweep").alias("last_sweep"), F.max("top").alias("top"),
    )
    partial = (F.col("turns") >= WINDOW_READS) & (F.col("turn") >= WINDOW_TURN)
    still, dry = F.datediff(day, "changed"), F.datediff(day, F.coalesce("delivered", "first_read"))
    steady = (F.col("n") > 0) & (F.col("sure") >= TRUSTED_SHARE * F.col("n"))
    scant = F.when(F.col("size") >= SMALL_SHELF, 0).when(F.col("size") >= TINY_SHELF, 1).otherwise(2)
    frozen = F.when((F.col("quiet_reads") >= QUIET_READS) & (still >= QUIET_DAYS), 1 + F.least(scant + F.when(still >= ASLEEP_DAYS, 1).otherwise(0), F.lit(2))).otherwise(0)
    dried = F.when(~steady | (dry < STALE_DAYS), 0).when(dry < ASLEEP_DAYS, 1).otherwise(2)
    names = (
        F.when(F.col("top") - F.col("last_sweep") >= RECENT_SWEEPS, "unread")
        .when(F.col("reads") <= QUIET_READS, "new")
        .when(F.coalesce(partial, F.lit(False)), "partial")
        .when((frozen > 0) & (frozen >= dried), F.element_at(F.array(F.lit("quiet"), F.lit("asleep"), F.lit("dead")), frozen))
        .when(dried > 0, F.element_at(F.array(F.lit("stale"), F.lit("asleep")), dried))
        .when(steady | (frozen > 0), "active")
        .otherwise("unsteady")
    )
    return rows.select("lic", names.alias("state"), "size", "quiet_reads", still.alias("quiet_days"), dry.alias("dry_days"), "last_read")


def reject_late(new_rows: DataFrame, last_day: Column) -> DataFrame:
    """Readings of a day that is not after the last sweep are dropped, never merged."""
    return new_rows.where(last_day.isNull() | (F.col("day") > last_day))
