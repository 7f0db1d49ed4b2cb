"""Tags that shelves print, and what a registry of packages answers when it is asked of them.

Rows are (tag, day, kind, found, before).  ``kind`` is ``shelf``: the tag was printed on a reading's
day, and ``before`` is the day of the reading before that one; or ``answer``: the registry was
asked, and ``found`` is what it said, null if it said nothing.  On one day shelves come first.  A tag
has one answer a day at most.

A tag waits while it is printed reading after reading and the last answer, if there is any, was
none.  A package that was not found is asked for again after ``RECHECK_DAYS``.  The stream of
``streaming.tags`` tells the same as these plans.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rules; what nobody answered and no shelf printed for ``KEEP_DAYS`` is forgotten.
RECHECK_DAYS, RECHECK_LEAST, KEEP_DAYS = 30, 30, 60
ROWS = "tag string, day date, kind string, found boolean, before date"
EVENTS = "tag string, day date, event string, since date"


def known(rows: DataFrame) -> DataFrame:
    """Each row with the last answer before it (``told``: found, day) and, of printed tags that wait,
    since when (``since``)."""
    order = F.struct("day", (F.col("kind") == "answer").alias("later"))
    w = Window.partitionBy("tag").orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("told", F.last(F.when(F.col("kind") == "answer", F.struct("found", "day")), ignorenulls=True).over(before))
    out = out.withColumn("waits", (F.col("kind") == "shelf") & F.col("told.found").isNull())
    printed = F.struct("day", "waits")
    last = F.last(F.when(F.col("kind") == "shelf", printed), ignorenulls=True).over(before)
    goes_on = F.coalesce(last["waits"] & (last["day"] == F.col("before")), F.lit(False))
    out = out.withColumn("starts", F.when(F.col("waits") & ~goes_on, F.col("day")))
    return out.withColumn("since", F.when(F.col("waits"), F.last("starts", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))))


def events(rows: DataFrame, until: Column) -> DataFrame:
    """(tag, day, event, since) up to the day ``until``: a tag begins to wait, is answered, is due to be
    asked again, or is forgotten."""
    w = Window.partitionBy("tag").orderBy(F.struct("day", (F.col("kind") == "answer").alias("later")))
    out = known(rows).withColumns({"next_day": F.lead("day").over(w)})
    out = out.withColumn("next_answer", F.first(F.when(F.col("kind") == "answer", F.col("day")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = out.withColumn("holds", F.when(F.col("kind") == "answer", F.col("found")).otherwise(F.col("told.found")))
    due, gone = F.date_add("day", RECHECK_DAYS), F.date_add("day", KEEP_DAYS)
    event = lambda when, day, name, since=F.lit(None).cast("date"): F.when(when, F.struct(day.alias("day"), F.lit(name).alias("event"), since.alias("since")))
    told = (F.col("kind") == "answer") & F.col("found").isNotNull()
    found = F.array(
        event(F.col("starts").isNotNull(), F.col("day"), "waits", F.col("starts")),
        event(told, F.col("day"), "answered"),
        event((F.col("kind") == "answer") & ~F.col("found") & (F.col("next_answer").isNull() | (F.col("next_answer") >= due)) & (due <= until), due, "due"),
        event(F.col("holds").isNull() & (F.col("next_day").isNull() | (F.col("next_day") >= gone)) & (gone <= until), gone, "forgotten"),
    )
    return out.select("tag", F.explode(F.array_compact(found)).alias("e")).select("tag", "e.day", "e.event", "e.since")


def asked(rows: DataFrame, day: dt.date, room: int) -> DataFrame:
    """(tag, why, place): whom to ask on a day on which ``room`` may be asked: tags that wait, the
    latest first, and packages that were not found, the longest ago first.

    The latter get what the former leave, and ``RECHECK_LEAST`` at least."""
    room = max(room, 0)
    now = known(rows).where((F.col("kind") == "shelf") & (F.col("day") == F.lit(day)))
    fresh = now.where("waits").select("tag", "since")
    again = now.where(~F.col("told.found") & (F.date_add("told.day", RECHECK_DAYS) <= F.col("day"))).select("tag", F.col("told.day").alias("checked"))
    n_fresh, n_again = fresh.count(), again.count()
    rechecks = min(n_again, room, max(RECHECK_LEAST, room - n_fresh))
    placed = lambda df, n, order, why: df.orderBy(*order).limit(n).select("tag", F.lit(why).alias("why"), F.row_number().over(Window.orderBy(*order)).alias("place"))  # noqa: E731  # at most ``room`` rows
    return placed(fresh, room - rechecks, (F.desc("since"), F.desc("tag")), "waits").unionByName(placed(again, rechecks, (F.col("checked"), F.col("tag")), "again"))
