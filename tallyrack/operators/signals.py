"""Signals about figures and first appearances, from readings with a figure (lic, day, key, thc).

What the market knew is always what it knew before the day in question: a day never reads its
own writes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import same_batch
from . import history
from .rounds import written

BURST_SHARE, BURST_LEAST = 0.3, 5


def market_figures(readings: DataFrame) -> DataFrame:
    """(key, thc, first): figures ever shown anywhere; whole numbers are roundings and stay out."""
    shown = readings.where((F.col("thc") > 0) & (F.col("thc") != F.floor("thc")))
    return shown.groupBy("key", "thc").agg(F.min("day").alias("first"))


def figures_per_reading(readings: DataFrame) -> DataFrame:
    """(lic, key, day, figures, old, before): a reading's figures and those of the key's last one
    on this shelf."""
    sets = readings.groupBy("lic", "key", "day").agg(F.array_sort(F.collect_set(F.when(F.col("thc") > 0, F.col("thc")))).alias("figures"))
    w = Window.partitionBy("lic", "key").orderBy("day")
    return sets.withColumns({"before": F.lag("day").over(w), "old": F.lag("figures").over(w)})


def shifts(readings: DataFrame) -> DataFrame:
    """Figures that changed on a shelf where the key stood on the reading before."""
    rows = figures_per_reading(readings).join(history.reads(readings).select("lic", "day", "r1"), ["lic", "day"])
    return rows.where((F.col("before") == F.col("r1")) & (F.size("figures") > 0) & (F.col("figures") != F.col("old"))).select("lic", "key", F.col("day").alias("seen"), "old", "figures")


def new_batches(readings: DataFrame, like: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(lic, key, seen, thc, state, confirmed): figures that are new to their shelf and to the whole
    market, and what the shop's next reading made of them.

    On a shelf that had the key they are compared with what it showed; keys that arrived that day
    come with theirs.  A shop of which more than five keys and three tenths changed at once was read
    differently, and says nothing.  A key that the market has never had a figure of is an arrival,
    not a batch.  A figure is confirmed if the key shows it, or one as good, on the next reading."""
    readings = written(readings.select("lic", "day", "key", "thc"))
    known = readings.select("lic", "day", "key").distinct()
    steady = history.activity(known).where("not unsteady and not rewritten").select("lic", "day")
    last = history.sweeps(known).agg(F.max("sweep").alias("last_sweep"))
    reads = history.reads(known).select("lic", "day", "r1", "sweep", "next_day", "next_sweep")
    w = Window.partitionBy("lic", "key").orderBy("day")
    sets = figures_per_reading(readings).withColumns({"after": F.lead("day").over(w), "next_figures": F.lead("figures").over(w)})
    rows = sets.join(reads, ["lic", "day"]).join(steady, ["lic", "day"], "left_semi")
    compared = (F.col("before") == F.col("r1")) & (F.size("old") > 0) & (F.size("figures") > 0)
    other = F.filter("figures", lambda v: (v != F.floor(v)) & ~F.exists("old", lambda o: same_batch(v, o)))
    rows = rows.withColumns({"compared": F.coalesce(compared, F.lit(False)), "fresh": F.when(compared, other)})
    burst = rows.where("compared").groupBy("lic", "day").agg(F.count_if(F.size("fresh") > 0).alias("changed"), F.count("*").alias("n"))
    wild = burst.where((F.col("changed") >= BURST_LEAST) & (F.col("changed") > BURST_SHARE * F.col("n"))).select("lic", "day")
    came = history.candidates(known, like).select("lic", "key", F.col("seen").alias("day"), F.lit(True).alias("came"))
    rows = rows.join(wild, ["lic", "day"], "left_anti").join(came, ["lic", "key", "day"], "left")
    fresh = F.when(F.col("came"), F.filter("figures", lambda v: v != F.floor(v))).when(F.col("compared"), F.col("fresh"))
    found = rows.withColumn("thc", F.explode(fresh)).crossJoin(F.broadcast(last))  # one row
    gap = F.col("next_sweep") - F.col("sweep")
    shown = (F.col("after") == F.col("next_day")) & F.exists("next_figures", lambda v: same_batch(v, F.col("thc")))
    state = (
        F.when(gap.isNull(), F.when(F.col("last_sweep") - F.col("sweep") < history.CONFIRM_WITHIN, "waiting").otherwise("expired"))
        .when(gap > history.CONFIRM_WITHIN, "expired")
        .when(F.coalesce(shown, F.lit(False)), "confirmed")
        .otherwise("flicker")
    )
    found = found.select("lic", "key", "day", "thc", state.alias("state"), F.when(state == "confirmed", F.col("next_day")).alias("confirmed"))
    found = written(found)
    market = market_figures(readings).select("key", F.col("thc").alias("known"), "first")
    oldest = market.groupBy("key").agg(F.min("first").alias("oldest"))
    # figures of one batch have the same whole part or neighbouring ones, so they meet there and not in the whole key
    whole = F.floor("thc")
    near = found.select("key", "day", "thc").distinct().withColumn("whole", F.explode(F.array(whole - 1, whole, whole + 1)))
    near = near.join(market.withColumn("whole", F.floor("known")), ["key", "whole"]).where((F.col("first") < F.col("day")) & same_batch(F.col("thc"), F.col("known")))
    fresh = found.join(oldest, "key").where(F.col("oldest") < F.col("day")).join(near.select("key", "day", "thc").distinct(), ["key", "day", "thc"], "left_anti")
    return fresh.select("lic", "key", F.col("day").alias("seen"), "thc", "state", "confirmed")


def deliveries(readings: DataFrame, day: Column) -> DataFrame:
    """Per shop: its last delivery (confirmed or waiting) and the days since."""
    came = history.candidates(readings).where("state in ('confirmed', 'waiting')").groupBy("lic").agg(F.max("seen").alias("delivered"))
    return came.withColumn("dry_days", F.datediff(day, "delivered"))


def lot_dates(lots: DataFrame, tested: list[str], packaged: list[str], harvested: list[str]) -> DataFrame:
    """Dates of a lot by precedence of their sources; none may be before the harvest."""
    floor = F.coalesce(*harvested)
    after = lambda names: F.coalesce(*[F.when(floor.isNull() | (F.col(c) >= floor), F.col(c)) for c in names])
    return lots.withColumns({"harvested_on": floor, "tested_on": after(tested), "packaged_on": after(packaged)})
