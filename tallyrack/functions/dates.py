"""Dates and hours: New York days, printed dates, opening hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"
#: Printed forms of dates, as tried in order.
FORMS = ("yyyy-MM-dd", "M/d/yyyy", "M/d/yy", "M-d-yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy")


def ny_day(instant: Column) -> Column:
    """The calendar day in New York of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, ZONE))


def ny_day_text(text: Column) -> Column:
    """As ``ny_day`` of an ISO text; text that is none keeps its first ten characters."""
    day = F.date_format(ny_day(F.try_to_timestamp(text)), "yyyy-MM-dd")
    return F.coalesce(day, F.substring(text, 1, 10))


def menu_date(value: Column, now: Column, ahead_days: int = 1) -> Column:
    """Seconds or milliseconds since 1970 (told apart by size) or ISO text; from 2015 to now."""
    number = value.try_cast("double")
    epoch = F.when(number > 1e11, number / 1000).when(number > 1e8, number)
    day = F.coalesce(F.to_date(F.timestamp_seconds(epoch)), F.to_date(F.try_to_timestamp(value)))
    return F.when((day >= F.lit("2015-01-01").cast("date")) & (day <= F.date_add(F.to_date(now), ahead_days)), day)


def printed_date(text: Column) -> Column:
    """The first of ``FORMS`` that the text has."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in FORMS])


def minutes(clock: Column) -> Column:
    """Minutes since midnight of HH:MM."""
    return F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")


def twelve_hour(text: Column) -> Column:
    """HH:MM of text like 9am or 10:30 PM; null if it is none."""
    h = F.regexp_extract(text, r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*$", 1)
    m = F.regexp_extract(text, r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*$", 2)
    half = F.lower(F.regexp_extract(text, r"(?i)^\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?\s*$", 3))
    hour = F.nullif(h, F.lit("")).cast("int") % 12 + F.when(half == "p", 12).otherwise(0)
    return F.when(h != "", F.format_string("%02d:%02d", hour, F.coalesce(F.nullif(m, F.lit("")).cast("int"), F.lit(0))))


def hours_state(today: Column, yesterday: Column, minute: Column) -> Column:
    """open, closed or unknown at a minute of the day.

    A day is a struct (state, slots of open and close): its state is CLOSED, OPEN or null where
    nothing is known.  A slot whose close is not after its open runs past midnight; 00:00 to
    00:00 is all day."""
    start, stop = lambda s: minutes(s["open"]), lambda s: minutes(s["close"])
    all_day = lambda s: (start(s) == 0) & (stop(s) == 0)
    now = lambda s: all_day(s) | F.when(stop(s) > start(s), (minute >= start(s)) & (minute < stop(s))).otherwise(minute >= start(s))
    spill = lambda s: ~all_day(s) & (stop(s) <= start(s)) & (minute < stop(s))
    some = lambda day, test: F.coalesce((day["state"] == "OPEN") & F.exists(day["slots"], test), F.lit(False))
    return F.when(some(yesterday, spill) | some(today, now), "open").when(today["state"].isNull(), "unknown").otherwise("closed")


def ny_minute(instant: Column) -> Column:
    local = F.from_utc_timestamp(instant, ZONE)
    return F.hour(local) * 60 + F.minute(local)


def ny_weekday(instant: Column) -> Column:
    """0 is Monday."""
    return F.weekday(F.from_utc_timestamp(instant, ZONE))


def age_text(days: Column) -> Column:
    """today, yesterday, N days ago, N weeks ago, N months ago."""
    plural = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    weeks, months = F.floor(days / 7), F.floor(days / 30)
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, plural(days, "day")).when(days < 60, plural(weeks, "week")).otherwise(plural(months, "month"))
