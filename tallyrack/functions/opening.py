"""Opening hours as text, as a week of slots, and who is open at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import hours_state, ny_minute, ny_weekday, twelve_hour

#: Days of the week in order.
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY = r"(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"
SPAN = rf"{DAY}(?:\s*(?:-|–|to)\s*{DAY})?"
AND = r"\s*(?:,|&|\band\b)\s*"
PART = rf"(?i)^({SPAN}(?:{AND}{SPAN})*):\s*(.*)$"
CLOCK = r"(?:0?[1-9]|1[0-2])(?::[0-5]\d)?\s*[ap]m"
SLOT = rf"(?i)^({CLOCK})\s*(?:-|–|to)\s*({CLOCK})$"


def _number(day: Column) -> Column:
    """0 is Monday; by a day's first three letters."""
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.lower(F.substring(day, 1, 3))).cast("int") - 1


def _days(text: Column) -> Column:
    """The days of ``Mon-Wed, Fri``; a span runs on round the week, so Sat-Mon has three."""
    spans = F.regexp_extract_all(text, F.lit(f"(?i){SPAN}"), 0)
    ends = F.transform(spans, lambda s: F.transform(F.regexp_extract_all(s, F.lit(f"(?i){DAY}"), 0), _number))
    reach = lambda e: F.pmod(F.element_at(e, -1) - e[0], F.lit(7))
    return F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(0), reach(e)), lambda k: F.pmod(e[0] + k, F.lit(7)))))


def _slots(body: Column) -> Column:
    """Open and close of each slot; null where one cannot be read."""
    texts = F.split(body, f"(?i){AND}")
    slots = F.transform(texts, lambda t: F.struct(twelve_hour(F.regexp_extract(t, SLOT, 1)).alias("open"), twelve_hour(F.regexp_extract(t, SLOT, 2)).alias("close")))
    return F.when(F.forall(texts, lambda t: t.rlike(SLOT)), F.array_sort(slots))


def parts(text: Column) -> Column:
    """An array of struct(days, state, slots, warning): what each part of the text, up to a ``;``, says.

    A part is days, a colon and ``closed`` or slots.  One that names no day is left out; one that
    cannot be read, or opens when it closes, has no state but a warning."""
    named = F.filter(F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: p.rlike(PART))
    cut = F.transform(named, lambda p: F.struct(F.regexp_extract(p, PART, 1).alias("who"), F.trim(F.regexp_extract(p, PART, 2)).alias("body")))
    read = F.transform(cut, lambda c: F.struct(c["who"].alias("who"), c["body"].alias("body"), _days(c["who"]).alias("days"), (F.lower(c["body"]) == "closed").alias("shut"), _slots(c["body"]).alias("slots")))

    def said(r: Column) -> Column:
        same = F.filter(r["slots"], lambda s: s["open"] == s["close"])
        unclear = F.concat(F.lit("Could not parse registry hours for "), r["who"], F.lit(": "), r["body"])
        equal = F.concat(F.lit("Registry hours have identical open/close for "), r["who"], F.lit(" ("), F.get(same, F.lit(0))["open"], F.lit("); left unknown"))
        warning = F.when(r["shut"], F.lit(None)).when(r["slots"].isNull(), unclear).when(F.size(same) > 0, equal)
        state = F.when(r["shut"], "CLOSED").when(warning.isNull(), "OPEN")
        return F.struct(r["days"].alias("days"), state.alias("state"), F.when(state == "OPEN", r["slots"]).alias("slots"), warning.alias("warning"))

    return F.transform(read, said)


def weekly(text: Column) -> Column:
    """struct(week, warnings) of a text like ``Mon-Fri: 9:00 AM - 1:00 PM, 2 PM - 9 PM; Sun: Closed``.

    ``week`` is null if nothing of it is known, else struct(mon, ..., sun) of days as ``hours_state``
    reads them: struct(state, slots), null where the day is unknown.  The last part that can be read
    says what a day is."""
    return with_week(parts(text))


def with_week(found: Column) -> Column:
    """``weekly`` of what ``parts`` gave; where it is a column of a table the text is read once."""
    said = F.filter(found, lambda p: p["state"].isNotNull())

    def day(i: int) -> Column:
        own = F.filter(said, lambda p: F.array_contains(p["days"], F.lit(i)))
        return F.try_element_at(F.transform(own, lambda p: F.struct(p["state"].alias("state"), p["slots"].alias("slots"))), F.lit(-1))

    week = F.when(F.size(said) > 0, F.struct(*[day(i).alias(d) for i, d in enumerate(DAYS)]))
    return F.struct(week.alias("week"), F.transform(F.filter(found, lambda p: p["warning"].isNotNull()), lambda p: p["warning"]).alias("warnings"))


def with_hours(df: DataFrame, text: str, week: str = "week", warnings: str = "warnings") -> DataFrame:
    """``df`` with the week that a column of text says, and what could not be read of it."""
    read = df.withColumn("_parts", parts(F.col(text))).withColumn("_read", with_week(F.col("_parts")))
    return read.withColumns({week: F.col("_read.week"), warnings: F.coalesce("_read.warnings", F.array().cast("array<string>"))}).drop("_parts", "_read")


def state_at(week: Column, instant: Column) -> Column:
    """open, closed or unknown at a UTC instant, by the clock of New York."""
    days, today = F.array(*[week[d] for d in DAYS]), ny_weekday(instant)
    return hours_state(F.get(days, today), F.get(days, F.pmod(today + 6, F.lit(7))), ny_minute(instant))


def open_now(df: DataFrame, by: list[str], week: str, instant: Column) -> DataFrame:
    """(by, open, closed, unknown): how many rows of a group are in each state."""
    rows = df.withColumn("_state", F.coalesce(state_at(F.col(week), instant), F.lit("unknown")))
    return rows.groupBy(*by).agg(*[F.count_if(F.col("_state") == s).alias(s) for s in ("open", "closed", "unknown")])
