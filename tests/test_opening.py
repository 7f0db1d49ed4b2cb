import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyrack.functions import opening

DAYS = list(opening.DAYS)


def read(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, hours string")
    got = opening.with_hours(rows, "hours").orderBy("i").collect()
    plain = lambda d: None if d is None else "CLOSED" if d["state"] == "CLOSED" else [(s["open"], s["close"]) for s in d["slots"]]
    return [(None if r["week"] is None else {d: plain(r["week"][d]) for d in DAYS}, r["warnings"]) for r in got]


NONE = dict.fromkeys(DAYS)


@pytest.mark.parametrize(
    ("text", "week", "warned"),
    [
        ("Mon: 9:00 AM - 10:00 PM; Tues: Closed; Thurs: 12:00 PM-12:00 AM", NONE | {"mon": [("09:00", "22:00")], "tue": "CLOSED", "thu": [("12:00", "00:00")]}, 0),
        ("Sun: 12:30 am - 2:00 am", NONE | {"sun": [("00:30", "02:00")]}, 0),
        ("Sat-Mon: 10 AM – 6 PM", NONE | {d: [("10:00", "18:00")] for d in ("sat", "sun", "mon")}, 0),
        ("Mon-Wed, Fri & sunday: 2 PM to 8 PM, 9am - 1pm", NONE | {d: [("09:00", "13:00"), ("14:00", "20:00")] for d in ("mon", "tue", "wed", "fri", "sun")}, 0),
        ("Mon: by appointment; Tue: 9:00 AM - 5:00 PM", NONE | {"tue": [("09:00", "17:00")]}, 1),
        ("Mon: 9:00 AM - 9:00 AM; Tue: closed", NONE | {"tue": "CLOSED"}, 1),
        ("Mon: 9:00 AM - 5:00 PM; Mon: whenever; Mon: Closed; Mon: 13:00 PM - 5:00 PM", NONE | {"mon": "CLOSED"}, 2),
        ("Mon: 9:00 AM - 5:00 PM, later", None, 1),
        ("open daily; ; Mo: 9 AM - 5 PM", None, 0),
        ("", None, 0),
        (None, None, 0),
    ],
)
def test_weeks(spark, text, week, warned):
    (got,) = read(spark, text)
    assert got[0] == week and len(got[1]) == warned


def test_warnings_name_the_day(spark):
    ((_, warned),) = read(spark, "Tues: 9:00 AM - 9:00 AM; Mon-Wed: ask")
    assert warned == ["Registry hours have identical open/close for Tues (09:00); left unknown", "Could not parse registry hours for Mon-Wed: ask"]


def test_states_equal_a_walk_over_minutes(spark):
    """Weeks of spans and slots, some past midnight, against minutes that are filled one by one."""
    at = random.Random(4)
    clock = lambda m: f"{m // 60 % 12 or 12}:{m % 60:02d} {'AM' if m < 720 else 'PM'}"
    texts, weeks = [], []
    for _ in range(60):
        said, week = [], [None] * 7
        for _ in range(at.randint(0, 4)):
            a, b = at.randrange(7), at.randrange(7)
            slots = [] if at.random() < 0.2 else [tuple(at.sample(range(0, 1440, 15), 2)) for _ in range(at.randint(1, 2))]
            body = at.choice([", ", " and "]).join(f"{clock(o)} - {clock(c)}" for o, c in slots) or "Closed"
            said.append(f"{DAYS[a].title()}{'' if a == b else '-' + DAYS[b].title()}: {body}")
            for k in range((b - a) % 7 + 1):
                week[(a + k) % 7] = slots
        texts.append("; ".join(said))
        weeks.append(week)
    instants = [dt.datetime(2026, 3, 7) + dt.timedelta(minutes=at.randrange(60 * 24 * 9)) for _ in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, hours string")
    times = spark.createDataFrame([(str(t),) for t in instants], "t string").select(F.to_timestamp("t").alias("t"))
    got = opening.with_hours(rows, "hours").crossJoin(times).select("i", "t", opening.state_at(F.col("week"), F.col("t")).alias("s"), F.from_utc_timestamp("t", "America/New_York").cast("string").alias("l")).collect()
    assert len(got) == 2400 and {r["s"] for r in got} == {"open", "closed", "unknown"}
    for r in got:
        local, week = dt.datetime.fromisoformat(r["l"]), weeks[r["i"]]
        minute, today, yesterday = local.hour * 60 + local.minute, week[local.weekday()], week[local.weekday() - 1]
        is_open = any(o <= minute < c if o < c else minute >= o for o, c in today or []) or any(c < o and minute < c for o, c in yesterday or [])
        assert r["s"] == ("open" if is_open else "unknown" if today is None else "closed"), (texts[r["i"]], local)


def test_open_now_of_groups(spark):
    rows = spark.createDataFrame([("a", "Mon-Sun: 9 AM - 5 PM"), ("a", "Mon: Closed"), ("b", None), ("a", "Sun: 9 PM - 2 AM")], "region string, hours string")
    noon = F.lit("2026-10-05 16:00:00").cast("timestamp")  # a Monday
    got = {r["region"]: (r["open"], r["closed"], r["unknown"]) for r in opening.open_now(opening.with_hours(rows, "hours"), ["region"], "week", noon).collect()}
    assert got == {"a": (1, 1, 1), "b": (0, 0, 1)}
    assert opening.open_now(opening.with_hours(rows.limit(0), "hours"), ["region"], "week", noon).count() == 0
