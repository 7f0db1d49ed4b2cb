"""States of tags: the batch plan against a walk over days, the stream against the batch plan."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import tags
from tallyrack.streaming import tags as stream_tags

DAY0 = dt.date(2026, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def rows():
    """Tags on readings some days apart, with answers now and then."""
    at = random.Random(3)
    reads = sorted(at.sample(range(150), 45))
    out = []
    for t in range(25):
        share, mood = at.choice([0.95, 0.6, 0.1]), at.choice([None, True, False])
        for before, n in zip([None, *reads], reads, strict=False):
            if at.random() < share:
                out.append((f"T{t:02d}", day(n), "shelf", None, None if before is None else day(before)))
            if at.random() < 0.07:
                out.append((f"T{t:02d}", day(n), "answer", at.choice([mood, None, True, False]), None))
    return out


def walk(rows, until):
    """Day by day, tag by tag."""
    events, states = set(), {}
    for tag in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == tag), key=lambda r: (r[1], r[2] == "answer"))
        found = checked = since = printed = last = None
        for n in range(400):
            d = day(n)
            if d > until and not any(r[1] == d for r in mine):
                continue
            if found is False and checked and checked + dt.timedelta(days=30) == d and d <= until:
                events.add((tag, d, "due", None))
            if found is None and last and last + dt.timedelta(days=60) == d and d <= until:
                events.add((tag, d, "forgotten", None))
                since = printed = last = None
            for _, _, kind, told, before in [r for r in mine if r[1] == d]:
                last = d
                if kind == "shelf":
                    if found is None:
                        if since is None or printed != before:
                            since = d
                            events.add((tag, d, "waits", d))
                    else:
                        since = None
                    printed = d
                    states[tag, d] = (found, checked, since)
                else:
                    found, checked = told, d
                    if told is not None:
                        events.add((tag, d, "answered", None))
                        since = None
    return events, states


def frame(spark, rows):
    return spark.createDataFrame(rows, tags.ROWS)


def test_events_equal_a_walk(spark, rows):
    until = max(r[1] for r in rows) + dt.timedelta(days=40)
    got = {tuple(r) for r in tags.events(frame(spark, rows).repartition(3), F.lit(until)).collect()}
    want, states = walk(rows, until)
    assert {e[2] for e in want} == {"waits", "answered", "due", "forgotten"} and got == want
    seen = {(r["tag"], r["day"]): r["since"] for r in tags.known(frame(spark, rows)).where("kind = 'shelf'").collect()}
    assert seen == {k: v[2] for k, v in states.items()}
    assert tags.events(frame(spark, []), F.lit(until)).count() == 0


@pytest.mark.parametrize("room", [0, 3, 40])
def test_plan_equals_a_walk(spark, rows, room):
    _, states = walk(rows, day(149))
    busy = max({d for _, d in states}, key=lambda d: sum(1 for (_, e), s in states.items() if e == d and s[0] is False and s[1] <= d - dt.timedelta(days=30)))
    now = {t: s for (t, d), s in states.items() if d == busy}
    fresh = sorted((t for t, s in now.items() if s[0] is None), key=lambda t: (now[t][2], t), reverse=True)
    again = sorted((t for t, s in now.items() if s[0] is False and s[1] <= busy - dt.timedelta(days=30)), key=lambda t: (now[t][1], t))
    take = min(len(again), room, max(30, room - len(fresh)))
    got = sorted((r["why"] == "again", r["place"], r["tag"]) for r in tags.asked(frame(spark, rows), busy, room).collect())
    assert again and [t for _, _, t in got] == fresh[: room - take] + again[:take]


def test_stream_equals_the_plan_and_goes_on_after_a_restart(spark, rows, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    end = day(260)
    last = [("end", end, "shelf", None, None)]
    days = sorted({r[1] for r in rows})
    cuts = [days[:10], days[10:11], days[11:30], days[30:], None]
    try:
        for k, some in enumerate(cuts):  # a run each, on one checkpoint
            part = last if some is None else [r for r in rows if r[1] in some]
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(tags.ROWS).parquet(f"{tmp_path}/in")
            query = stream_tags.tag_events(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination(240)
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [tuple(r) for r in spark.read.schema(tags.EVENTS).parquet(f"{tmp_path}/out").where("tag <> 'end'").collect()]
    want, _ = walk(rows, end)
    assert len(got) == len(set(got)) and set(got) == want
