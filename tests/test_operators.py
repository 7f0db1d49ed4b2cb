"""Operators on small invented worlds: rules, ties, unknowns."""

from __future__ import annotations

import datetime as dt
import difflib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyrack.functions import dates, keys, names, numbers, text
from tallyrack.operators import history, index, lots, merges, quality, review, signals, strains
from tallyrack.plans import registry
from tallyrack.sources import payloads, readers, schemas, sinks
from tallyrack.streaming import daily


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_keys(spark):
    lit = F.lit
    assert one(spark, keys.brand_key(lit("Élan Farms, LLC")), keys.brand_key(lit("Cannabis Co")), keys.brand_key(lit(None).cast("string"))) == ["elan", None, None]
    assert one(spark, keys.grower_key(lit("Kings and Queens")), keys.brand_key(lit("Kings and Queens"))) == ["kingsqueens", "kingsandqueens"]
    assert one(spark, keys.history_key(lit("Find NY"), lit("  Sour   Diesel ")), keys.history_key(lit(None).cast("string"), lit("x")), keys.history_key(lit("a"), lit(" "))) == ["find|sour diesel", "|x", None]
    loose = one(spark, *[keys.loose_key(lit(n)) for n in ("Cookies", "Cookie", "Cap Junkie", "Cap Junky", "Mintz", "Mints", "Jack & Jill", "Jack and Jill")])
    assert loose[0] == loose[1] and loose[2] == loose[3] and loose[4] == loose[5] and loose[6] == loose[7]
    assert one(spark, keys.display_name(lit(" "), lit("Green Leaf, L.L.C. Inc")), keys.display_name(lit("Shop"), lit("x")), keys.display_name(lit(None).cast("string"), lit("Chelsea Cannabis Co.")), keys.display_name(lit("Door PLLC, "), lit("x")), keys.display_name(lit(None).cast("string"), lit("LLC"))) == ["Green Leaf", "Shop", "Chelsea Cannabis Co.", "Door", "LLC"]
    assert one(spark, keys.menu_identity(lit("https://www.Shop.com/menu/?a=1")), keys.menu_identity(lit("http://shop.com/menu?a=1"))) == ["shop.com/menu?a=1"] * 2
    panel = F.from_json(lit('[{"name":"A","percent":0.1},{"name":"A","percent":0.3},{"name":"B","percent":1},{"name":"C","percent":0.255},{"name":"D","percent":2}]'), "array<struct<name:string,percent:double>>")
    assert one(spark, keys.panel_key(lit(20.5), panel))[0].startswith("THC:20.50|A:0.30|B:1.00|C:0.2")
    df = spark.createDataFrame([("é①",), (None,)], "t string").select(keys.fold_accents("t").alias("t"))
    assert {r["t"] for r in df.collect()} == {"e1", None}


@pytest.mark.parametrize(("a", "b", "same"), [(28.0, 28.41, True), (28.0, 28.6, True), (27.0, 28.6, False), (29.0, 28.6, True), (26.14, 26.22, True), (26.1, 26.3, False), (25.0, 25.3, True), (24.0, 25.3, False), (0.7, 0.66, True)])
def test_same_batch_both_forms(spark, a, b, same):
    assert lots.same_batch(a, b) == lots.same_batch(b, a) == same
    assert one(spark, numbers.same_batch(F.lit(a), F.lit(b)), numbers.same_batch(F.lit(b), F.lit(a))) == [same, same]


def test_figures_and_sizes(spark):
    got = one(spark, *[numbers.grams(F.lit(t)) for t in ("3.5g jar", "1/8 oz", "1 Ounce", "2 lbs", "none", "14 grams")])
    assert got == [3.5, 3.5, 28.0, None, None, 14.0]
    assert one(spark, numbers.stated_thc(F.lit(0.0)), numbers.stated_thc(F.lit(101.0)), numbers.plausible_size(F.lit(0.2)), numbers.printed(F.lit(28.0)), numbers.printed(F.lit(26.49))) == [None, None, None, "28", "26.49"]


def test_dates_and_hours(spark):
    at = F.lit("2026-10-06 01:01:00").cast("timestamp")
    assert one(spark, dates.ny_day(at), dates.ny_weekday(at), dates.ny_minute(at)) == [dt.date(2026, 10, 5), 0, 21 * 60 + 1]
    assert one(spark, dates.printed_date(F.lit("3/7/26")), dates.printed_date(F.lit("Mar 7, 2026")), dates.printed_date(F.lit("2026-02-30"))) == [dt.date(2026, 3, 7), dt.date(2026, 3, 7), None]
    now = F.lit("2026-06-01").cast("timestamp")
    assert one(spark, dates.menu_date(F.lit("1767225600000"), now), dates.menu_date(F.lit("1767225600"), now), dates.menu_date(F.lit("2030-01-01"), now)) == [dt.date(2026, 1, 1), dt.date(2026, 1, 1), None]
    assert one(spark, dates.twelve_hour(F.lit("9am")), dates.twelve_hour(F.lit("12:30 AM")), dates.twelve_hour(F.lit("x"))) == ["09:00", "00:30", None]
    day = "struct<state:string,slots:array<struct<open:string,close:string>>>"
    make = lambda s: F.from_json(F.lit(s), day)
    shop, late, off, unknown, whole = ('{"state":"OPEN","slots":[{"open":"09:00","close":"21:00"}]}', '{"state":"OPEN","slots":[{"open":"18:00","close":"02:00"}]}', '{"state":"CLOSED","slots":[]}', "{}", '{"state":"OPEN","slots":[{"open":"00:00","close":"00:00"}]}')
    cases = [(shop, off, 540, "open"), (shop, off, 1260, "closed"), (off, late, 60, "open"), (off, late, 120, "closed"), (late, off, 60, "closed"), (late, off, 1100, "open"), (unknown, off, 700, "unknown"), (unknown, late, 30, "open"), (whole, off, 3, "open")]
    for today, yesterday, minute, want in cases:
        assert one(spark, dates.hours_state(make(today), make(yesterday), F.lit(minute))) == [want]


def test_text(spark):
    assert one(spark, text.phone(F.lit("+1 (212) 555-0100")), text.phone(F.lit("12")), text.usable(F.lit("N/A")), text.link(F.lit("shop.com/a")), text.menu_link(F.lit("https://x.com/a.js"))) == ["(212) 555-0100", None, None, "https://shop.com/a", None]
    lines = ("12 West Third Street Unit 5", "12-34 B Avenue of the Americas", "5th Ave. & Main St's", "Élm Plaza #4", "40 First Avenue", "", None)
    assert one(spark, *[text.canonical_address(F.lit(x).cast("string")) for x in lines]) == ["12 w 3rd st", "1234b 6th ave", "5th ave and main sts", "elm plz", "40 1st ave", "", None]
    more = {
        "12 West 3rd Street, Suite 4": "12 w 3rd st", "100 Fashion Ave": "100 7th ave", "7 fashion avenue, Store #2": "7 7th ave", "34-18 Broadway": "3418 broadway", "21 - 10 Jackson Ave": "21 10 jackson ave",
        "5 B East Tenth St": "5b e 10th st", "77B Main Road": "77b main rd", "Ninth Place": "9th pl", "Route 9 West": "route 9 w", "12": "12", "1st Place": "1st pl", "9-a Elm Court": "9 a elm ct", "3 Shop Lane": "3", "34-18 b Broad-way": "3418b broad way", "123abc Street": "123abc st",
    }
    assert one(spark, *[text.canonical_address(F.lit(x)) for x in more]) == list(more.values())
    assert one(spark, *[text.usable(F.lit(x).cast("string")) for x in ("Unknown", " none ", "---", "Known", "", None)]) == [None, None, None, "Known", None, None]
    assert one(spark, *[text.flower_reason(F.lit(t), F.lit(c)) for t, c in (("Blue Dream", "Flower"), ("Blue Dream Pre-Roll", "Flower"), (" ", "Flower"), ("X", ""), ("X", "Edible"))]) == ["flower", "title-not-flower", "no-title", "no-category", "category-not-flower"]
    assert one(spark, text.sample(F.array(F.lit("PROMOTIONAL_SAMPLE")), F.lit(None).cast("string")), text.sample(F.lit(None).cast("array<string>"), F.lit("Example"))) == [True, False]


def like(x, y):
    """Two strains of one brand."""
    bare = [[w for w in re.findall("[a-z0-9]+", re.sub(names.WEIGHT, " ", t)) if w not in names.PACKAGING] for t in (x, y)]
    subset = all(bare) and (not set(bare[0]) - set(bare[1]) or not set(bare[1]) - set(bare[0]))
    return x == y or bool(subset) or difflib.SequenceMatcher(None, x, y).ratio() >= 0.85


def test_similar_names(spark):
    pairs = [("a|sour diesel", "a|sour diesel 3.5g", True), ("a|x", "b|x", False), ("|x y", "b|x y", True), ("a|sour diesel", "a|sour diesal", True), ("a|moon gelato", "a|moon galeto", False), ("a|blue cream", "a|orange", False), (None, "a|x", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert [r["got"] for r in df.select("want", names.similar(F.col("a"), F.col("b")).alias("got")).collect()] == [p[2] for p in pairs]


def world(spark, plan):
    rows = [(lic, dt.date(2026, 9, day), key) for (lic, day), shelf in plan.items() for key in shelf]
    return spark.createDataFrame(rows, "lic bigint, day date, key string")


def test_arrivals_flickers_and_rewrites(spark):
    base = [f"k{i}" for i in range(40)]
    plan = {(1, d): base + (["new"] if d in (3, 4, 5) else []) + (["blink"] if d == 3 else []) for d in range(1, 6)}
    plan |= {(2, d): base + ([f"r{i}" for i in range(20)] if d >= 3 else []) for d in range(1, 6)}
    plan |= {(3, d): base + ([] if d == 3 else ["back"]) for d in range(1, 6)}
    got = {(r["lic"], r["key"]): r["state"] for r in history.candidates(world(spark, plan)).collect()}
    assert got == {(1, "new"): "confirmed", (1, "blink"): "flicker"}
    acts = {(r["lic"], r["day"].day): r for r in history.activity(world(spark, plan)).collect()}
    assert acts[2, 3]["rewritten"] and acts[2, 3]["new"] == 20 and acts[1, 1]["unsteady"] and not acts[1, 3]["rewritten"]
    assert (acts[3, 3]["departed"], acts[3, 4]["added"], acts[3, 4]["new"]) == (1, 1, 0)


def test_waves_by_shelf(spark):
    rows = [("a", dt.date(2026, 9, 5), s) for s in ("x", "x", "y", "z")] + [("b", dt.date(2026, 9, 5), s) for s in ("x", "x", "y")]
    df = spark.createDataFrame(rows, "key string, seen date, shelf string")
    assert [(r["key"], r["shelves"]) for r in history.waves(df, F.lit("2026-09-07").cast("date"), "shelf").collect()] == [("a", 3)]


def test_candidates_are_not_renames_and_deeper_readings_keep_line_ups(spark):
    base = [f"b|kush {i} x{i * 7}" for i in range(8)]
    plan = {(1, d): base + ["b|sour diesel" if d < 4 else "b|sour diesel 3.5g"] + (["b|fresh haze"] if d >= 4 else []) for d in range(1, 7)}
    found = {(r["lic"], r["key"]): r["state"] for r in history.candidates(world(spark, plan), names.similar).collect()}
    assert found == {(1, "b|fresh haze"): "confirmed"}
    gone = {(r["day"].day, r["gone"]) for r in history.lately_gone(world(spark, plan)).collect()}
    assert gone == {(4, "b|sour diesel"), (5, "b|sour diesel")}
    # the reader changed on the fourth day and shop 1 grew by seven: three of brand c, and one that shop 2 got too
    many = [f"a|n{i}" for i in range(60)]
    more = ["c|1", "c|2", "c|3", "d|new", "e|1"]
    plan = {(1, d): many + (more if d >= 4 else []) for d in range(1, 7)} | {(2, d): many + (["d|new"] if d >= 4 else []) for d in range(1, 7)}
    readers = spark.createDataFrame([(dt.date(2026, 9, d), int(d >= 4)) for d in range(1, 7)], "day date, reader int")
    rows = world(spark, plan)
    assert [r["lic"] for r in history.activity(rows, readers).where("deeper").collect()] == []  # grown by a twelfth, too little
    plan = {(lic, d): [k for k in shelf if k not in many[15:]] for (lic, d), shelf in plan.items()}
    rows = world(spark, plan)
    acts = history.activity(rows, readers).where("deeper").collect()
    assert [(r["lic"], r["day"].day, r["new"], r["trusted"]) for r in acts] == [(1, 4, 5, False)]
    got = {(r["lic"], r["key"]): r["state"] for r in history.candidates(rows, readers=readers).collect()}
    assert got == {(1, "c|1"): "confirmed", (1, "c|2"): "confirmed", (1, "c|3"): "confirmed", (1, "d|new"): "confirmed", (2, "d|new"): "confirmed"}


def test_new_batches_of_standing_and_arrived_keys(spark):
    # shop 1: k changes to 24.41 and keeps it, j shows 19.37 for a day; shop 2: k arrives with a figure of its own
    plan = {1: {"k": [20.13] * 4 + [24.41] * 4, "j": [18.22] * 4 + [19.37] + [18.22] * 3, "r": [25.0, 25.3] * 4}, 2: {"k": [None] * 5 + [22.68] * 3, "x": [None] * 5 + [21.21] * 3, "y": [30.11] * 8}}
    rows = [(lic, dt.date(2026, 9, d + 1), key, v) for lic, keys_ in plan.items() for key, vs in keys_.items() for d, v in enumerate(vs) if v is not None]
    got = signals.new_batches(spark.createDataFrame(rows, "lic bigint, day date, key string, thc double")).collect()
    assert {(r["lic"], r["key"], r["seen"].day, r["thc"], r["state"], r["confirmed"] and r["confirmed"].day) for r in got} == {(1, "k", 5, 24.41, "confirmed", 6), (1, "j", 5, 19.37, "flicker", None), (2, "k", 6, 22.68, "confirmed", 7)}


def test_low_and_gone_leave_out_windows_and_untrusted_departures(spark):
    big = [f"k{i}" for i in range(20)]
    plan = {}
    for lic in range(5):
        for d in range(1, 15):
            plan[lic, d] = big + (["y"] if d < 8 else [])
            if lic < 4 and d >= 9:  # half the shelf goes at once: a reading that is not trusted
                plan[lic, d] = big[:10]
    got = {r["key"]: (r["state"], r["now"]) for r in history.low_or_gone(world(spark, plan), F.lit("2026-09-14").cast("date")).collect()}
    assert got == {"y": ("gone", 0)}


def test_low_and_gone(spark):
    plan = {}
    for lic in range(6):
        for d in range(1, 15):
            plan[lic, d] = ["base"] + (["low"] if d < 10 or lic == 0 else []) + (["gone"] if d < 8 and lic < 3 else [])
    rows = world(spark, plan)
    got = {r["key"]: (r["state"], r["peak"], r["now"]) for r in history.low_or_gone(rows, F.lit("2026-09-14").cast("date")).collect()}
    assert got == {"low": ("low", 6, 1), "gone": ("gone", 3, 0)}


def test_vitality(spark):
    plan = {(1, d): [f"k{i}" for i in range(40)] for d in range(1, 26)}
    plan |= {(2, d): [f"k{i}" for i in range(40)] + [f"d{d}", f"d{d + 1}"] for d in range(1, 26)}
    plan |= {(3, d): ["a"] for d in range(1, 4)}
    got = {r["lic"]: r["state"] for r in history.vitality(world(spark, plan), F.lit("2026-09-25").cast("date")).collect()}
    assert got == {1: "asleep", 2: "active", 3: "unread"}


def test_replay_equals_folding_day_by_day(spark, tmp_path):
    rng = random.Random(4)
    plan = {(lic, d): rng.sample([f"k{i}" for i in range(30)], 20) for lic in range(3) for d in range(1, 9)}
    rows = world(spark, plan)
    path = f"{tmp_path}/readings"
    for d in range(1, 9):
        assert daily.fold_batch(rows.where(F.dayofmonth("day") == d), path) == 60
    assert daily.fold_batch(rows.where(F.dayofmonth("day") == 4), path) == 0  # late days are dropped
    # a day in two parts is whole, and a part that is tried again adds nothing
    halves = [rows.where(F.dayofmonth("day") == 8).where(t) for t in ("lic = 1", "lic <> 1")]
    assert [daily.fold_batch(h, f"{tmp_path}/halves") for h in (*halves, *halves)] == [20, 40, 0, 0]
    for d in range(1, 9):
        daily.fold_batch(rows.where(F.dayofmonth("day") == d), f"{tmp_path}/again")
        daily.fold_signals(spark, f"{tmp_path}/again", f"{tmp_path}/signals", dt.date(2026, 9, d))
    pick = ["lic", "key", "seen", "returned", "state", "confirmed"]
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/signals").select(*pick).collect())) == sorted(map(str, history.candidates(rows).select(*pick).collect()))
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(history.candidates(daily.readings(spark, path))) == same(history.candidates(rows))


def test_stream_of_days(spark, tmp_path):
    plan = {(1, 1): ["a", "b"], (1, 2): ["a"], (1, 3): ["a", "b", "c"]}
    world(spark, plan).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(daily.READINGS).parquet(f"{tmp_path}/in")
    daily.start(stream, f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination(120)
    assert daily.readings(spark, f"{tmp_path}/table").count() == 6
    q = daily.presence_updates(stream).writeStream.format("memory").queryName("presence_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp2").start()
    q.awaitTermination(120)
    got = sorted((r["key"], r["state"]) for r in spark.table("presence_out").collect())
    assert got == [("a", "new"), ("b", "departed"), ("b", "new"), ("b", "returned"), ("c", "new")]


def test_mode_and_plurality(spark):
    df = spark.createDataFrame([(1, "ABC", "s"), (1, "Abc", "t"), (1, None, "t"), (2, "x", "s"), (2, "y", "s"), (2, "y", "t")], "k int, v string, shop string")
    assert {r["k"]: r["mode"] for r in index.tied_mode(df, ["k"], "v").collect()} == {1: "Abc", 2: "y"}
    assert {r["k"]: r["plurality"] for r in index.plurality(df, ["k"], "v", "shop").collect()} == {1: None, 2: "y"}


def test_merges(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 3)], "id int, s string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "q", 1), (4, "w", 4)], "id int, s string, n int")
    assert {r["id"]: (r["change"], r["fields"]) for r in merges.changes(a, b, "id", ["s", "n"]).collect()} == {1: ("same", ""), 2: ("changed", "s"), 3: ("removed", ""), 4: ("added", "")}
    assert merges.verdict(merges.changes(a.where("id < 3"), b.where("id < 3"), "id", ["s", "n"]), ["s"]).first()["verdict"] == "provenance"
    kept, dropped = merges.in_register(a, b, "id")
    assert (kept.count(), dropped.count(), merges.in_register(a, b.limit(0), "id")[0].count()) == (2, 1, 3)
    ref = spark.createDataFrame([("A", ["b", "c"], 1), ("C", None, 2)], "name string, aliases array<string>, ord int")
    assert {r["alias_key"]: r["ord"] for r in merges.first_alias(ref, keys.strain_key, "name", "aliases", "ord").collect()} == {"a": 1, "b": 1, "c": 1}
    points = spark.createDataFrame([("g", 5), ("g", 20), ("h", 1)], "g string, at int")
    known = spark.createDataFrame([("g", 0, 0.0), ("g", 10, 100.0)], "g string, at int, v double")
    assert {(r["g"], r["at"]): r["value"] for r in merges.asof_between(points, known, "g", "at", "v").collect()} == {("g", 5): 50.0, ("g", 20): 100.0, ("h", 1): None}


def test_lots(spark):
    p = lambda *v: dict(zip("ABCDE", v, strict=False))
    rows = [("k", "s1", 1, 26.49, p(0.5, 0.4, 0.3, 0.2), False), ("k", "s2", 2, 26.5, p(0.5, 0.4, 0.3), False), ("k", "s3", 3, 30.1, p(0.9, 0.1, 0.1, 0.1), True), ("k", "s4", 4, None, p(0.9, 0.1), False), ("k", "s5", 5, 26.4, p(1.5, 0.4, 0.3, 0.2), False)]
    df = spark.createDataFrame(rows, "key string, shop string, ord int, thc double, panel map<string,double>, certified boolean")
    got = [(r["thc"], r["shops"], r["rows"]) for r in lots.lots(df).orderBy("lot").collect()]
    assert got == [(30.1, 2, 2), (26.49, 2, 2), (26.4, 1, 1)]


def test_lots_visit_equal_rows_in_order(spark):
    p = lambda *v: dict(zip("ABCDE", v, strict=False))
    rows = [("k", f"s{i}", i, 20.5, p(0.5, 0.4), False) for i in range(5)] + [("k", "s1", 9, 20.5, p(0.5, 0.4), False), ("k", "s7", 8, 20.5, p(0.9, 0.4), True)]
    # the second of two equal rows comes after a panel that it differs from
    rows += [("m", "s1", 1, 18.25, p(0.5), False), ("m", "s2", 2, 18.21, p(0.52), False), ("m", "s3", 3, 18.25, p(0.9), False), ("m", "s4", 4, 18.21, p(0.52), False)]
    df = spark.createDataFrame(rows, "key string, shop string, ord int, thc double, panel map<string,double>, certified boolean").repartition(3)
    got = [(r["key"], r["thc"], r["shops"], r["rows"], r["panel"]) for r in lots.lots(df).orderBy("key", "lot").collect()]
    assert got == [("k", 20.5, 6, 7, p(0.5, 0.4)), ("m", 18.25, 3, 3, {}), ("m", 18.21, 1, 1, p(0.52))]


def test_lots_fold_one_measurement_of_several_figures(spark):
    p = lambda *v: dict(zip("ABCDE", v, strict=False))
    one = p(0.9, 0.7, 0.5, 0.3)
    rows = [("k", "s1", 1, 23.27, one, False), ("k", "s2", 2, 23.72, {**one, "E": 0.1}, False), ("k", "s3", 3, 23.72, one, False), ("k", "s4", 4, 27.0, p(0.9, 0.7, 0.5), False), ("k", "s5", 5, 23.1, {}, False), ("k", "s6", 6, None, {}, True)]
    # a tie of figures goes to the certified one; with two of those the compound is left out
    rows += [("t", "s1", 1, 20.0, p(0.5, 0.2), False), ("t", "s2", 2, 20.0, p(0.6, 0.3), True), ("t", "s3", 3, 20.0, {"B": 0.2}, True)]
    df = spark.createDataFrame(rows, "key string, shop string, ord int, thc double, panel map<string,double>, certified boolean").repartition(3)
    got = [(r["key"], r["lot"], r["thc"], r["shops"], r["rows"], r["panel"]) for r in lots.lots(df).orderBy("key", "lot").collect()]
    assert got == [("k", 0, 27.0, 1, 1, p(0.9, 0.7, 0.5)), ("k", 1, 23.72, 3, 3, {**one, "E": 0.1}), ("k", 2, 23.1, 1, 1, {}), ("t", 0, 20.0, 3, 3, p(0.6, 0.2))]
    assert lots.lots(df.limit(0)).count() == 0


def test_query_batch_lots_joins_all_shops(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    parts = {r["p_partkey"]: f"{r['p_brand']}|{r['p_name'].lower()}" for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    shops, n = {}, {}
    for r in spark.read.parquet(f"{folder}/lineitem.parquet").collect():
        lot = (parts[r["l_partkey"]], round(r["l_quantity"], 1))
        shops.setdefault(lot, set()).add(r["l_suppkey"])
        n[lot] = n.get(lot, 0) + 1
    got = {(r["key"], r["thc"]): (r["shops"], r["rows"]) for r in registry.QUERIES["batch_lots"](spark, folder).collect()}
    # figures are whole there and panels of two compounds are no twins: a lot is a strain's figure
    assert got == {lot: (len(shops[lot]), n[lot]) for lot in n} and max(len(s) for s in shops.values()) > 1


def test_rules(spark):
    df = spark.createDataFrame([("a", 120.0), ("b", 20.0), ("c", None)], "listingId string, thc double")
    got = quality.violations(df, "listingId", [quality.Rule("thc-range", F.col("thc").between(0, 100))]).collect()
    assert [(r["rule"], r["key"]) for r in got] == [("thc-range", "a")]
    empty = spark.createDataFrame([], schemas.LISTINGS)
    assert quality.violations(empty, "listingId", quality.listing_rules()).count() == 0
    assert quality.violations(spark.createDataFrame([], schemas.SHOPS), "id", quality.shop_rules()).count() == 0
    assert quality.forbidden_columns(df.withColumn("unitPrice", F.lit(1)), "price") == ["unitPrice"]


def test_canonical_strains(spark):
    """Titles, the brand of each, and the name that is left; every brand of the table is known."""
    find = {
        "Find - Blue Dream -Hybrid- 25.% THC": "Blue Dream", "Flower Power": "Flower Power", "AK-47": "AK-47", "Leal Flower- Lemon Venom": "Lemon Venom", "Find Animal Mints Premium Flower 3.5g": "Animal Mints", "11:11": "11:11",
        "Blue Dream (Indica)": "Blue Dream", "Premium Cake": "Cake", "Find": "Find", "Premium Flower": None, None: None, "  ": None, "Grand Daddy | 1/8 | Find": "Grand Daddy", "R14 Flower - Black Magic": "Black Magic", "RS11 Premium Flower": "RS11",
        "Northern Light": "Northern Light", "Mixed Berries Light": "Mixed Berries Light", "Blue Zushi (Indica/Hybrid)": "Blue Zushi", "Moonbeam Gelato (Dark Heart Collection)": "Moonbeam Gelato", "ITEM #548CH Blue Dream": "Blue Dream",
        "Ice Cream Cake - Bonfire - Summer Collection": "Ice Cream Cake - Bonfire", "BANANA KUSH - THC 28.8%": "BANANA KUSH", "#337 - Black Maple Flower": "Black Maple", "Snow Day Small Bud": "Snow Day", "Whole Lotta Love": "Whole Lotta Love",
        "Prepack Whole Flower :Indica:Tri Berry": "Tri Berry", "Bagged Flower - Agent Z": "Agent Z", "Pomme Jelly - Preground": "Pomme Jelly", "Small Batch Premium Flower Bag Big Apple": "Big Apple", "Batch Craft Cannabis Jar Goonies": "Goonies",
        "Mylar Dime Bag - Chimera": "Chimera", "Grandma's House": "Grandma's House", "CANDYLAND SATIVA DOM": "CANDYLAND", "Triple Scoop - Indica Dom": "Triple Scoop", "Jar Zoap": "Zoap", "Pack Mule": "Pack Mule", "G-13": "G-13", "GG4": "GG4",
        "R14-Flower - Black Magic": "Black Magic", "Flower #284ZZ - Zoap": "Zoap", "1353 (Indoor)": "1353", "RS11 - DF12": "RS11", "Cream Smoothie 8TH": "Cream Smoothie", "8th Ave": "8th Ave", "Sun-Grown Blue Dream": "Sun-Grown Blue Dream",
        "'All Times' Cherry Pie": "Cherry Pie", "Premium Indoor Cannabis Flower Sherb Cake": "Sherb Cake", "Indoor Kosher Kush": "Kosher Kush", 'Flower "Large Bud" Blueberry Sugar': "Blueberry Sugar", "Lemon Haze (I/H)": "Lemon Haze",
        "Dank Agent Orange Flower": "Agent Orange", "Runtz Cake": "Runtz Cake", "Runtz": "Runtz", "Ghost Train Haze": "Ghost Train Haze", "F8B - Blue Dream": "Blue Dream", "Mixed Light Flower Blue Dream": "Mixed Light Flower Blue Dream",
        "Sour Diesel | Limited Edition Premium Flower | 3.5g": "Sour Diesel", "Gelato CH-BRTD-0925-001": "Gelato", "Total Cannabinoids 31 - Gelato": "Gelato", "Black Maple (": "Black Maple", "Lead farmer - Flower Bag Pink Zugar": "Lead farmer - Pink Zugar",
        "Amnesia Haze -Sativa- 21.04% THC - Dime Bag . Flower - 5 Boro -gg11 FRONT": "Amnesia Haze", "Zaza Grams": "Zaza Grams", "Indica Hybrid - Zushi": "Zushi", "A": "A", "Sativa Dominant Jack": "Jack",
    }
    own = {
        ("MAJOR NY - Chimax", "Major"): "Chimax", ("McPike Farms - Gelato Gelato", "McPike"): "Gelato Gelato", ("Jack Herer - Flower", "Jack Herer Brands"): "Jack Herer", ("1937 Flower Ghost Train Haze", "1937"): "Ghost Train Haze",
        ("40 Tons Ghost Train Haze Flower", "40 Tons"): "Ghost Train Haze", ("1937 Flower Animal Mints", "1937"): "Animal Mints", ("BANZZY 8TH AVE", "Banzzy"): "8TH AVE", ("HURLEY GROWN G41 FLOWER", "Hurley Grown"): "G41",
        ("Ghost Blue Dream Cake", "Ghost"): "Blue Dream Cake", ("LivWell Cannabis Flower Mendo Breath", "LivWell"): "Mendo Breath",
    }
    brands = ["Leal", "Dank", "Runtz", "5 Boro"]
    rows = [(i, t, "Find") for i, t in enumerate(find)] + [(1000 + i, t, b) for i, (t, b) in enumerate(own)] + [(2000 + i, "x y z", b) for i, b in enumerate(brands)] + [(3000, None, None)]
    df = spark.createDataFrame(rows, "id int, title string, brand string")
    got = {r["id"]: r["strain"] for r in strains.canonical_strains(df, "id", "title", "brand").collect()}
    assert len(got) == len(rows)
    assert {t: got[i] for i, t in enumerate(find)} == find
    assert {t: got[1000 + i] for i, t in enumerate(own)} == own


def test_names_only_lose_words(spark):
    titles = ["Find Blue Dream 3.5g Flower", "Blue Dream (Indica)", "Flower", "Sour Diesel 1/8 oz Premium Smalls", None]
    rows = spark.createDataFrame([(t, "Find") for t in titles], "t string, b string").select("t", review.review(F.col("t"), F.col("b")).alias("r")).collect()
    assert [r["r"]["name"] for r in rows] == ["Blue Dream", "Blue Dream", "Flower", "Sour Diesel", None]
    assert all(set(r["r"]["name"].split()) <= set(r["t"].split()) for r in rows if r["t"])


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"listings":[{"listingId":"1","thcPercent":2.5}]}', encoding="utf-8")
    (tmp_path / "b.json").write_text('[{"listingId":"2"}]', encoding="utf-8")
    for name, want in (("a", "1"), ("b", "2")):
        assert [r["listingId"] for r in readers.json_array(spark, f"{tmp_path}/{name}.json", schemas.LISTINGS, "listings").collect()] == [want]
    html = '<title> T </title><script>var a="<a href=\'x\'>"</script><a href="tel:2125550100">c</a><a href="/coa/1.pdf">d</a><table><tr><th>A</th><td> b <i>c</i></td></tr></table>'
    page = spark.createDataFrame([(1, html)], "page_id int, html string")
    got = readers.page_evidence(page).first()
    assert got["phone"] == "2125550100" and got["provider"] is None and got["delivery"] is None
    assert [r["url"] for r in readers.certificate_links(page, "page_id").collect()] == ["/coa/1.pdf"]
    assert page.select(readers.table_rows(F.col("html"))).first()[0] == [["A", "b c"]]
    payload = '{"data":{"menu":[{"Name":"X","Brand":{"name":"B"},"potencyThc":{"range":[21.5]}}],"raw":"[{\\"title\\":\\"Y\\",\\"type\\":\\"Flower\\"}]"}}'
    rows = payloads.products(spark.createDataFrame([(1, payload)], "k int, p string"), "k", "p").collect()
    assert [(r["title"], r["brand"], r["thc"], r["category"]) for r in rows] == [("X", "B", "21.5", None), ("Y", None, None, "Flower")]
    lab = spark.range(1).select(readers.lab_rows(F.lit("Report\nMyrcene 0.51 %\nLimonene ND\nLinalool <LOQ\nPinene 0\n"))).first()[0]
    assert [(r["compound"], r["percent"], r["qualifier"]) for r in lab] == [("MYRCENE", 0.51, None), ("LIMONENE", None, "ND"), ("LINALOOL", None, "LOQ"), ("PINENE", 0.0, "reported_zero")]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_distinct(df, f"{tmp_path}/arch", ["k"])
    sinks.append_distinct(df.unionByName(spark.createDataFrame([(3, "c")], "k int, v string")), f"{tmp_path}/arch", ["k"])
    assert spark.read.parquet(f"{tmp_path}/arch").count() == 3
    with pytest.raises(ValueError):
        sinks.overwrite_sorted(df.limit(0), f"{tmp_path}/x", "k")
    spark.dataSource.register(readers.PagedRegistry)
    (tmp_path / "pages").mkdir()
    for k in range(0, 30, 10):
        (tmp_path / "pages" / f"{k}.json").write_text(str([{"license_number": f"L{k + i}"} for i in range(10)]).replace("'", '"'))
    assert spark.read.format("paged_registry").options(path=f"{tmp_path}/pages", total=30, limit=10).load().count() == 30


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["blue ring", "small ring", "cold plate", "old plate", "premium flower", "ring", "a", "b", "ab", "aab", "abab", "\u00e9clair", "eclair", "x" * 250, "y" + "x" * 249, "3.5g blue ring jar", "", None]
    words = ["blue", "dream", "ring", "haze", "old", "gold", "indoor", "og", "kush", "x1"]
    for _ in range(120):
        name = list(" ".join(rng.sample(words, rng.randint(1, 3))))
        for _ in range(rng.randint(0, 3)):
            name.insert(rng.randrange(len(name) + 1), rng.choice("abx ")) if rng.random() < 0.5 else name.pop(rng.randrange(len(name)))
        base.append("".join(name))
    base += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = [(rng.choice(["p", "q"]), t) for t in base for _ in range(2)] + [(None, "blue ring"), (None, "ring")]
    got = review.similar_pairs(spark.createDataFrame(rows, "brand string, name string"), "brand", "name").collect()
    whole = {(b, x, y) for b in "pq" for x in {t for c, t in rows if c == b} for y in {t for c, t in rows if c == b} if x is not None and y is not None and x < y and like(x, y)}
    assert len(got) == len(whole) > 100 and {tuple(r) for r in got} == whole
    assert any(x[:1] != y[:1] for _, x, y in whole)


def test_query_similar_names_compares_whole_brands(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    parts = {(r["p_brand"], r["p_name"].lower()) for r in spark.read.parquet(f"{folder}/part.parquet").collect()}
    whole = {(b, x, y) for b, x in parts for c, y in parts if b == c and x < y and like(x, y)}
    assert whole and {tuple(r) for r in registry.QUERIES["similar_names"](spark, folder).collect()} == whole
