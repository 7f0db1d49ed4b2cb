import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyrack.operators import audit

LETTERS = "abcde"


def noisy(at, text, most):
    for _ in range(at.randint(0, most)):
        i = at.randrange(len(text) + 1)
        text = at.choice([text[:i] + text[i + 1 :], text[:i] + at.choice(LETTERS) + text[i:], text[:i] + at.choice(LETTERS) + text[i + 1 :], text[i:] + text[:i]])
    return text


@pytest.mark.parametrize("least", [0.7, 0.78, 0.9, 1.0])
def test_near_texts_lose_none(spark, least):
    at = random.Random(int(least * 100))
    bases = ["".join(at.choices(LETTERS, k=at.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 30]))) for _ in range(40)]
    a, b = ({noisy(at, t, 6) for t in bases * 3} for _ in range(2))
    frame = lambda rows, c: spark.createDataFrame([(t,) for t in [*sorted(rows), None]], f"{c} string")
    got = {tuple(r) for r in audit.near_texts(frame(a, "a"), frame(b, "b"), least).collect()}
    want = {(x, y) for x in a for y in b if x and y and SequenceMatcher(None, x, y).ratio() >= least}
    assert len(want) > 10 and want <= got
    assert len(got) < len(a) * len(b) / 2


def test_addresses(spark):
    rows = spark.createDataFrame([("12 Main Street, Suite 4",), ("5-10 45th Avenue #2",), ("1 Boulevard Rd  Unit",), ("St. Félix's & Co Road",), ("7 Flatbush Ave Floor 2",), (None,)], "t string")
    assert [r[0] for r in rows.select(audit.address(F.col("t"))).collect()] == ["12 main st", "5 10 45th ave", "1 blvd rd", "st felixs and co rd", "7 flatbush ave", ""]


def brute(left, right):
    r = lambda x, y: SequenceMatcher(None, x, y).ratio()
    out = {}
    for i, a, n, c, z in left:
        found = []
        for o, b, m, d, y in right:
            s = (r(a, b), r(n or "", m or ""), r(c or "", d or ""), z is not None and z == y) if a and b else (0, 0, 0, 0)
            if s[0] >= 0.9 or (s[0] >= 0.78 and s[1] >= 0.75):
                found.append((-(0.6 * s[0] + 0.25 * s[1] + 0.1 * s[2] + 0.05 * s[3]), o, s))
        best = min(found, key=lambda f: (round(f[0], 9), f[1]), default=None)
        out[i] = None if best is None else (best[1], round(-best[0], 9), best[2][0] >= 0.96 or (best[2][0] >= 0.88 and best[2][1] >= 0.82))
    return out


def test_matches_equal_all_pairs(spark):
    at = random.Random(3)
    places = [f"{at.randint(1, 400)} {''.join(at.choices(LETTERS, k=7))} {at.choice(['st', 'ave', 'rd'])}" for _ in range(30)]
    shops = ["green leaf", "leaf green co", "blue door", "the blue door", "hash and more", "", None]
    row = lambda i: (i, noisy(at, at.choice(places), 3) if at.random() < 0.95 else None, at.choice(shops), at.choice(["troy", "tory", "albany", None]), at.choice(["1", "2", None]))
    left, right = [row(i) for i in range(90)], [row(i) for i in range(120)]
    right += [(500 + i, *r[1:]) for i, r in enumerate(right[:30])]  # copies
    left += [(600 + i, *r[1:]) for i, r in enumerate(left[:10])]
    tidy = lambda rows: [(i, None if a is None else " ".join(a.split()), *rest) for i, a, *rest in rows]
    left, right = tidy(left), tidy(right)
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, address string, name string, city string, zip string").repartition(3)
    got = {r["id"]: None if r["other"] is None else (r["other"], round(r["score"], 9), r["confident"]) for r in audit.weighted_matches(frame(left, "id"), frame(right, "other")).collect()}
    want = brute(left, right)
    assert got == want and sum(v is not None for v in want.values()) >= 40 and sum(v is None for v in want.values()) > 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, address string, name string, city string, zip string")
    one = spark.createDataFrame([(1, "1 main st", "a", "b", "c")], none.schema)
    assert audit.weighted_matches(none, one.withColumnRenamed("id", "other")).count() == 0
    (row,) = audit.weighted_matches(one, none.withColumnRenamed("id", "other")).collect()
    assert row["id"] == 1 and row["other"] is None and row["confident"] is False


def test_alike_addresses_are_not_all_paired(spark, monkeypatch):
    """Where every address is like every other, no table of pairs is written, and the best is that of all pairs."""
    sizes, real = [], audit.written
    monkeypatch.setattr(audit, "written", lambda df: (out := real(df), sizes.append(out.count()))[0])
    monkeypatch.setattr(audit, "ASKED_BLOCK", 50, raising=False)
    monkeypatch.setattr(audit, "KNOWN_BLOCK", 40, raising=False)
    at = random.Random(9)
    row = lambda i: (i, f"{at.randint(100, 400)} nation {at.randint(1, 25)} st", f"shop {at.randint(1, 30)} sons", f"nation {at.randint(1, 25)}", str(at.randint(1, 9)))
    left, right = [row(i) for i in range(150)], [row(i) for i in range(130)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} int, address string, name string, city string, zip string").repartition(3)
    got = {r["id"]: None if r["other"] is None else (r["other"], round(r["score"], 9), r["confident"]) for r in audit.weighted_matches(frame(left, "id"), frame(right, "other")).collect()}
    assert got == brute(left, right)
    assert max(sizes) <= 150
