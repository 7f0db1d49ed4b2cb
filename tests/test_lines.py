import random
from collections import Counter, defaultdict

from tallyrack.operators import lines

PACKED = {"flower", "jar", "smalls", "3.5g"}


def walk(rows, decided=(), least=3):
    """Row by row and pair by pair; pieces here are single words, of which ``PACKED`` are packaging."""
    rows = [(i, b, n) for i, b, n in rows if b and n is not None]
    key = lambda p: p.lower().removesuffix("s")
    cut = lambda n: [p for p in n.replace("|", " - ").split(" - ") if p.strip() and p.strip().lower() not in PACKED | {"x"}]
    beside, listed, shown, examples = defaultdict(set), [], {}, defaultdict(list)
    for _, brand, name in sorted(rows):
        ks = sorted({key(p.strip()) for p in cut(name)})
        if len(ks) < 2:
            continue
        for p in cut(name):
            shown.setdefault((brand, key(p.strip())), p.strip())
        for k in ks:
            beside[brand, k] |= set(ks) - {k}
            if name not in examples[brand, k] and len(examples[brand, k]) < 4:
                examples[brand, k].append(name)
        listed.append((brand, ks))
    as_line, as_name = Counter(), Counter()
    for brand, ks in listed:
        for a in ks:
            for c in ks:
                if a != c and len(beside[brand, a]) >= max(least, 2 * len(beside[brand, c])):
                    as_line[brand, a] += 1
                    as_name[brand, c] += 1
    return {k: (shown[k], len(beside[k]), n, as_name[k], examples[k]) for k, n in as_line.items() if n > as_name[k] and k not in decided}


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "id int, brand string, name string").repartition(3)
    return {(r["brand"], r["k"]): (r["line"], r["partners"], r["as_line"], r["as_name"], r["examples"]) for r in lines.candidates(df, **more).collect()}


def random_rows(at, n):
    heads, rows = ["Gold", "Cuts", "Reserve", "Hashers"], []
    for i in range(n):
        some = [at.choice(heads)] if at.random() < 0.7 else []
        some += [f"{at.choice('KkLM')}ush{at.randrange(14)}{at.choice(['', '', 's'])}" for _ in range(at.choice([1, 1, 1, 2, 3]))]
        some += at.choice([[], [], ["Flower"], ["3.5g"], ["x"]])
        at.shuffle(some)
        rows.append((i, at.choice(["a", "b", "b", "c", "", None]), at.choice([" - ", " | "]).join(some)))
    return rows


def test_candidates_equal_a_walk_over_all_pairs(spark):
    at = random.Random(9)
    rows = random_rows(at, 260)
    rows += [(1000 + i, brand, name) for i, (_, brand, name) in enumerate(rows[:40])]  # the same names again
    long = " - ".join(f"Long{i}" for i in range(150))  # a name of more than two blocks
    rows += [(2000, "a", long), (2001, "a", "Long7 - Gold"), (2002, "c", None), (2003, "d", "Alone"), (2004, "e", "Pair - Of"), (2005, "e", "Pair - Off"), (2006, "e", "Pair - Offer - Gold")]
    want = walk(rows)
    assert len(want) > 5 and found(spark, rows) == want


def test_decided_lines_and_other_least_numbers(spark):
    rows = random_rows(random.Random(10), 90)
    some = next(iter(walk(rows)))
    decided = spark.createDataFrame([(some[0], walk(rows)[some][0] + " Flower")], "brand string, line string")
    assert found(spark, rows, decided=decided) == walk(rows, {some})
    assert found(spark, rows, least=1) == walk(rows, least=1)
    assert found(spark, rows, least=6) == walk(rows, least=6)


def test_nothing_to_find(spark):
    assert found(spark, [(1, "a", "One"), (2, None, "Two - Three"), (3, "a", None), (4, "a", "")]) == {}
    df = spark.createDataFrame([], "id int, brand string, name string")
    assert lines.candidates(df).count() == 0
