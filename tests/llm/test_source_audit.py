"""The audit of sources against brute force in whole numbers, the pointer sort against sorting."""

from __future__ import annotations

import collections
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tallyrack.llm import queries, source_audit, word_pointers

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]


def brute(rows, least=3, top=200):
    rows = [(t or "", lang or "", source or "") for t, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        here = [(terms_of(t), s) for t, g, s in rows if g == lang]
        docs = collections.Counter(w for ws, _ in here for w in set(ws))
        kept = {w for w, n in docs.items() if n >= least}
        count = collections.defaultdict(collections.Counter)
        for ws, s in here:
            count[s].update(w for w in ws if w in kept)
        total = sum(count.values(), collections.Counter())

        def share(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        sources = {s for _, s in here}
        for s in sources:
            pairs, over = [], []
            for o in sources - {s}:
                pairs.append((-sum((share(count[s], w) - (q := share(count[o], w))) ** 2 // q for w in kept), o.encode()))
            for w in kept:
                p, q = share(count[s], w), share(total, w)
                if count[s][w] and p > q:
                    over.append((-((p - q) ** 2 // q), w.encode()))
            for part, found in (("pair", sorted(pairs)), ("term", sorted(over)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)}
    return out


def test_audit_equals_brute_force(spark):
    at = random.Random(7)
    words = ["alpha", "Beta", "gamma", "éa", "日本", "x" * 20, "y" * 8, "y" * 9, "it's", "ZZ", "q2w"]
    rows = []
    for _ in range(150):
        lang, source = at.choice(["en", "en", "en", None, "de"]), at.choice(["a", "a", "a", "b", "é", None, "c"])
        rows.append((None if at.random() < 0.1 else " ".join(at.choice(words) for _ in range(at.randint(0, 12))), lang, source))
    rows += rows[:20] + [("once", "fr", "a"), ("", "fr", "b"), (None, "it", "only"), ("word " * 30_000 + "w" * 100_000, "en", "long")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, `odd.name` int").repartition(5)
    got = source_audit.audit_sources(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert {tuple(r) for r in source_audit.audit_sources(df, top_terms=2).collect()} == brute(rows, top=2)
    assert source_audit.audit_sources(df.limit(0)).count() == 0


def test_shards_do_not_change_the_counts(spark):
    rows = [(f"w{'abc'[i % 3]} common tail{i % 7 * 'x'}", "en", "s%d" % (i % 2)) for i in range(300)] + [("big " * 500, "en", "s0")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2)
    sums = [
        {tuple(r) for r in source_audit.shard_counts(df, size).groupBy("lang", "source", "term").sum("n", "docs").collect()} for size in (50, 1000, 1 << 24)
    ]
    assert sums[0] == sums[1] == sums[2]


@pytest.mark.parametrize("small", [1, 7, 4096])
def test_runs_are_sorted_words(small):
    at = random.Random(small)
    for _ in range(40):
        alphabet = at.choice(["abAB c", "aaaaaaaab ", "é日ab \n", "abcdefghijkABCDE\x00 5"])
        texts = ["".join(at.choice(alphabet) for _ in range(at.randint(0, 200))) for _ in range(at.randint(1, 60))]
        words = word_pointers.Words(pa.array(["cut off", *texts, "zz"]).slice(1, len(texts)))
        order, starts = word_pointers.sorted_runs(words, small)
        got = [bytes(words.bytes[words.start[i] : words.start[i] + words.length[i]]).decode() for i in order]
        assert got == sorted((w for t in texts for w in terms_of(t)), key=str.encode) and len(starts) == len(set(got))
        assert all(words.text[a] <= words.text[b] for a, b, x, y in zip(order, order[1:], got, got[1:], strict=False) if x == y)


def test_texts_end_words():
    terms, group, n, docs = word_pointers.counts(pa.array(["ab", "ab", None, "", "c ab"]), np.array([0, 1, 0, 0, 1]))
    assert sorted(zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist(), strict=True)) == [("ab", 0, 1, 1), ("ab", 1, 2, 2), ("c", 1, 1, 1)]


def test_query_equals_its_sql(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    got = {tuple(r) for r in queries.QUERIES["op12_source_audit"](spark, str(folder)).collect()}
    assert got and got == set(con.execute(source_audit.SQL).fetchall())
