"""Metric trees and vector codes against brute force in whole numbers."""

from __future__ import annotations

import hashlib
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tallyrack.llm import metric_trees, queries, vector_codes


def nearest(x, entries):
    return ((x[:, None].astype(object) - entries) ** 2).sum(-1).argmin(1)


def test_trees_cover_their_points_and_assign_as_brute_force():
    at = np.random.default_rng(1)
    for _ in range(120):
        n, width, top = int(at.integers(1, 500)), int(at.integers(1, 6)), int(at.choice([2, 5, 100, 10**6, 1 << 26]))
        x = at.integers(-top, top, (n, width))
        if at.random() < 0.5:
            x[at.random(n) < 0.4] = x[0]
        entries = np.concatenate([x[at.integers(0, n, min(n, 30))], at.integers(-top, top, (3, width))])
        tree = metric_trees.build(x, int(at.integers(1, 30)))
        assert sorted(tree.order.tolist()) == list(range(n)) and (tree.points == x[tree.order]).all()
        for a, b, total, centre, radius in zip(tree.start, tree.stop, tree.total, tree.centre, tree.radius, strict=True):
            assert (tree.points[a:b].sum(0) == total).all()
            assert (np.sqrt(((tree.points[a:b] - centre) ** 2).sum(1)) <= radius + 1e-6).all()
        codes, count, sums = metric_trees.assign(tree, entries, int(at.choice([1, 50, 1 << 18])))
        want = nearest(tree.points, entries)
        assert (codes == want).all() and (count == np.bincount(want, minlength=len(entries))).all()
        table = np.zeros(entries.shape, np.int64)
        np.add.at(table, want, tree.points)
        assert (sums == table).all()


def test_balls_owned_as_a_whole_are_not_opened():
    at = np.random.default_rng(2)
    centres = np.array([[0, 0], [10_000, 0], [0, 10_000]])
    x = np.concatenate([c + at.integers(-5, 5, (300, 2)) for c in centres])
    tree = metric_trees.build(x)
    opened = []
    true = metric_trees._leaf_codes
    try:
        metric_trees._leaf_codes = lambda *a: opened.append(a)
        codes, count, _ = metric_trees.assign(tree, centres)
    finally:
        metric_trees._leaf_codes = true
    assert not opened and count.tolist() == [300, 300, 300] and (codes == nearest(tree.points, centres)).all()


def brute(rows, parts=4, entries=256, rounds=4):
    """The contract, read plainly: rows of (id, label, whole numbers)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in rows], object)
    width = x.shape[1] // parts
    codes, error, books = [""] * len(rows), np.zeros(len(rows), object), []
    for k in range(parts):
        part = x[:, k * width : (k + 1) * width]
        book = part[:entries].copy()
        for _ in range(rounds):
            own = nearest(part, book)
            for e in set(own.tolist()):
                mine = part[own == e]
                book[e] = [int(s) // len(mine) for s in mine.sum(0)]
        own = nearest(part, book)
        error += ((part - book[own]) ** 2).sum(1)
        codes = [c + f"{o:02x}" for c, o in zip(codes, own, strict=True)]
        books += book.ravel().tolist()
    digest = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    sums = {}
    for r, e in zip(rows, error, strict=True):
        sums[r[1]] = sums.get(r[1], 0) + e
    return sorted((repr(r[0]), c, int(e), int(sums[r[1]]), digest) for r, c, e in zip(rows, codes, error, strict=True))


@pytest.mark.parametrize("shard_rows", [16_384, 37])
def test_codes_equal_brute_force(spark, shard_rows):
    at = np.random.default_rng(3)
    centres = at.normal(size=(40, 8))
    rows = [(int(i), int(at.integers(0, 3)), (centres[at.integers(0, 40)] + at.normal(scale=0.05, size=8)).tolist()) for i in at.permutation(900)]
    rows += [(i, None, rows[0][2]) for i in range(1000, 1400)] + [rows[5], rows[5], (None, 1, rows[7][2]), (rows[9][0], 2, rows[3][2])]
    bad = [(5000, 1, None), (5001, 1, [float("nan")] * 8), (5002, 1, [float("inf")] + [0.0] * 7), (5003, 1, [None] + [0.0] * 7), (5004, 1, [1.0] * 7), (5005, 1, [])]
    bad += [(5006, 1, [1e30] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], "vec_id bigint, label int, embedding array<double>, code string, `odd.name` int").repartition(5)
    got = vector_codes.code_rows(df, shard_rows=shard_rows)
    assert dict(got.dtypes)["error"] == dict(got.dtypes)["label_error"] == "bigint"
    found = sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect())
    assert found == brute([(i, label, [math.floor(1024 * c) for c in v]) for i, label, v in rows])


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, label string, embedding array<float>"
    few = spark.createDataFrame([(3, "a", [0.5, -0.25, 1.0, 2.0]), (1, None, [0.0, 0.1, 0.2, 0.3]), (2, "a", [0.5, -0.25, 1.0, 2.0])], schema)
    got = {r["vec_id"]: r for r in vector_codes.code_rows(few).collect()}
    assert {k: r["code"] for k, r in got.items()} == {1: "00000000", 2: "01010101", 3: "01010101"} and all(r["error"] == 0 for r in got.values())
    odd = spark.createDataFrame([(i, "a", [float(i), 1.0, float(i), 0.5, 0.25]) for i in range(5)], schema)  # filled up to 8
    assert sorted(r["code"] for r in vector_codes.code_rows(odd).collect())[0].startswith("00")
    nothing = vector_codes.code_rows(few.limit(0))
    assert nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and nothing.count() == 0
    hollow = spark.createDataFrame([(1, "a", []), (2, None, [])], schema)
    assert {(r["code"], r["error"], r["label_error"]) for r in vector_codes.code_rows(hollow).collect()} == {("00000000", 0, 0)}
    with pytest.raises(ValueError):
        vector_codes.compress_vectors(few, entries=300)


def test_query_equals_its_sql(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES["op11_vector_codes"](spark, str(folder)).collect())
    assert got and got == sorted(con.execute(vector_codes.SQL).fetchall())
