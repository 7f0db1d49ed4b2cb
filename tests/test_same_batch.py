"""Figures of one part that are the same batch as a whole one, against the query's SQL."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tallyrack.plans import registry


def test_pairs_meet_on_neighbouring_whole_figures(spark, tmp_path):
    at = random.Random(5)
    # the first price is a half whose double lies below it; part 2 has many figures, of which few are near
    rows = [(1, 80585.0), (1, 80580.0), (1, 81000.0)] + [(2, float(at.randint(1, 3_000_000))) for _ in range(3000)] + [(3, 500.0), (3, None)]
    pq.write_table(pa.table({"l_partkey": [r[0] for r in rows], "l_extendedprice": [r[1] for r in rows]}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    found = registry.QUERIES["same_batch_pairs"](spark, str(tmp_path))
    want = dict(con.execute(f"select l_partkey, n from ({registry.ORACLE_SQL['same_batch_pairs']})").fetchall())
    assert {r["l_partkey"]: r["n"] for r in found.collect()} == want and len(want) == 3
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("(w#" in x for x in joins)  # else all figures of a part meet
