"""The queries that SQL can express agree with DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from axisweave.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = con.execute(ORACLE[name])
    own = [d[0] for d in want.description]
    assert sorted(own) == names
    text = lambda row, at: tuple(str(row[at(c)]) for c in names)
    assert sorted(text(r, lambda c: c) for r in df.collect()) == sorted(text(r, own.index) for r in want.fetchall())
