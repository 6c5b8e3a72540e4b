"""Every query with an oracle agrees with DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from axisweave.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    return f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(ORACLE[name])
    own = [d[0] for d in result.description]
    assert sorted(own) == names
    assert found == sorted(tuple(plain(r[own.index(c)]) for c in names) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_without_llm(tmp_path):
    """The registry imports when the optional subpackage is gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/axisweave", tmp_path / "axisweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'overlap_join' in q and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
