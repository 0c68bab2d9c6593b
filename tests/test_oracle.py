"""Every registered query against its DuckDB SQL on sf0.001 (the driver's gate, smaller)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from recall.plans.registry import all_queries
from scripts.check_oracle import TABLES, rows_of
from tests.conftest import SF001


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert "tags" in df.columns and "id" in df.columns


def test_every_query_has_a_registered_callable():
    qs, sqls = entry_mod.queries(), entry_mod.oracle_sql()
    store = all_queries()
    assert len(store) == 62  # the 51 operators, and second queries of some
    assert all(sql for _, sql in store.values())
    assert set(store) <= set(qs) and set(sqls) <= set(qs)


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry_mod.queries()[name](spark, SF001)
    cols, rows = df.columns, df.collect()
    cur = duck.execute(entry_mod.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, rows) == rows_of(dcols, cur.fetchall())
