"""Each query with SQL gives the rows of its SQL."""

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from bytestrata import queries as engine

D = "/root/testdata/sf0.001"


def _norm(rows):
    def one(v):
        if isinstance(v, (float, Decimal)):
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert _norm(df.select(*cols).collect()) == _norm(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(entry.queries())
