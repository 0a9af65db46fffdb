"""Every query with SQL against it, and that all are registered."""

import duckdb
import pytest

import __spark_entry__
from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_all_are_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
