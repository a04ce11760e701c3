"""Every registered query with SQL against DuckDB on the given tables; the others for rows and stable schemas."""

import math

import pytest

from storepulse.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["store_id", "name", "slot", "visitors"] and df.count() > 0
