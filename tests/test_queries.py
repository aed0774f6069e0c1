"""Every registered query beside its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from tapeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, (bool, str)) or type(x).__name__ == "bool_":
            return str(x)
        try:
            return f"{float(x):.8g}"
        except (TypeError, ValueError):
            return str(x)

    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE:
        assert rows(got) == rows(duck.sql(ORACLE[name]).df())
    else:
        assert len(got.columns)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert registry.FLAGSHIP in QUERIES
