"""Every registered query of the library's own operators against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from folio.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    """pandas turns whole numbers into floats where a column has nulls."""
    x = None if pd.isna(x) else getattr(x, "item", lambda: x)()
    return repr(int(x) if isinstance(x, float) and x.is_integer() else x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(value(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
