"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def counted(rows):
    plain = lambda x: ("nan" if x != x else round(x, 5) + 0.0) if isinstance(x, float) else x
    return Counter(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, sf, duck, name):
    df, want = __spark_entry__.queries()[name](spark, sf), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert counted(map(tuple, df.select(*columns).collect())) == counted(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_names():
    assert not {*SQL} - {*__spark_entry__.queries()}
    assert DATA
