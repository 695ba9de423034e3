"""Every registered query against its SQL twin."""

import duckdb
import numpy as np
import pytest

from kgaudit.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    df = df[sorted(df.columns)]

    def show(x):
        if x is None or str(x) in ("<NA>", "nan", "NaT"):
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(tuple(show(x) for x in row) for row in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert cells(got) == cells(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
