"""Catalogue queries against their SQL on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from lodestream.plans import catalog, reports  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, datetime.datetime):
            return v.date().isoformat()
        if isinstance(v, datetime.date):
            return v.isoformat()
        if isinstance(v, float):  # pandas makes whole numbers with nulls floats
            return int(v) if float(v).is_integer() else round(float(v), 6)
        return v.item() if hasattr(v, "item") else v

    columns = sorted(frame.columns)
    return sorted(repr([plain(v) for v in r]) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as from '{SF}/{name}.parquet'")
    return con


#: All queries with SQL, those of ``plans.reports`` included.
CHOSEN = sorted(catalog.SQL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.SQL[name]).df())


@pytest.mark.parametrize("name", ["dehyphenated_lines", "legal_chunks"])
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
