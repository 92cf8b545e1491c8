"""Every registered query against its check SQL on the smallest tables."""

import datetime
import numbers

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from wardline.driver.checks import CHECKS
from wardline.driver.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def check_engine(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (not isinstance(value, (str, list)) and pd.isna(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return bool(value)
    if isinstance(value, numbers.Number):
        return float(value)
    if isinstance(value, datetime.date):
        return str(value)
    return str(value)


def rows_of(frame):
    columns = sorted(frame.columns)
    rows = [tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return columns, sorted(rows, key=lambda r: tuple(map(str, r)))


def test_same_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    # Operators without a SQL form have tests of their own.
    assert set(QUERIES) == set(CHECKS)


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns[:2] == ["ip", "account_name"]
    assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(entry_module.oracle_sql()))
def test_query(name, spark, sf_dir, check_engine):
    got = entry_module.queries()[name](spark, sf_dir).toPandas()
    want = check_engine.execute(entry_module.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)
