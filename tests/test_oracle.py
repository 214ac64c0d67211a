"""Each registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    fix = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, float) else str(v)
    return list(df.columns), sorted(([fix(v) for v in r] for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() == 720
