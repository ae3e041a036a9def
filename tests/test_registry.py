"""Every registered query of the library itself against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from quillvec.plans.registry import ORACLES, QUERIES, UNCHECKED


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) | set(UNCHECKED)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    wanted = duck.execute(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    found, wanted = (
        df[columns].sort_values(columns).reset_index(drop=True) for df in (found, wanted)
    )
    assert len(found) == len(wanted) > 0
    for column in columns:
        assert found[column].dtype.kind == wanted[column].dtype.kind, column
        same = (found[column] == wanted[column]) | (found[column].isna() & wanted[column].isna())
        assert same.all(), column


def test_flagship(spark):
    report = driver.entry(spark)
    assert report.count() == 2
