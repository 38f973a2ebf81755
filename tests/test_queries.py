"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from chirplake.plans import queries as core


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(r) for r in clean.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "n_splits", "splits", "rows"]
