"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def text(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def test_sql_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = sorted(tuple(text(r[c]) for c in columns) for r in frame.collect())
    relation = database.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    place = [relation.columns.index(c) for c in columns]
    assert found == sorted(tuple(text(r[i]) for i in place) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_fitted_models_give_rows(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert len(frame.columns) == len(set(frame.columns))
    frame.collect()
