"""Every registered query of the folder that has SQL, against it in DuckDB."""

import glob
import os

import duckdb
import pytest

from keyfold.llm import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = duck.execute(catalog.SQL[name])
    described = [d[0] for d in cursor.description]
    assert sorted(described) == columns
    at = [described.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    actual = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert actual == expected


def test_sql_is_text_and_one_query_for_each_operator():
    assert all(isinstance(sql, str) for sql in catalog.SQL.values())
    assert sorted(int(name[2:].split("_")[0]) for name in catalog.QUERIES) == list(range(1, 11))
