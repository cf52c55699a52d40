"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from keyfold import catalog


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def assert_equals_sql(duck, found, sql):
    columns = sorted(found.columns)
    cursor = duck.execute(sql)
    described = [d[0] for d in cursor.description]
    assert sorted(described) == columns
    at = [described.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    actual = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert actual == expected


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert_equals_sql(duck, catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])


@pytest.mark.parametrize("per_row", [3, 64])
@pytest.mark.parametrize(
    "name",
    ["check_list", "check_list_damaged", "check_map", "check_map_damaged", "check_report", "check_report_damaged"],
)
def test_checks_equal_sql_in_parts_of_any_size(spark, duck, sf_dir, name, per_row):
    found = getattr(catalog, name)(spark, sf_dir, per_row)
    assert_equals_sql(duck, found, getattr(catalog, f"{name}_sql")(per_row))


def test_lanes_equal_sql_with_many_a_key(spark, duck, sf_dir):
    # So many rows a lane that the hash leaves none empty.
    assert_equals_sql(duck, catalog.keyed_route(spark, sf_dir, 30), catalog.route_sql(30))
