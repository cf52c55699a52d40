"""Checks by fingerprints against checks that compare every row."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keyfold import names
from keyfold.operators import histogram_rows, list_rows, value_state
from keyfold.plans import checks
from keyfold.plans.row_checks import (
    check_list_rows,
    check_map_rows,
    check_report_rows,
    compare_rows,
    differing_rows,
)
from keyfold.sources import sequence


def faults(compared):
    return {r.key: (r.lacking, r.surplus, r.status) for r in checks.faults(compared).collect()}


def state_tables(records):
    return {
        names.VALUE: value_state(records),
        names.LIST: list_rows(records),
        names.MAP: histogram_rows(records),
    }


@pytest.mark.parametrize("total,keys", [(100, 10), (103, 10), (7, 1), (10, 10)])
def test_sound_results_have_no_faults(spark, total, keys):
    records = sequence(spark, total, keys)
    lists = check_list_rows(list_rows(records), total, keys)
    assert faults(lists) == faults(check_map_rows(histogram_rows(records), total, keys)) == {}
    assert {r.rows for r in lists.collect()} <= {total // keys, total // keys + 1}
    report = check_report_rows(state_tables(records), total, keys)
    assert rows(checks.faults(report)) == []
    assert report.count() == 3 * keys


def test_each_damage_to_a_list(spark):
    records = sequence(spark, 100, 10)
    swapped = F.when(F.col("seq") == 5, 1).when(F.col("seq") == 15, 0).otherwise(F.col("value"))
    damaged = (
        list_rows(records)
        .filter("key <> 7 and seq <> 52")
        .withColumn("value", swapped.cast("bigint"))
        .unionByName(list_rows(records).filter("seq in (3, 13, 13)"))
        .unionByName(list_rows(records).filter("key = 1").withColumn("key", F.lit(99).cast("bigint")))
    )
    assert faults(check_list_rows(damaged, 100, 10)) == {
        7: (10, 0, "missing"),
        2: (1, 0, "wrong"),
        5: (2, 2, "wrong"),
        3: (0, 2, "duplicate"),
        99: (0, 10, "extra"),
    }


def test_a_count_raised_and_a_value_doubled(spark):
    maps = histogram_rows(sequence(spark, 100, 10))
    raised = F.col("n") + F.when((F.col("key") == 4) & (F.col("value") == 0), 1).otherwise(0)
    damaged = maps.withColumn("n", raised).unionByName(maps.filter("key = 6 and value = 2"))
    assert faults(check_map_rows(damaged, 100, 10)) == {4: (1, 1, "wrong"), 6: (0, 1, "duplicate")}


def test_report_names_the_operator(spark):
    tables = state_tables(sequence(spark, 60, 6))
    tables[names.VALUE] = tables[names.VALUE].withColumn(
        "total", F.col("total") + F.when(F.col("key") == 2, 1).otherwise(0)
    )
    tables[names.LIST] = tables[names.LIST].filter("key <> 3")
    found = checks.faults(check_report_rows(tables, 60, 6))
    assert rows(found.select("operator", "key", "lacking", "surplus", "status")) == [
        (names.LIST, 3, 10, 0, "missing"),
        (names.VALUE, 2, 1, 1, "wrong"),
    ]
    with pytest.raises(ValueError, match="no tables"):
        check_report_rows({}, 60, 6)


def frame(spark, data):
    return spark.createDataFrame(data, "key bigint, a bigint, b string")


def test_what_plain_sums_and_hashes_would_miss(spark):
    """Nulls that change places, pairs of copies, sums that agree, a null key."""
    left = [(1, None, "5"), (2, 1, "x"), (2, 1, "x"), (3, 1, "x"), (3, 4, "x"), (None, 1, "x"), (4, 1, None)]
    right = [(1, 5, None), (2, 2, "x"), (2, 2, "x"), (3, 2, "x"), (3, 3, "x"), (None, 2, "x"), (4, 1, None)]
    found = faults(compare_rows(frame(spark, left), frame(spark, right)))
    assert set(found) == {1, 2, 3, None}
    assert {status for _, _, status in found.values()} == {"wrong"}
    plain = checks.difference(frame(spark, left), frame(spark, right))
    assert rows(differing_rows(frame(spark, left), frame(spark, right))) == rows(plain)


def test_empty_sides_and_clashing_names(spark):
    empty, some = frame(spark, []), frame(spark, [(1, 1, "x")])
    assert rows(compare_rows(empty, empty)) == rows(differing_rows(empty, empty)) == []
    assert faults(compare_rows(empty, some)) == {1: (1, 0, "missing")}
    assert faults(compare_rows(some, empty)) == {1: (0, 1, "extra")}
    assert rows(differing_rows(some, empty)) == [(1, 1, "x", 1)]
    clash = spark.createDataFrame([(1, 2, 3, 4, "z")], "k int, row int, sign int, sign_ int, `a.b` string")
    assert rows(compare_rows(clash, clash, ("k", "a.b"))) == [(1, "z", 1, 1, 0, 0, "ok")]
    assert rows(differing_rows(clash, clash.limit(0), ("k",))) == [(1, 2, 3, 4, "z", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_comparison_of_all_rows(spark, seed):
    draw = random.Random(seed)

    def some(n):
        return [
            (draw.choice([None, 1, 2, 3, 4]), draw.choice([None, 0, 1]), draw.choice([None, "", "0"]))
            for _ in range(n)
        ]

    shared = some(40)
    left, right = frame(spark, shared + some(3)), frame(spark, shared[::-1] + some(3))
    plain = checks.difference(left, right)
    assert rows(differing_rows(left, right)) == rows(plain)
    counted = {}
    for key, _, _, n in rows(plain):
        lacking, surplus = counted.get(key, (0, 0))
        counted[key] = (lacking + max(-n, 0), surplus + max(n, 0))
    found = {key: pair[:2] for key, pair in faults(compare_rows(left, right)).items()}
    assert found == counted


def test_a_long_list_moves_one_row_a_key(spark):
    """The exchange before the fingerprints holds sums, no rows of the list."""
    records = list_rows(sequence(spark, 200_000, 2))
    assert faults(check_list_rows(records.filter("seq <> 77777"), 200_000, 2)) == {1: (1, 0, "wrong")}
