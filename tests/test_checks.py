"""Each kind of damage gives its status, and sound results give none."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keyfold import names
from keyfold.operators import histogram_parts, histogram_rows, list_parts, value_state
from keyfold.plans import checks
from keyfold.plans.five_state import keyed_state
from keyfold.plans.payloads import result_lines, state_payloads, table_payloads
from keyfold.plans.sinks import read_lines, write_lines, write_result_lines
from keyfold.functions import (
    parse_histogram_rows,
    parse_list_rows,
    parse_payload_lines,
    parse_total_lines,
)
from keyfold.sources import sequence
from keyfold.workdir import fresh_dir


def status(compared):
    return {r.key: r.status for r in checks.faults(compared).collect()}


@pytest.mark.parametrize("total,keys", [(100, 10), (103, 10), (7, 1), (10, 10), (300, 7)])
@pytest.mark.parametrize("per_row", [4, 1000])
def test_sound_results_have_no_faults(spark, total, keys, per_row):
    records = sequence(spark, total, keys)
    report = checks.check_report(
        state_payloads(keyed_state(records, hot_rows=per_row)), total, keys, per_row=per_row
    )
    assert rows(checks.faults(report)) == []
    checks.raise_on_faults(checks.faults(report))
    lists = checks.check_list(list_parts(records, per_row), total, keys, per_row)
    maps = checks.check_histogram(histogram_parts(records, per_row), total, keys, per_row)
    assert status(lists) == status(maps) == {}


def test_each_damage_to_totals(spark):
    totals = value_state(sequence(spark, 100, 10))
    damaged = (
        totals.filter("key <> 7")
        .withColumn("total", F.when(F.col("key") == 5, 0).otherwise(F.col("total")))
        .unionByName(totals.filter("key = 3"))
        .unionByName(totals.filter("key = 1").withColumn("key", F.lit(99).cast("bigint")))
    )
    found = checks.check_totals(damaged, 100, 10)
    assert status(found) == {7: "missing", 5: "wrong", 3: "duplicate", 99: "extra"}
    assert rows(checks.duplicates(damaged)) == [(3, 2)]
    assert rows(checks.missing(damaged, totals)) == [(7,)]
    with pytest.raises(checks.ResultError, match="duplicate"):
        checks.raise_on_faults(checks.faults(found))


def test_swapped_list_elements_and_a_wrong_count(spark):
    records = sequence(spark, 100, 10)
    lists = list_parts(records).withColumn(
        "items",
        F.when(
            F.col("key") == 2,
            F.concat(F.array(F.col("items")[1], F.col("items")[0]), F.slice("items", 3, 100)),
        ).otherwise(F.col("items")),
    )
    assert status(checks.check_list(lists, 100, 10)) == {2: "wrong"}
    raised = F.transform(
        "entries",
        lambda e, i: F.struct(e["value"].alias("value"), (e["n"] + F.when(i == 0, 1).otherwise(0)).alias("n")),
    )
    maps = histogram_parts(records).withColumn(
        "entries", F.when(F.col("key") == 4, raised).otherwise(F.col("entries"))
    )
    assert status(checks.check_histogram(maps, 100, 10)) == {4: "wrong"}


def test_a_part_that_is_missing(spark):
    parts = list_parts(sequence(spark, 100, 10), per_row=4)
    found = checks.check_list(parts.filter("not (key = 6 and part = 1)"), 100, 10, per_row=4)
    assert [(r.key, r.part, r.status) for r in checks.faults(found).collect()] == [(6, 1, "missing")]


def test_fewer_records_than_keys(spark):
    """Keys without records have no state and are missing from a totals check."""
    records = sequence(spark, 3, 5)
    assert status(checks.check_totals(value_state(records), 3, 5)) == {3: "missing", 4: "missing"}
    assert status(checks.check_list(list_parts(records), 3, 5)) == {}


def test_difference_counts_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    right = spark.createDataFrame([(1,), (3,)], "v int")
    assert rows(checks.difference(left, right)) == [(1, 1), (2, 1), (3, -1)]
    assert rows(checks.difference(left, left)) == []


def test_lines_round_trip(spark):
    records = sequence(spark, 50, 4)
    lines = result_lines(state_payloads(keyed_state(records)))
    path = fresh_dir(spark, "results")
    write_result_lines(lines, path)
    totals = parse_total_lines(read_lines(spark, f"{path}/operator={names.VALUE}"))
    assert rows(totals.select("key", "total")) == rows(value_state(records))
    lists = parse_payload_lines(read_lines(spark, f"{path}/operator={names.LIST}"))
    assert rows(lists.select("key", "payload"))[0] == (0, " ".join(map(str, range(13))))


@pytest.mark.parametrize("per_row", [1, 4, 1000])
def test_lines_in_parts_keep_their_order(spark, per_row):
    """A list or map in many parts comes back element by element, from any order of lines."""
    data = [(i, i % 3 if i % 11 else None, None if i % 7 == 0 else i % 5) for i in range(60)]
    records = spark.createDataFrame(data, "seq bigint, key bigint, value bigint")
    tables = {names.LIST: records, names.MAP: histogram_rows(records)}
    path = fresh_dir(spark, "results")
    write_result_lines(result_lines(table_payloads(tables, per_row)), path)
    mixed = read_lines(spark, f"{path}/operator={names.LIST}").orderBy(F.xxhash64("value"))
    found = {}
    for key, pos, value in sorted(rows(parse_list_rows(mixed, per_row)), key=lambda r: r[1]):
        assert pos == len(found.setdefault(key, []))
        found[key].append(value)
    listed = {}
    for seq, key, value in data:
        listed.setdefault(key, []).append(value)
    assert found == listed and set(listed) == {0, 1, 2, None}
    maps = parse_histogram_rows(read_lines(spark, f"{path}/operator={names.MAP}"), per_row)
    assert rows(maps.select("key", "value", "n")) == rows(tables[names.MAP].select("key", "value", "n"))


def test_heads_of_lines(spark):
    lines = spark.createDataFrame([("5 1 2",), ("5:2 3",), ("5:x 4",), ("-6:1",), ("",)], "value string")
    assert rows(parse_payload_lines(lines).select("key", "part", "payload")) == sorted(
        [(5, 0, "1 2"), (5, 2, "3"), (5, None, "4"), (-6, 1, None), (None, 0, None)], key=repr
    )


def test_unreadable_lines_are_reported_not_raised(spark):
    path = fresh_dir(spark, "lines")
    lines = spark.createDataFrame([("1 10",), ("x 2",), ("3",), ("4   40",)], "line string")
    write_lines(lines, path)
    found = rows(parse_total_lines(read_lines(spark, path)))
    assert found == sorted(
        [(1, 10, "1 10"), (None, 2, "x 2"), (3, None, "3"), (4, 40, "4   40")], key=repr
    )
