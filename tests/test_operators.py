"""Batch operators against plain Python, with and without hot keys."""

from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from keyfold import names
from keyfold.catalog import integer_mean
from keyfold.functions import unwrap, wrap
from keyfold.operators import (
    ColumnAggregate,
    aggregating_state,
    histogram_parts,
    histogram_rows,
    list_parts,
    nest_histogram,
    reducing_state,
    reducing_state_ordered,
    route,
    running_value,
    value_state,
)
from keyfold.operators.histogram import count_values
from keyfold.plans.five_state import keyed_state
from keyfold.plans.hot import find_hot
from keyfold.sources import sequence

SCHEMA = "seq bigint, key bigint, value bigint"

# Sparse and unsorted seq, one key with most of the rows, negative values.
records_strategy = st.lists(
    st.tuples(st.sampled_from([1, 1, 1, 1, 2, 3, 4]), st.integers(-5, 5)), min_size=1, max_size=60
).flatmap(
    lambda pairs: st.permutations(range(len(pairs))).map(
        lambda order: [(order[i] * 1000 + 7, *pairs[i]) for i in range(len(pairs))]
    )
)
few = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def by_key(data):
    lists = defaultdict(list)
    for _, key, value in sorted(data):
        lists[key].append(value)
    return lists


def parts_of(items, size):
    return [items[i : i + size] for i in range(0, len(items), size)]


@few
@given(data=records_strategy, limit=st.sampled_from([3, 1000]))
def test_operators_equal_python(spark, data, limit):
    df = spark.createDataFrame(data, SCHEMA)
    lists = by_key(data)

    assert rows(value_state(df)) == sorted((k, sum(v)) for k, v in lists.items())
    assert rows(reducing_state(df, "min")) == sorted((k, min(v)) for k, v in lists.items())

    running = rows(running_value(df, limit).select("key", "seq", "running"))
    expected = []
    for key in lists:
        seqs = sorted(s for s, k, _ in data if k == key)
        expected += zip([key] * len(seqs), seqs, accumulate(lists[key]))
    assert running == sorted(expected, key=repr)

    last = reducing_state_ordered(df, lambda a, b: b, limit, associative=True)
    assert rows(last) == sorted((k, v[-1]) for k, v in lists.items())
    mean = aggregating_state(df, integer_mean(), limit)
    assert rows(mean) == sorted((k, int(sum(v) / len(v))) for k, v in lists.items())

    found = sorted((r.key, r.part, list(r["items"])) for r in list_parts(df, limit).collect())
    assert found == sorted(
        (k, i, p) for k, v in lists.items() for i, p in enumerate(parts_of(v, limit))
    )
    expected_entries = sorted(
        (k, i, p)
        for k, v in lists.items()
        for i, p in enumerate(parts_of(sorted(Counter(v).items()), limit))
    )
    for nested in (histogram_parts(df, limit), nest_histogram(histogram_rows(df), limit)):
        found = sorted((r.key, r.part, [tuple(e) for e in r.entries]) for r in nested.collect())
        assert found == expected_entries


@few
@given(data=records_strategy, limit=st.sampled_from([3, 1000]))
def test_five_states_in_one_plan(spark, data, limit):
    found = keyed_state(spark.createDataFrame(data, SCHEMA), hot_rows=limit).collect()
    lists = by_key(data)
    heads = {r.key: r for r in found if r.part == 0}
    assert set(heads) == set(lists)
    for key, values in lists.items():
        assert heads[key].value_state == sum(values)
        assert heads[key].reducing_state == sum(values)
        assert heads[key].aggregating_state == sum(values)
        mine = sorted((r for r in found if r.key == key), key=lambda r: r.part)
        assert [v for r in mine for v in r.list_state or []] == values
        entries = [tuple(e) for r in mine for e in r.map_state or []]
        assert entries == sorted(Counter(values).items())
        assert all(len(r.list_state or []) <= limit for r in mine)


def test_order_sensitive_merge_keeps_order_over_splits(spark):
    """Affine maps x -> a*x + b, packed as a*1000 + b mod 97: associative, not commutative."""
    df = sequence(spark, 200, 3).withColumn("value", (F.col("seq") % 89 + 2) * 1000 + F.col("seq") % 83)

    def compose(x, y):
        ax, bx = F.floor(x / 1000), x % 1000
        ay, by = F.floor(y / 1000), y % 1000
        return ((ax * ay) % 97) * 1000 + (ay * bx + by) % 97

    whole = reducing_state_ordered(df, compose, associative=True)
    split = reducing_state_ordered(df, compose, hot_rows=4, associative=True)
    assert rows(whole) == rows(split)
    turned = df.withColumn("seq", -F.col("seq"))
    assert rows(whole) != rows(reducing_state_ordered(turned, compose, associative=True))


def test_string_struct_and_null_keys(spark):
    plain = sequence(spark, 100, 4)
    for key in (F.concat(F.lit("k"), F.col("key")), F.struct("key"), F.nullif("key", F.lit(1))):
        df = plain.withColumn("key", key)
        expected = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        split = list_parts(df, 10).groupBy("key").agg(F.sum(F.size("items")).alias("n"))
        assert rows(split) == rows(expected)


def test_wrapped_records(spark):
    wrapped = sequence(spark, 30, 4, wrapped=True)
    assert wrapped.schema["key"].dataType.simpleString() == "struct<value:bigint>"
    assert rows(unwrap(wrapped)) == rows(sequence(spark, 30, 4))
    assert rows(wrap(sequence(spark, 30, 4))) == rows(wrapped)
    by_struct = value_state(wrapped.withColumn("value", F.col("value.value")))
    assert rows(by_struct.select("key.value", "total")) == rows(value_state(unwrap(wrapped)))


@pytest.mark.parametrize("total,keys", [(0, 3), (2, 5), (7, 1), (7, 7), (100, 7)])
def test_sequence_shape(spark, total, keys):
    expected = [(i, i % keys, i // keys) for i in range(total)]
    assert rows(sequence(spark, total, keys)) == sorted(expected, key=repr)
    resumed = sequence(spark, total, keys, start=total // 2)
    assert rows(resumed) == sorted(expected[total // 2 :], key=repr)


def test_sums_do_not_wrap_at_32_bits(spark):
    df = spark.createDataFrame([(0, 1, 2**31 - 1), (1, 1, 2**31 - 1)], SCHEMA)
    assert rows(value_state(df)) == [(1, 2**32 - 2)]


def test_no_records_no_state(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert find_hot(df) is None
    assert rows(keyed_state(df)) == []


def test_values_of_an_array_are_counted_in_order(spark):
    arrays = [([3, 1, 3, 3, 1],), ([5],), ([2, None, 2, None],)]
    found = spark.createDataFrame(arrays, "items array<bigint>").select(
        count_values(F.col("items")).alias("entries")
    )
    assert [[tuple(e) for e in r.entries] for r in found.collect()] == [
        [(1, 2), (3, 3)],
        [(5, 1)],
        [(None, 2), (2, 2)],
    ]


def test_route_keeps_lanes_together_and_spreads_hot_keys(spark):
    df = sequence(spark, 1000, 1).unionByName(
        sequence(spark, 30, 3).withColumns({"key": F.col("key") + 10, "seq": F.col("seq") + 5000})
    )
    placed = route(df, partitions=8, hot_rows=100).withColumn("at", F.spark_partition_id())
    per_lane = placed.groupBy("key", "lane").agg(F.countDistinct("at").alias("places"))
    assert {r.places for r in per_lane.collect()} == {1}
    assert placed.filter("key = 0").select("at").distinct().count() > 1
    assert placed.filter("key >= 10").select("lane").distinct().count() == 1
    assert placed.count() == 1030


def test_unknown_combiner(spark):
    with pytest.raises(ValueError, match="median"):
        reducing_state(sequence(spark, 3, 1), "median")


def test_operator_names_are_fixed():
    assert names.OPERATORS == (
        "value_state",
        "reducing_state",
        "aggregating_state",
        "list_state",
        "map_state",
    )


def test_hot_keys_of_a_table_that_grows(spark, tmp_path):
    path = str(tmp_path / "grows")
    make = lambda frm, to: spark.range(frm, to).selectExpr("id as seq", "0L as key", "1L as value")
    make(0, 150).write.parquet(path)
    fold = lambda: reducing_state_ordered(spark.read.parquet(path), lambda a, b: a + b, 10, associative=True)
    assert rows(fold()) == [(0, 150)]
    make(150, 9150).write.mode("append").parquet(path)
    assert rows(fold()) == [(0, 9150)]
    assert [r.n for r in list_parts(spark.read.parquet(path), 5000).selectExpr("size(items) as n").orderBy("part").collect()] == [5000, 4150]


def test_folds_must_be_said_to_be_associative(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 0, 3)], "seq bigint, key bigint, value bigint")
    with pytest.raises(ValueError):
        reducing_state_ordered(df, lambda a, b: a - b)
    with pytest.raises(ValueError):
        aggregating_state(df, ColumnAggregate(zero=lambda: F.lit(1), add=lambda a, v: a * v, merge=lambda a, b: a * b))
    with pytest.raises(ValueError):
        keyed_state(df, lambda a, b: a - b)
