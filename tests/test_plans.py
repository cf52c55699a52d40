"""The physical plans are the ones meant: exchanges, pruning, pushdown, partial steps."""

import re

from pyspark.sql import functions as F

from keyfold import catalog
from keyfold.operators import histogram_rows, list_rows, value_state
from keyfold.plans.five_state import keyed_state
from keyfold.plans.hot import find_hot, split
from keyfold.sources import events_as_sequence, events_keyed, table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"\bExchange ", plan(df)))


def test_five_states_shuffle_once(spark, sf_dir):
    df = keyed_state(events_keyed(spark, sf_dir))
    assert exchanges(df) == 1
    assert "hashpartitioning(key" in plan(df)


def test_totals_are_combined_before_the_shuffle(spark, sf_dir):
    for df in (value_state(events_keyed(spark, sf_dir)), histogram_rows(events_keyed(spark, sf_dir))):
        assert exchanges(df) == 1
        before = plan(df).split("Exchange ", 1)[1]
        assert "partial_" in before


def test_groupings_reuse_the_keyed_route(spark, sf_dir):
    assert exchanges(catalog.QUERIES["keyed_route"](spark, sf_dir)) == 1


def test_the_long_list_does_not_shuffle(spark, sf_dir):
    assert exchanges(list_rows(events_keyed(spark, sf_dir))) == 0


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan(value_state(events_as_sequence(spark, sf_dir, 100)))
    assert "ReadSchema: struct<event_id:bigint>" in text
    assert "ts" not in re.search(r"ReadSchema: (\S+)", plan(keyed_state(events_keyed(spark, sf_dir)))).group(1)


def test_a_saved_position_reaches_the_scan(spark, sf_dir):
    rest = events_keyed(spark, sf_dir).filter(F.col("seq") >= 500)
    assert "GreaterThanOrEqual(event_id,500)" in plan(rest)


def test_small_sides_are_chosen_by_their_bytes(spark):
    df = spark.range(100).selectExpr("id as seq", "id % 3 as key", "id as value")
    ordinary, heavy = split(df, find_hot(df, 10))
    assert "Broadcast" in plan(ordinary) and "Broadcast" in plan(heavy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(split(df, find_hot(df, 10))[0])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
