"""Map state: per key, how often each value came.

The long form (key, value, n) is the main result: counts are combined before the
shuffle and a hot key spreads by value. The nested form holds at most ``per_row``
entries per row, ascending by value, and goes on in further parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import int_div
from ..plans.hot import HOT_ROWS, HotKeys, find_hot, positions, split


def histogram_rows(records: DataFrame) -> DataFrame:
    """(key, value, n): one row per map entry."""
    return records.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def entries() -> Column:
    """Aggregate: (value, n) structs of the group, ascending by value."""
    return F.sort_array(F.collect_list(F.struct("value", "n")))


def count_values(items: Column) -> Column:
    """(value, n) entries of an array, ascending by value: runs of its sorted values.

    Takes time linear in the array after the sort. The sorted array and the starts
    of its runs are bound as lambda arguments, so that each is made once.
    """

    def runs(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        is_start = lambda i: (i == 0) | ~F.get(ordered, i).eqNullSafe(F.get(ordered, i - 1))
        return _bind(F.filter(places, is_start), lambda starts: entries_of(ordered, starts))

    def entries_of(ordered: Column, starts: Column) -> Column:
        def entry(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(ordered))
            n = (end - start).cast("bigint")
            return F.struct(F.get(ordered, start).alias("value"), n.alias("n"))

        return F.transform(starts, entry)

    return _bind(F.sort_array(items), runs)


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def histogram_parts(records: DataFrame, per_row: int = HOT_ROWS) -> DataFrame:
    """(key, part, entries): entries is an array of (value, n), ascending by value."""
    records = records.select("key", "value")
    # A key with few rows has few values: hot keys are found without counting values.
    hot = find_hot(records, per_row)
    ordinary, heavy = split(records, hot)
    return _nest(histogram_rows(ordinary), None if hot is None else histogram_rows(heavy), hot)


def nest_histogram(long_form: DataFrame, per_row: int = HOT_ROWS) -> DataFrame:
    """The nested form from (key, value, n) rows, one per key and value."""
    hot = find_hot(long_form, per_row)
    return _nest(*split(long_form, hot), hot)


def _nest(ordinary: DataFrame, heavy: DataFrame | None, hot: HotKeys | None) -> DataFrame:
    out = ordinary.groupBy("key").agg(entries().alias("entries"))
    out = out.select("key", F.lit(0).cast("bigint").alias("part"), "entries")
    return out if heavy is None else out.unionByName(entry_parts(heavy, hot))


def entry_parts(long_form: DataFrame, hot: HotKeys) -> DataFrame:
    """Maps of hot keys, cut by rank of value. A key has no more values than rows."""
    return (
        positions(long_form, hot, "value")
        .groupBy("key", int_div(F.col("pos"), hot.limit).alias("part"))
        .agg(entries().alias("entries"))
    )
