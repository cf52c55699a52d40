"""Aggregating state: an accumulator per key that differs from its input and result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import int_div
from ..plans.hot import HOT_ROWS, HotKeys, find_hot, positions, split
from .reducing import merge_levels, ordered, present, require_associative


@dataclass(frozen=True)
class ColumnAggregate:
    """A user aggregate as column functions.

    A hot key has an accumulator for each run of its values, all begun with ``zero`` and then
    merged. ``associative`` states that this makes no difference: that ``merge`` is
    associative, that adding values and merging agree, and that ``zero`` is neutral for ``merge``.
    """

    zero: Callable[[], Column]
    add: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda acc: acc
    associative: bool = False

    def accumulate(self, items: Column) -> Column:
        """Nulls are skipped; a key of nulls only has a null accumulator, like its sum."""
        values = present(items)
        return F.when(F.size(values) > 0, F.aggregate(values, self.zero(), self.add))


def sum_aggregate() -> ColumnAggregate:
    return ColumnAggregate(
        zero=lambda: F.lit(0).cast("bigint"),
        add=lambda acc, value: acc + value,
        merge=lambda a, b: a + b,
        associative=True,
    )


def aggregating_state(
    records: DataFrame, how: ColumnAggregate | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(key, aggregated). Values are added in ``seq`` order.

    A hot key is accumulated in runs of ``hot_rows`` neighbours, each in its own
    group, and the accumulators are merged. Raises unless ``how`` states that it is
    associative.
    """
    how = how or sum_aggregate()
    require_associative(how.associative)
    records = records.select("seq", "key", "value")
    hot = find_hot(records, hot_rows)
    ordinary, heavy = split(records, hot)

    out = ordinary.groupBy("key").agg(ordered("seq", "value").alias("items"))
    out = out.select("key", how.accumulate(F.col("items")).alias("acc"))
    if heavy is not None:
        out = out.unionByName(aggregate_placed(positions(heavy, hot, "seq"), how, hot))
    return out.select("key", how.finish(F.col("acc")).alias("aggregated"))


def aggregate_placed(placed: DataFrame, how: ColumnAggregate, hot: HotKeys) -> DataFrame:
    """(key, acc) of hot keys, from rows that have their position."""
    runs = (
        placed.groupBy("key", int_div(F.col("pos"), hot.limit).alias("run"))
        .agg(ordered("pos", "value").alias("items"))
        .select("key", F.col("run").alias("pos"), how.accumulate(F.col("items")).alias("acc"))
    )
    count = -(-hot.largest // hot.limit)
    return merge_levels(runs, "acc", how.merge, count, hot.limit)
