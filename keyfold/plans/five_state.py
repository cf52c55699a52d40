"""All five operators over the same records in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..functions.numbers import int_div
from ..operators.aggregating import ColumnAggregate, sum_aggregate
from ..operators.histogram import count_values, entry_parts, histogram_rows
from ..operators.reducing import Merge, fold, merge_levels, ordered, require_associative
from ..workdir import materialize
from .hot import HOT_ROWS, HotKeys, find_hot, positions, split


def _add(a, b):
    return a + b


def keyed_state(
    records: DataFrame,
    reduce: Merge | None = None,
    aggregate: ColumnAggregate | None = None,
    hot_rows: int = HOT_ROWS,
    *,
    associative: bool = False,
) -> DataFrame:
    """(key, part, value_state, reducing_state, aggregating_state, list_state, map_state).

    One row per key. ``list_state`` is an array of values in ``seq`` order and
    ``map_state`` an array of (value, n). A hot key has further rows, part 1, 2 …,
    which carry the rest of its list and map and null elsewhere.

    Ordinary keys cost one exchange and one grouping. Raises unless the caller states that
    a ``reduce`` of its own is associative.
    """
    require_associative(associative or reduce is None)
    reduce = reduce or _add
    aggregate = aggregate or sum_aggregate()
    require_associative(aggregate.associative)
    records = records.select("seq", "key", "value")
    hot = find_hot(records, hot_rows)
    ordinary, heavy = split(records, hot)

    items = F.col(names.LIST)
    out = (
        ordinary.groupBy("key")
        .agg(F.sum("value").alias(names.VALUE), ordered("seq", "value").alias(names.LIST))
        .select(
            "key",
            F.lit(0).cast("bigint").alias("part"),
            names.VALUE,
            fold(items, reduce).alias(names.REDUCING),
            aggregate.finish(aggregate.accumulate(items)).alias(names.AGGREGATING),
            names.LIST,
            count_values(items).alias(names.MAP),
        )
    )
    return out if heavy is None else out.unionByName(_hot_states(heavy, hot, reduce, aggregate))


def _hot_states(
    heavy: DataFrame, hot: HotKeys, reduce: Merge, aggregate: ColumnAggregate
) -> DataFrame:
    items = F.col("items")
    # Runs of neighbours, as long as a row may be. Written once for four operators.
    runs = materialize(
        positions(heavy, hot, "seq")
        .groupBy("key", int_div(F.col("pos"), hot.limit).alias("part"))
        .agg(F.sum("value").alias("subtotal"), ordered("pos", "value").alias("items"))
        .withColumns(
            {"reduced": fold(items, reduce), "acc": aggregate.accumulate(items)}
        ),
        "hot-runs",
    )
    runs_per_key = -(-hot.largest // hot.limit)

    def merged(item: str, merge: Merge) -> DataFrame:
        placed = runs.select("key", F.col("part").alias("pos"), item)
        return merge_levels(placed, item, merge, runs_per_key, hot.limit)

    first = F.lit(0).cast("bigint").alias("part")
    finished = aggregate.finish(F.col("acc")).alias(names.AGGREGATING)
    pieces = [
        runs.groupBy("key").agg(F.sum("subtotal").alias(names.VALUE)).select("key", first, names.VALUE),
        merged("reduced", reduce).select("key", first, F.col("reduced").alias(names.REDUCING)),
        merged("acc", aggregate.merge).select("key", first, finished),
        runs.select("key", "part", items.alias(names.LIST)),
        entry_parts(histogram_rows(heavy), hot).withColumnRenamed("entries", names.MAP),
    ]
    # Every (key, part) has at most one row per piece, so first() picks, never drops.
    stacked = pieces[0]
    for piece in pieces[1:]:
        stacked = stacked.unionByName(piece, allowMissingColumns=True)
    return stacked.groupBy("key", "part").agg(
        *(F.first(c, ignorenulls=True).alias(c) for c in names.OPERATORS)
    )
