"""Reducing state: values of a key folded pairwise, with no start value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import int_div
from ..plans.hot import HOT_ROWS, HotKeys, find_hot, positions, split

Merge = Callable[[Column, Column], Column]

# Combining functions Spark has built in, by name.
COMBINERS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "bit_and": F.bit_and,
    "bit_or": F.bit_or,
    "bit_xor": F.bit_xor,
}

# Those that ask for the order of values, by name: the first or last that is not null.
ORDERED: dict[str, Callable[[Column], Column]] = {"first": F.min, "last": F.max}


def numbered_value(seq: Column, value: Column) -> Column:
    """A value with its place, null if it is null: the least of these is the first value."""
    return F.when(value.isNotNull(), F.struct(seq.cast("bigint").alias("seq"), value.cast("bigint").alias("value")))


def combiner(name: str) -> Callable[[str], Column]:
    if name not in COMBINERS:
        raise ValueError(f"unknown combiner {name!r}; one of {sorted({*COMBINERS, *ORDERED})}")
    return COMBINERS[name]


def reducing_state(records: DataFrame, how: str = "sum") -> DataFrame:
    """(key, reduced) with a built-in combiner, combined before the shuffle."""
    if how in ORDERED:
        found = ORDERED[how](numbered_value(F.col("seq"), F.col("value")))["value"]
        return records.groupBy("key").agg(found.alias("reduced"))
    return records.groupBy("key").agg(combiner(how)("value").alias("reduced"))


def fold(values: Column, merge: Merge) -> Column:
    """Fold an array left to right. Nulls are skipped, as by ``sum``; of nulls only, null."""
    values = present(values)
    return F.reduce(F.slice(values, 2, F.size(values)), F.get(values, F.lit(0)), merge)


def present(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull())


def ordered(order: str, item: str) -> Column:
    """Aggregate: the ``item`` values of the group as an array, ascending by ``order``."""
    pairs = F.sort_array(F.collect_list(F.struct(order, item)))
    return F.transform(pairs, lambda p: p[item])


def merge_levels(chunks: DataFrame, item: str, merge: Merge, size: int, limit: int) -> DataFrame:
    """(key, pos, item) down to one item per key, ``limit`` neighbours at a time.

    ``size`` is the most items any key is known to have. No group holds more than
    ``limit``, unless a key has got more since; the last level takes all that is left.
    """
    while size > limit:
        chunks = (
            chunks.groupBy("key", int_div(F.col("pos"), limit).alias("chunk"))
            .agg(ordered("pos", item).alias("items"))
            .select("key", F.col("chunk").alias("pos"), fold(F.col("items"), merge).alias(item))
        )
        size = -(-size // limit)
    whole = chunks.groupBy("key").agg(ordered("pos", item).alias("items"))
    return whole.select("key", fold(F.col("items"), merge).alias(item))


def require_associative(stated: bool) -> None:
    """A hot key is folded in runs, so grouping must not matter; the caller has to say so,
    whatever the size of the keys today."""
    if not stated:
        raise ValueError("state associative=True: long keys are folded in runs, then the runs")


def reducing_state_ordered(
    records: DataFrame, merge: Merge, hot_rows: int = HOT_ROWS, *, associative: bool = False
) -> DataFrame:
    """(key, reduced) with any associative column function, applied in ``seq`` order.

    ``merge`` need not be commutative. Neighbouring runs of a hot key are folded
    first, then the results of neighbouring runs. Raises unless the caller states that
    ``merge`` is associative.
    """
    require_associative(associative)
    records = records.select("seq", "key", "value")
    hot = find_hot(records, hot_rows)
    ordinary, heavy = split(records, hot)
    out = ordinary.groupBy("key").agg(ordered("seq", "value").alias("items"))
    out = out.select("key", fold(F.col("items"), merge).alias("reduced"))
    if heavy is None:
        return out
    return out.unionByName(reduce_placed(positions(heavy, hot, "seq"), merge, hot))


def reduce_placed(placed: DataFrame, merge: Merge, hot: HotKeys) -> DataFrame:
    """Hot keys, from rows that have their position."""
    items = placed.select("key", "pos", "value")
    merged = merge_levels(items, "value", merge, hot.largest, hot.limit)
    return merged.withColumnRenamed("value", "reduced")
