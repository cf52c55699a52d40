"""List state: all values of a key in arrival order.

The long form, one row per element, is the main result and needs no shuffle. The
nested form puts at most ``per_row`` elements in one row. A longer list goes on in
rows with part 1, 2 …, so no row grows without bound and none is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import int_div
from ..plans.hot import HOT_ROWS, HotKeys, find_hot, positions, split
from .reducing import ordered


def list_rows(records: DataFrame) -> DataFrame:
    """(key, seq, value): one row per list element."""
    return records.select("key", "seq", "value")


def list_parts(records: DataFrame, per_row: int = HOT_ROWS) -> DataFrame:
    """(key, part, items): elements part * per_row to (part + 1) * per_row - 1."""
    records = list_rows(records)
    hot = find_hot(records, per_row)
    ordinary, heavy = split(records, hot)
    out = ordinary.groupBy("key").agg(ordered("seq", "value").alias("items"))
    out = out.select("key", F.lit(0).cast("bigint").alias("part"), "items")
    if heavy is None:
        return out
    return out.unionByName(parts_placed(positions(heavy, hot, "seq"), hot))


def parts_placed(placed: DataFrame, hot: HotKeys) -> DataFrame:
    """Lists of hot keys, from rows that have their position."""
    return placed.groupBy("key", int_div(F.col("pos"), hot.limit).alias("part")).agg(
        ordered("pos", "value").alias("items")
    )
