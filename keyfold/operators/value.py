"""Value state: one number per key, set by the first record and added to by the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.hot import HOT_ROWS, by_range, carry_forward, find_hot, split


def value_state(records: DataFrame) -> DataFrame:
    """(key, total) after all records. Combined before the shuffle."""
    return records.groupBy("key").agg(F.sum("value").alias("total"))


def running_value(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(seq, key, running): the value held after each record.

    A hot key is summed per range first; each range then starts from what the
    earlier ranges add up to.
    """
    records = records.select("seq", "key", "value")
    hot = find_hot(records, hot_rows)
    ordinary, heavy = split(records, hot)
    upto = Window.partitionBy("key").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = ordinary.select("seq", "key", F.sum("value").over(upto).alias("running"))
    if heavy is None:
        return out
    segments = carry_forward(by_range(heavy, hot, "seq"), hot, F.sum("value"))
    within = Window.partitionBy("key", "segment").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = F.col("carried") + F.sum("value").over(within)
    return out.unionByName(segments.select("seq", "key", running.alias("running")))
