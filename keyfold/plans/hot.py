"""Hot keys: finding them, and giving their rows positions without one big task.

A key is hot when it has more rows than one task should hold. Other keys take the
plain one-group plan. Rows of hot keys are cut by range over (key, order), so one
key spreads over many tasks, and only per-range totals meet per key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..workdir import materialize

# Rows of one key that may meet in one row or one group. A list of that many numbers takes
# some 10 MB while it is collected, and one task holds a hundred or so at a time.
HOT_ROWS = 100_000
# Ranges that rows of hot keys are cut into: one per RANGE_ROWS rows, within bounds
# that keep even a small case split and the number of tasks schedulable.
RANGE_ROWS = 1_000_000
MIN_RANGES, MAX_RANGES = 4, 20_000


@dataclass(frozen=True)
class HotKeys:
    table: DataFrame  # hot_key, hot_rows
    keys: int
    rows: int
    largest: int
    limit: int

    @property
    def ranges(self) -> int:
        return min(MAX_RANGES, max(MIN_RANGES, -(-self.rows // RANGE_ROWS)))


def find_hot(records: DataFrame, limit: int = HOT_ROWS) -> HotKeys | None:
    """Keys with more than ``limit`` rows, or None.

    Runs one job when called: counts are combined before the shuffle, and only the key
    column is read. The hot keys, few as they are, are written to the shared folder, so
    that every later step sees the same ones, and a call on a table that has grown counts
    anew.
    """
    counts = records.groupBy(F.col("key").alias("hot_key")).agg(
        F.count(F.lit(1)).alias("hot_rows")
    )
    hot = materialize(counts.filter(F.col("hot_rows") > limit), "hot-keys")
    keys, rows, largest = hot.agg(
        F.count(F.lit(1)), F.sum("hot_rows"), F.max("hot_rows")
    ).first()
    if not keys:
        return None
    return HotKeys(hot, keys, rows, largest, limit)


def split(records: DataFrame, hot: HotKeys | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of hot keys; every row is in exactly one.

    Spark broadcasts the hot keys if their table's bytes are few enough.
    """
    if hot is None:
        return records, None
    tags = hot.table.select("hot_key")
    on = records["key"].eqNullSafe(tags["hot_key"])
    return records.join(tags, on, "left_anti"), records.join(tags, on, "left_semi")


def by_range(rows: DataFrame, hot: HotKeys, order: str) -> DataFrame:
    """Hot rows with ``segment``: the range of (key, order) they fall in.

    Segments of a key ascend with ``order``. Written once, so that a row keeps its
    segment for every reader and on every retry.
    """
    cut = rows.repartitionByRange(hot.ranges, "key", order).withColumn(
        "segment", F.spark_partition_id()
    )
    return materialize(cut, "hot-rows")


def carry_forward(segments: DataFrame, hot: HotKeys, total: Column) -> DataFrame:
    """``segments`` plus ``carried``: ``total`` over all earlier segments of the key.

    There are at most keys + ranges totals, since segments are contiguous.
    """
    before = Window.partitionBy("key").orderBy("segment").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        segments.groupBy("key", "segment")
        .agg(total.alias("subtotal"))
        .select(
            F.col("key").alias("carry_key"),
            F.col("segment").alias("carry_segment"),
            F.coalesce(F.sum("subtotal").over(before), F.lit(0)).alias("carried"),
        )
    )
    return segments.join(
        carried,
        segments["key"].eqNullSafe(carried["carry_key"])
        & (segments["segment"] == carried["carry_segment"]),
    ).drop("carry_key", "carry_segment")


def positions(rows: DataFrame, hot: HotKeys, order: str) -> DataFrame:
    """Hot rows with ``pos``: 0, 1, 2 … per key, ascending by ``order``."""
    segments = carry_forward(by_range(rows, hot, order), hot, F.count(F.lit(1)))
    within = Window.partitionBy("key", "segment").orderBy(order)
    pos = F.col("carried") + F.row_number().over(within) - 1
    return segments.withColumn("pos", pos).drop("segment", "carried")
