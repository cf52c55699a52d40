"""Keyed route: all records of a key go to one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numbers import int_div
from ..plans.hot import HOT_ROWS, find_hot


def route(
    records: DataFrame, partitions: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Records plus ``lane``, hash-partitioned so that (key, lane) is in one partition.

    Ordinary keys have the one lane 0. A hot key gets a lane per ``hot_rows`` rows,
    so that no partition has to take all of it.
    """
    hot = find_hot(records, hot_rows)
    if hot is None:
        placed = records.withColumn("lane", F.lit(0).cast("bigint"))
    else:
        tags = hot.table
        lanes = int_div(F.col("hot_rows") + hot_rows - 1, hot_rows)
        lane = F.coalesce(F.pmod(F.xxhash64("seq"), lanes), F.lit(0))
        placed = (
            records.join(tags, records["key"].eqNullSafe(tags["hot_key"]), "left")
            .withColumn("lane", lane.cast("bigint"))
            .drop("hot_key", "hot_rows")
        )
    by = ("key",) if hot is None else ("key", "lane")
    return placed.repartition(partitions, *by) if partitions else placed.repartition(*by)
