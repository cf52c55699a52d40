"""Reading the keyed state of a query from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def committed_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """Last committed micro-batch, or None before the first."""
    meta = spark.read.format("state-metadata").load(checkpoint)
    last = meta.agg(F.max("maxBatchId")).first()[0]
    # A query that has started and not yet committed reports -1.
    return None if last is None or last < 0 else last


def state_rows(
    spark: SparkSession, checkpoint: str, batch_id: int, variable: str | None = None
) -> DataFrame:
    """One row per key, list element or map entry of the state after ``batch_id``."""
    reader = spark.read.format("statestore").option("batchId", batch_id)
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)
