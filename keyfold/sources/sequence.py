"""The bounded numbered sequence: record i is (key i mod keys, value i div keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.numbers import int_div
from ..functions.records import wrap


def indexed_records(df: DataFrame, index: Column, keys: int) -> DataFrame:
    """Records of the sequence from a running index the table already has."""
    if keys < 1:
        raise ValueError("keys must be at least 1")
    seq = index.cast("bigint")
    return df.select(
        seq.alias("seq"),
        (seq % F.lit(keys).cast("bigint")).alias("key"),
        int_div(seq, keys).alias("value"),
    )


def sequence(
    spark: SparkSession, total: int, keys: int, start: int = 0, wrapped: bool = False
) -> DataFrame:
    """Records ``start`` to ``total - 1`` over ``keys`` keys, made in parallel."""
    made = indexed_records(spark.range(start, max(start, total)), F.col("id"), keys)
    return wrap(made) if wrapped else made


def sequence_stream(
    spark: SparkSession,
    total: int,
    keys: int,
    records_per_batch: int,
    start: int = 0,
    wrapped: bool = False,
) -> DataFrame:
    """Records ``start`` to ``total - 1`` as a stream, a fixed number per micro-batch.

    Spark's own rate source makes the index: its offset is in the checkpoint, so a
    restart goes on where it was, and a batch that runs again has the same records.
    The source never ends; past ``total`` its batches are empty. With the
    ``availableNow`` trigger each run of the query is one batch.
    """
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", records_per_batch)
        .load()
    )
    index = ticks.select((F.col("value") + F.lit(start)).alias("index"))
    made = indexed_records(index.filter(F.col("index") < total), F.col("index"), keys)
    return wrap(made) if wrapped else made
