"""The ``events`` table seen as keyed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sequence import indexed_records


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real keys: one record per event, keyed by user, measuring the JSON integer."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("key"),
        F.get_json_object("props", "$.k").cast("bigint").alias("value"),
    )


def events_as_sequence(spark: SparkSession, sf_dir: str, keys: int) -> DataFrame:
    """The numbered sequence, ``event_id`` being its index (0 to n-1, no gaps)."""
    return indexed_records(table(spark, sf_dir, "events"), F.col("event_id"), keys)
