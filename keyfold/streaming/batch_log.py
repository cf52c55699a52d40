"""What each micro-batch of a stream brought: for pacing, and as the manifest of written batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException


def log_batches(spark: SparkSession, stream: DataFrame, home: str) -> DataFrame:
    """Take in all available input; (batch_id, records, first, last) per micro-batch.

    A batch that is run again after a failure replaces what it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.count(F.lit(1)).alias("records"),
            F.min("seq").alias("first"),
            F.max("seq").alias("last"),
        ).write.mode("overwrite").parquet(f"{home}/log/at={batch_id}")

    query = (
        stream.select("seq")
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{home}/log-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{home}/log").drop("at")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The rows of a micro-batch as a folder of their own, then its line in the manifest.

    A batch that is run again replaces its folder, so it adds no row. Without its line a
    folder does not count: it may be half written.
    """
    seen = Observation()
    held = rows.observe(seen, F.count(F.lit(1)).alias("records"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    held.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    line = tuple(seen.get.get(c) for c in ("records", "first", "last"))
    session = rows.sparkSession
    session.createDataFrame([line], _LINE).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


_LINE = "records bigint, first bigint, last bigint"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(records, first, last, batch) of every written batch, or None before the first."""
    try:
        return spark.read.schema(f"{_LINE}, batch bigint").parquet(f"{path}/manifest")
    except AnalysisException:  # no batch is written yet
        return None


def written_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of every batch in the manifest, with ``batch``."""
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/rows")
    return rows.join(manifest(spark, path).select("batch"), "batch", "left_semi")
