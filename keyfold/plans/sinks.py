"""Result lines in text files, written and read in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_lines(lines: DataFrame, path: str) -> None:
    """Replace ``path`` with one text line per row of the ``line`` column."""
    lines.select("line").write.mode("overwrite").text(path)


def write_result_lines(lines: DataFrame, path: str) -> None:
    """One folder per operator, from (operator, line)."""
    (
        lines.select(F.col("operator"), F.col("line").alias("value"))
        .write.mode("overwrite")
        .partitionBy("operator")
        .text(path)
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
