"""A table landed slice after slice, for a file stream to read in ``seq`` order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Landed:
    """How slices were cut: ``seq`` units per slice and data files per slice."""

    width: int
    files_per_slice: int


def land_slices(
    records: DataFrame,
    path: str,
    slices: int,
    files_per_slice: int | None = None,
    only: range | None = None,
) -> Landed:
    """Append equal ``seq`` ranges of ``records`` to ``path``, lowest range first.

    One distributed write per slice, so that files of a later slice are newer and
    the file stream takes slices in order; the ``seq`` range of a slice is pushed
    to the scan. The number of files follows the number of scan partitions unless
    given. A stream that takes ``files_per_slice`` files per trigger reads one slice
    per micro-batch. ``only`` lands some slices now and leaves the rest for later.
    """
    low, high = records.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        raise ValueError("there are no records to land")
    width = max(1, -(-(high - low + 1) // slices))
    files = files_per_slice or max(1, -(-records.rdd.getNumPartitions() // slices))
    for i in only if only is not None else range(slices):
        start = low + i * width
        piece = records.filter((F.col("seq") >= start) & (F.col("seq") < start + width))
        piece = piece.coalesce(1) if files == 1 else piece.repartitionByRange(files, "seq")
        piece.write.mode("append").parquet(path)
    return Landed(width, files)


def open_slices(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1
) -> DataFrame:
    """Stream the landed files, at most ``files_per_trigger`` of them per batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )
