"""The shared folder in which jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the cluster; on a local master one is made if none is set.

    A machine-local folder would be lost with its executor, so on any other
    master a missing setting is an error.
    """
    base = spark.conf.get(_SETTING, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="keyfold-")
    spark.conf.set(_SETTING, base)
    return base


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, folders: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two branches need the same rows, or where rows must not move when
    a lost task is run again. ``folders`` are columns a reader picks rows by.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
