"""Plain records and records whose key and value are one-field structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def wrap(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.struct(F.col(c).alias("value")) for c in ("key", "value")}
    )


def unwrap(df: DataFrame) -> DataFrame:
    """Take key and value out of their structs; plain columns pass unchanged."""
    nested = [
        c for c in ("key", "value") if isinstance(df.schema[c].dataType, StructType)
    ]
    return df.withColumns({c: F.col(f"{c}.value") for c in nested}) if nested else df
