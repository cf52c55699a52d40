"""What the numbered sequence must give for each key, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import int_div


def expected_count(key: Column, total: int, keys: int) -> Column:
    """Records of one key: the even share, plus one of the remainder for low keys."""
    even, rest = divmod(total, keys)
    return F.lit(even).cast("bigint") + F.when(key < rest, 1).otherwise(0)


def expected_sum(count: Column) -> Column:
    """0 + 1 + … + (count - 1)."""
    return int_div(count * (count - 1), 2)
