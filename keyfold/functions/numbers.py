from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(a: Column, b: Column | int) -> Column:
    """Truncating integer division, BIGINT."""
    divisor = b if isinstance(b, Column) else F.lit(b).cast("bigint")
    return F.call_function("div", a, divisor)
