"""Checks of a result, as DataFrames that list every fault.

Status is one of ``ok``, ``wrong``, ``missing``, ``extra``, ``duplicate``. All but
``ok`` are faults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import names
from ..functions.closed_form import expected_count, expected_sum
from ..functions.numbers import int_div
from ..functions.text import histogram_text, list_text
from .hot import HOT_ROWS


class ResultError(RuntimeError):
    """A result does not match what it must be."""


def duplicates(result: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """Rows of ``on`` that come more than once, with how often."""
    return result.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def missing(result: DataFrame, expected: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """Rows of ``on`` that are expected and absent."""
    return expected.select(*on).join(result.select(*on), list(on), "left_anti")


def expected_counts(spark: SparkSession, total: int, keys: int) -> DataFrame:
    """(key, m): the number of records of each key of the sequence."""
    return spark.range(keys).select(
        F.col("id").alias("key"), expected_count(F.col("id"), total, keys).alias("m")
    )


def expected_totals(spark: SparkSession, total: int, keys: int) -> DataFrame:
    counts = expected_counts(spark, total, keys)
    return counts.select("key", expected_sum(F.col("m")).alias("expected"))


def expected_parts(
    spark: SparkSession, total: int, keys: int, per_row: int = HOT_ROWS
) -> DataFrame:
    """(key, part, m): the parts in which the m values of each key are held.

    A key with no records has no row: it has no state either. Rows are spread by
    (key, part), as one key may have many.
    """
    counts = expected_counts(spark, total, keys).filter(F.col("m") > 0)
    last_part = int_div(F.col("m") - 1, per_row)
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), last_part)).alias("part")
    return counts.select("key", parts, "m").repartition("key", "part")


def expected_items(m: Column, part: Column, per_row: int = HOT_ROWS) -> Column:
    """The list elements of one part: 0 … m-1, cut every ``per_row``."""
    start = part * per_row
    return F.when(m > start, F.sequence(start, F.least(start + per_row, m) - 1))


def expected_entries(items: Column) -> Column:
    """Map entries of the sequence: each value once."""
    return F.transform(
        items, lambda v: F.struct(v.alias("value"), F.lit(1).cast("bigint").alias("n"))
    )


def compare(
    result: DataFrame,
    expected: DataFrame,
    on: tuple[str, ...] = ("key",),
    expand: Callable[[Column], Column] = lambda expected: expected,
) -> DataFrame:
    """(*on, found, expected, status) for every row of either side.

    ``result`` has the columns ``on`` and ``found``, ``expected`` those and
    ``expected``. One grouping over both sides: a key of the result is looked at
    once, however often it comes, and nothing is joined. ``expand`` makes what must
    be found from a short form of it, after the shuffle.
    """
    both = result.select(*on, "found", F.lit(True).alias("is_result")).unionByName(
        expected.select(*on, "expected", F.lit(False).alias("is_result")),
        allowMissingColumns=True,
    )
    seen = both.groupBy(*on).agg(
        F.count_if("is_result").alias("results"),
        F.count_if(~F.col("is_result")).alias("wanted"),
        F.max("found").alias("found"),
        F.max("expected").alias("expected"),
    )
    status = (
        F.when(F.col("results") == 0, "missing")
        .when(F.col("wanted") == 0, "extra")
        .when(F.col("results") > 1, "duplicate")
        .when(F.col("found").eqNullSafe(F.col("expected")), "ok")
        .otherwise("wrong")
    )
    full = seen.withColumn("expected", expand(F.col("expected")))
    return full.select(*on, "found", "expected", status.alias("status"))


def faults(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("status") != "ok")


def check_totals(totals: DataFrame, total: int, keys: int, column: str = "total") -> DataFrame:
    """Value, reducing or aggregating state of the sequence against its closed form."""
    found = totals.select("key", F.col(column).alias("found"))
    return compare(found, expected_totals(totals.sparkSession, total, keys))


def _compare_parts(
    found: DataFrame, total: int, keys: int, per_row: int, make: Callable[[Column], Column]
) -> DataFrame:
    parts = expected_parts(found.sparkSession, total, keys, per_row)
    return compare(
        found,
        parts.withColumnRenamed("m", "expected"),
        on=("key", "part"),
        expand=lambda m: make(expected_items(m, F.col("part"), per_row)),
    )


def check_list(parts: DataFrame, total: int, keys: int, per_row: int = HOT_ROWS) -> DataFrame:
    """List state (key, part, items), order included."""
    found = parts.select("key", "part", F.col("items").alias("found"))
    return _compare_parts(found, total, keys, per_row, lambda items: items)


def check_histogram(
    parts: DataFrame, total: int, keys: int, per_row: int = HOT_ROWS
) -> DataFrame:
    """Map state (key, part, entries): each of 0 … m-1 once."""
    found = parts.select("key", "part", F.col("entries").alias("found"))
    return _compare_parts(found, total, keys, per_row, expected_entries)


def check_report(
    payloads: DataFrame,
    total: int,
    keys: int,
    operators: tuple[str, ...] = names.OPERATORS,
    per_row: int = HOT_ROWS,
) -> DataFrame:
    """(operator, key, part, found, expected, status) of all operators, as text.

    ``payloads`` is (operator, key, part, payload). All are compared in one grouping.
    """
    spark = payloads.sparkSession
    scalars = [o for o in operators if o not in (names.LIST, names.MAP)]
    nested = [o for o in operators if o in (names.LIST, names.MAP)]

    def tagged(rows: DataFrame, wanted: list[str]) -> DataFrame:
        tags = F.array(*(F.lit(o) for o in wanted)).cast("array<string>")
        return rows.withColumn("operator", F.explode(tags))

    counts = expected_counts(spark, total, keys).withColumn("part", F.lit(0).cast("bigint"))
    parts = expected_parts(spark, total, keys, per_row)
    wanted = tagged(counts, scalars).unionByName(tagged(parts, nested))

    def expand(m: Column) -> Column:
        items = expected_items(m, F.col("part"), per_row)
        return (
            F.when(F.col("operator") == names.LIST, list_text(items))
            .when(F.col("operator") == names.MAP, histogram_text(expected_entries(items)))
            .otherwise(expected_sum(m).cast("string"))
        )

    return compare(
        payloads.withColumnRenamed("payload", "found"),
        wanted.withColumnRenamed("m", "expected"),
        on=("operator", "key", "part"),
        expand=expand,
    )


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number differs: the columns of ``left`` and ``surplus``.

    ``surplus`` is rows in ``left`` less rows in ``right``. Both sides are counted
    in one shuffle, combined before it. Columns must be of types Spark can group by.
    """
    columns = left.columns
    both = left.withColumn("side", F.lit(1)).unionByName(
        right.select(*columns).withColumn("side", F.lit(-1))
    )
    return (
        both.groupBy(*columns)
        .agg(F.sum("side").alias("surplus"))
        .filter(F.col("surplus") != 0)
    )


def raise_on_faults(report: DataFrame, show: int = 20) -> None:
    """Raise if the fault table has rows; the message names the first few."""
    rows = report.take(show)
    if rows:
        raise ResultError("\n".join(str(r) for r in rows))
