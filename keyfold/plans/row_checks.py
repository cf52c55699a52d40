"""Checks of results in long form, one row an element, by fingerprints.

A key's rows are a multiset. Its fingerprint is the number of rows and the sums of two
64-bit hashes over them, so the order of rows does not matter and a row that comes twice
counts twice. Fingerprints are combined before the one shuffle, which moves one row a key
and task, however long a list is. Only rows of keys whose fingerprints differ are compared
one by one. Two different multisets look equal with a chance of some 2**-128.

Null is a value like any other, in keys too. Columns must be of types Spark can group by.
Sums hold for any number of different rows; above four billion copies of one row under one
key they may overflow, which is an error in Spark's ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions.closed_form import expected_sum
from ..sources.sequence import sequence
from ..workdir import materialize
from .checks import expected_counts

_SEEDS = (1, 2)


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _packed(left: DataFrame, right: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """(k, row, sign): rows of both sides as structs, 1 for ``left`` and -1 for ``right``."""
    columns = left.columns
    sign = "sign"
    while sign in columns:
        sign += "_"
    picked = [_column(c) for c in columns]
    both = left.select(*picked, F.lit(1).alias(sign)).unionByName(
        right.select(*picked, F.lit(-1).alias(sign))
    )
    return both.select(
        F.struct(*(_column(c) for c in on)).alias("k"),
        F.struct(*picked).alias("row"),
        _column(sign).alias("sign"),
    )


def _hash_sums(packed: DataFrame) -> list[Column]:
    """Sums over the two halves of each hash, centred on 0.

    Spark's hash passes over nulls, so each field is hashed with a mark of its nullness.
    """
    fields = [F.col("row").getField(f.name) for f in packed.schema["row"].dataType.fields]
    marked = [part for f in fields for part in (f, f.isNull())]
    halves = []
    for seed in _SEEDS:
        hashed = F.xxhash64(F.lit(seed), *marked)
        halves.append(F.shiftright(hashed, 32))
        halves.append(hashed.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31))
    return [F.sum(F.col("sign") * half) for half in halves]


def _totals(packed: DataFrame) -> DataFrame:
    """(k, found, wanted, same), one row a key, written once."""
    sums = [s.alias(f"s{i}") for i, s in enumerate(_hash_sums(packed))]
    counted = packed.groupBy("k").agg(
        F.count_if(F.col("sign") > 0).alias("found"),
        F.count_if(F.col("sign") < 0).alias("wanted"),
        *sums,
    )
    same = F.col("found") == F.col("wanted")
    for i in range(len(sums)):
        same &= F.col(f"s{i}") == 0
    return materialize(counted.select("k", "found", "wanted", same.alias("same")), "fingerprints")


def _only(packed: DataFrame, keys: DataFrame) -> DataFrame:
    return packed.join(keys, packed["k"].eqNullSafe(keys["k"]), "left_semi")


def compare_rows(
    found: DataFrame, expected: DataFrame, on: tuple[str, ...] = ("key",)
) -> DataFrame:
    """(*on, rows, wanted, lacking, surplus, status) for every key of either side.

    ``rows`` and ``wanted`` are numbers of rows found and expected, ``lacking`` those
    expected and not found, ``surplus`` those found beyond what is expected. Status is
    ``missing`` (no rows found), ``extra`` (none expected), ``duplicate`` (nothing lacks
    and each surplus row is a copy of an expected one), ``wrong`` or ``ok``. Runs one job
    when called. Empty sides are allowed.
    """
    packed = _packed(found, expected, on)
    totals = _totals(packed)
    suspects = totals.filter(~F.col("same")).select("k")
    if suspects.isEmpty():
        none = F.lit(0).cast("bigint")
        full = totals.withColumns({"lacking": none, "surplus": none, "copies": none})
    else:
        each = _only(packed, suspects).groupBy("k", "row").agg(
            F.sum("sign").alias("over"), F.count_if(F.col("sign") < 0).alias("asked")
        )
        detail = each.groupBy(F.col("k").alias("faulty")).agg(
            F.sum(F.greatest(-F.col("over"), F.lit(0))).alias("lacking"),
            F.sum(F.greatest(F.col("over"), F.lit(0))).alias("surplus"),
            F.sum(F.when(F.col("asked") > 0, F.greatest(F.col("over"), F.lit(0))).otherwise(0)).alias("copies"),
        )
        full = totals.join(detail, totals["k"].eqNullSafe(detail["faulty"]), "left").fillna(
            0, ["lacking", "surplus", "copies"]
        )
    status = (
        F.when(F.col("found") == 0, "missing")
        .when(F.col("wanted") == 0, "extra")
        .when(F.col("same"), "ok")
        .when((F.col("lacking") == 0) & (F.col("surplus") == F.col("copies")), "duplicate")
        .otherwise("wrong")
    )
    return full.select(
        *(F.col("k").getField(c).alias(c) for c in on),
        F.col("found").alias("rows"),
        "wanted",
        "lacking",
        "surplus",
        status.alias("status"),
    )


def differing_rows(
    left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("key",)
) -> DataFrame:
    """The rows of ``checks.difference``, moving only those of keys that differ.

    Runs one job when called.
    """
    packed = _packed(left, right, on)
    suspects = _totals(packed).filter(~F.col("same")).select("k")
    each = _only(packed, suspects).groupBy("row").agg(F.sum("sign").alias("over"))
    return each.filter(F.col("over") != 0).select("row.*", F.col("over").alias("surplus"))


def check_list_rows(rows: DataFrame, total: int, keys: int) -> DataFrame:
    """List state (key, seq, value) of the sequence: each element at its place."""
    expected = sequence(rows.sparkSession, total, keys).select("key", "seq", "value")
    return compare_rows(rows.select("key", "seq", "value"), expected)


def check_map_rows(rows: DataFrame, total: int, keys: int) -> DataFrame:
    """Map state (key, value, n) of the sequence: each of 0 … m-1 once."""
    return compare_rows(rows.select("key", "value", "n"), _expected_map(rows, total, keys))


def _expected_map(like: DataFrame, total: int, keys: int) -> DataFrame:
    made = sequence(like.sparkSession, total, keys)
    return made.select("key", "value", F.lit(1).cast("bigint").alias("n"))


def check_report_rows(tables: dict[str, DataFrame], total: int, keys: int) -> DataFrame:
    """(operator, key, rows, wanted, lacking, surplus, status) of all operators given.

    ``tables`` are state tables, as the ``results`` of a job: scalars (key, one column),
    the list (key, seq, value), the map (key, value, n). All are compared in one shuffle.
    """

    def long(operator: str, table: DataFrame) -> DataFrame:
        first, *second = (c for c in table.columns if c != "key")
        y = F.col(second[0]) if second else F.lit(None)
        return table.select(
            F.lit(operator).alias("operator"),
            "key",
            F.col(first).cast("bigint").alias("x"),
            y.cast("bigint").alias("y"),
        )

    found = expected = None
    for operator, table in tables.items():
        if operator == names.LIST:
            table = table.select("key", "seq", "value")
            right = sequence(table.sparkSession, total, keys).select("key", "seq", "value")
        elif operator == names.MAP:
            table = table.select("key", "value", "n")
            right = _expected_map(table, total, keys)
        else:
            counts = expected_counts(table.sparkSession, total, keys)
            right = counts.select("key", expected_sum(F.col("m")).alias("total"))
        table, right = long(operator, table), long(operator, right)
        found = table if found is None else found.unionByName(table)
        expected = right if expected is None else expected.unionByName(right)
    if found is None:
        raise ValueError("there are no tables to check")
    return compare_rows(found, expected, ("operator", "key"))
