"""State as text lines, and text lines as typed rows.

Fixed formats: ``key total``, ``key v0 v1 …`` and ``key v0,n0 v1,n1 …``. A null in a list or
map, and the null key, read ``null``. A list or map that goes on in further parts has lines
``key:1 …``, ``key:2 …`` for them, so the lines of one key can be put in order wherever they
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


NULL = "null"


def scalar_text(value: Column) -> Column:
    return value.cast("string")


def list_text(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda v: v.cast("string")), " ", NULL)


def histogram_text(entries: Column) -> Column:
    """``entries`` is an array of (value, n) structs in the order to print."""
    return F.array_join(
        F.transform(
            entries, lambda e: F.concat_ws(",", F.coalesce(e["value"].cast("string"), F.lit(NULL)), e["n"])
        ),
        " ",
    )


def state_line(key: Column, payload: Column, part: Column | None = None) -> Column:
    """``key payload``, or ``key:part payload`` for a part beyond the first."""
    head = F.coalesce(key.cast("string"), F.lit(NULL))
    if part is not None:
        head = F.when(part > 0, F.concat_ws(":", head, part.cast("string"))).otherwise(head)
    return F.concat_ws(" ", head, payload)


def _parts(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.split("value", " +", 2).alias("parts"))


def parse_total_lines(lines: DataFrame) -> DataFrame:
    """``key total`` lines to (key, total, line); an unreadable number gives null."""
    return _parts(lines).select(
        F.col("parts")[0].try_cast("bigint").alias("key"),
        F.get("parts", F.lit(1)).try_cast("bigint").alias("total"),
        F.col("value").alias("line"),
    )


def parse_payload_lines(lines: DataFrame) -> DataFrame:
    """``key rest`` lines to (key, part, payload, line), the rest kept as text.

    A key or part that is no number is null.
    """
    head = F.split(F.col("parts")[0], ":", 2)
    first = F.lit(0).cast("bigint")
    part = F.when(F.size(head) == 1, first).otherwise(F.get(head, F.lit(1)).try_cast("bigint"))
    return _parts(lines).select(
        F.get(head, F.lit(0)).try_cast("bigint").alias("key"),
        part.alias("part"),
        F.get("parts", F.lit(1)).alias("payload"),
        F.col("value").alias("line"),
    )


def _items(lines: DataFrame, per_row: int) -> DataFrame:
    """(key, pos, item): what stands in each payload; an empty payload has nothing."""
    parsed = parse_payload_lines(lines)
    split = F.filter(F.split("payload", " +"), lambda item: item != "")
    placed = parsed.select("key", "part", F.posexplode(split).alias("at", "item"))
    return placed.select("key", (F.col("part") * per_row + F.col("at")).alias("pos"), "item")


def parse_list_rows(lines: DataFrame, per_row: int) -> DataFrame:
    """List lines in parts of ``per_row`` to (key, pos, value), one row an element.

    ``pos`` counts through all parts of a key. Nothing is shuffled.
    """
    rows = _items(lines, per_row)
    return rows.select("key", "pos", F.col("item").try_cast("bigint").alias("value"))


def parse_histogram_rows(lines: DataFrame, per_row: int) -> DataFrame:
    """Map lines in parts of ``per_row`` to (key, pos, value, n), one row an entry."""
    pair = F.split("item", ",", 2)
    return _items(lines, per_row).select(
        "key",
        "pos",
        pair[0].try_cast("bigint").alias("value"),
        F.get(pair, F.lit(1)).try_cast("bigint").alias("n"),
    )
