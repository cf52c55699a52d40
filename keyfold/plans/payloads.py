"""State of any operator as text: one payload per operator, key and part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..functions.text import histogram_text, list_text, scalar_text, state_line
from ..operators.histogram import nest_histogram
from ..operators.listing import list_parts
from .hot import HOT_ROWS


@dataclass(frozen=True)
class Outputs:
    """The two outputs of a keyed stage: its input unchanged, and its state."""

    records: DataFrame
    state: DataFrame


def as_text(states: DataFrame) -> DataFrame:
    """The wide table of ``keyed_state`` with its list and map as text."""
    return states.withColumns(
        {names.LIST: list_text(F.col(names.LIST)), names.MAP: histogram_text(F.col(names.MAP))}
    )


def state_payloads(states: DataFrame) -> DataFrame:
    """(operator, key, part, payload) from the wide table, read once."""
    tagged = F.array(
        *(
            F.struct(F.lit(o).alias("operator"), scalar_text(F.col(o)).alias("payload"))
            for o in names.OPERATORS
        )
    )
    return (
        as_text(states)
        .select("key", "part", F.explode(tagged).alias("r"))
        .filter(F.col("r.payload").isNotNull())
        .select("r.operator", "key", "part", "r.payload")
    )


def table_payloads(tables: dict[str, DataFrame], per_row: int = HOT_ROWS) -> DataFrame:
    """(operator, key, part, payload) from state tables, as the ``results`` of a job.

    Scalars are (key, one column), the list (key, seq, value), the map (key, value, n).
    """
    stacked = None
    for operator, table in tables.items():
        if operator == names.LIST:
            parts = list_parts(table, per_row)
            rows = parts.select("key", "part", list_text(F.col("items")).alias("payload"))
        elif operator == names.MAP:
            parts = nest_histogram(table, per_row)
            rows = parts.select("key", "part", histogram_text(F.col("entries")).alias("payload"))
        else:
            (column,) = (c for c in table.columns if c != "key")
            first = F.lit(0).cast("bigint").alias("part")
            rows = table.select("key", first, scalar_text(F.col(column)).alias("payload"))
        rows = rows.select(F.lit(operator).alias("operator"), "key", "part", "payload")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


def result_lines(payloads: DataFrame) -> DataFrame:
    """(operator, key, part, line)."""
    line = state_line(F.col("key"), F.col("payload"), F.col("part")).alias("line")
    return payloads.select("operator", "key", "part", line)
