"""The whole trial: stop a job with a savepoint, go on with another, check the result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.records import unwrap
from ..plans.checks import check_report
from ..plans.payloads import table_payloads
from ..sources.sequence import sequence_stream
from ..workdir import fresh_dir
from .builtin import BuiltinJob
from .processor import ProcessorJob


@dataclass(frozen=True)
class Setup:
    """How one of the two jobs runs."""

    backend: str = "hashmap"
    partitions: int = 10
    job: type[BuiltinJob] | type[ProcessorJob] = BuiltinJob


def savepoint_trial(
    spark: SparkSession,
    before: Setup = Setup(),
    after: Setup = Setup(),
    total: int = 30_000,
    keys: int = 1_000,
    stop_at: int = 12_000,
    wrapped: bool = True,
) -> DataFrame:
    """The check report of all five states of the numbered sequence.

    The first job takes ``stop_at`` records and is stopped with a savepoint. The
    second restores it with its own backend and partition count and takes the rest.
    ``wrapped`` sends key and value through the source as one-field structs.
    """
    first_part = unwrap(sequence_stream(spark, total, keys, stop_at, wrapped=wrapped))
    first = before.job(
        spark, first_part, fresh_dir(spark, "job"), before.backend, before.partitions
    ).run()
    saved = first.savepoint(fresh_dir(spark, "savepoint"))

    start = saved.position.next_index
    rest = max(1, total - start)
    second_part = unwrap(sequence_stream(spark, total, keys, rest, start, wrapped))
    second = after.job(
        spark, second_part, fresh_dir(spark, "job"), after.backend, after.partitions, saved
    ).run()
    return check_report(table_payloads(second.results()), total, keys)
