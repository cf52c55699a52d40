"""Choice of state store and parallelism for a query that starts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_PROVIDERS = "org.apache.spark.sql.execution.streaming.state"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"

# Backend names and the Spark settings that stand for them.
BACKENDS: dict[str, dict[str, str]] = {
    "hashmap": {_PROVIDER: f"{_PROVIDERS}.HDFSBackedStateStoreProvider"},
    "rocksdb": {
        _PROVIDER: f"{_PROVIDERS}.RocksDBStateStoreProvider",
        _CHANGELOG: "false",
    },
    "rocksdb_incre": {
        _PROVIDER: f"{_PROVIDERS}.RocksDBStateStoreProvider",
        _CHANGELOG: "true",
    },
}


def backend_settings(backend: str) -> dict[str, str]:
    if backend not in BACKENDS:
        raise ValueError(f"unknown state backend {backend!r}; one of {sorted(BACKENDS)}")
    return BACKENDS[backend]


@contextmanager
def state_settings(
    spark: SparkSession, backend: str, partitions: int | None = None
) -> Iterator[None]:
    """Session settings for queries started inside the block, put back after it.

    A query takes its settings over when it first starts, and its checkpoint keeps
    them: to change them later, take a savepoint and restore it into a new job.
    """
    wanted = dict(backend_settings(backend))
    if partitions is not None:
        wanted[_PARTITIONS] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
