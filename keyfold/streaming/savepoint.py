"""A savepoint: the state of a stopped job as Parquet tables anyone can read.

``<path>/state/<operator>``   one table per operator, named by its identity
``<path>/meta``               one row, written last; without it there is no savepoint

The rows of the list are written once: the savepoint of a restored job holds those that came
after the one it goes on from, and ``lists`` names the folders before it, which must be kept. A
savepoint written with ``whole`` holds all of them.

Columns: value_state (key, total), reducing_state (key, reduced), aggregating_state
(key, acc: a struct), list_state (key, seq, value), map_state (key, value, n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .. import names

FORMAT_VERSION = 2
_READABLE = (1, 2)  # 1: without ``lists``, whole
_META = (
    "format_version int, next_index bigint, records bigint, batch_id bigint, "
    "operators array<string>, key_type string, lists array<string>"
)


class SavepointError(RuntimeError):
    """A savepoint cannot be taken or cannot be restored as asked."""


@dataclass(frozen=True)
class Position:
    """How far the input is consumed: ``records`` of them, all below ``next_index``."""

    records: int
    next_index: int
    batch_id: int = -1


@dataclass(frozen=True)
class Savepoint:
    path: str
    position: Position
    tables: dict[str, DataFrame]
    key_type: str
    lists: tuple[str, ...] = ()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Savepoint:
        try:
            meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
        except AnalysisException as error:
            raise SavepointError(f"no complete savepoint in {path}") from error
        if meta is None:
            raise SavepointError(f"no complete savepoint in {path}")
        if meta["format_version"] not in _READABLE:
            raise SavepointError(f"savepoint format {meta['format_version']} is not known")
        lists = tuple(meta["lists"] or ()) if names.LIST in meta["operators"] else ()
        own = lambda o: [f"{path}/state/{o}"]
        folders = {o: [*lists, *own(o)] if o == names.LIST else own(o) for o in meta["operators"]}
        try:
            tables = {o: spark.read.parquet(*paths) for o, paths in folders.items()}
        except AnalysisException as error:
            raise SavepointError(f"{path} goes on from {lists}, and not all of them are there") from error
        position = Position(meta["records"], meta["next_index"], meta["batch_id"])
        return cls(path, position, tables, meta["key_type"], lists)

    @property
    def list_folders(self) -> tuple[str, ...]:
        """All folders with rows of the list, for a savepoint that goes on from this one."""
        return (*self.lists, f"{self.path}/state/{names.LIST}") if names.LIST in self.tables else ()

    @classmethod
    def write(
        cls,
        spark: SparkSession,
        path: str,
        tables: dict[str, DataFrame],
        position: Position,
        lists: tuple[str, ...] = (),
    ) -> Savepoint:
        """``lists``: folders that hold the rows of the list before those of ``tables``."""
        for operator, table in tables.items():
            table.write.parquet(f"{path}/state/{operator}")
        key_type = key_type_of(next(iter(tables.values())).schema)
        row = (
            FORMAT_VERSION,
            position.next_index,
            position.records,
            position.batch_id,
            sorted(tables),
            key_type,
            list(lists),
        )
        spark.createDataFrame([row], _META).coalesce(1).write.parquet(f"{path}/meta")
        return cls.open(spark, path)

    def select(
        self, operators: tuple[str, ...], schema: StructType, drop_others: bool = False
    ) -> dict[str, DataFrame]:
        """Tables for ``operators``, matched by identity.

        Raises on an operator the savepoint lacks, on state no operator takes
        (unless ``drop_others``) and on another key type.
        """
        absent = sorted(set(operators) - set(self.tables))
        if absent:
            raise SavepointError(f"the savepoint has no state for {absent}")
        left = sorted(set(self.tables) - set(operators))
        if left and not drop_others:
            raise SavepointError(f"no operator takes the state of {left}")
        if key_type_of(schema) != self.key_type:
            raise SavepointError(f"keys are {key_type_of(schema)}, savepoint has {self.key_type}")
        return {o: self.tables[o] for o in operators}


def key_type_of(schema: StructType) -> str:
    return schema["key"].dataType.simpleString()


@dataclass(frozen=True)
class Consumed:
    """What a job has taken in since it started, as committed with ``batch_id``.

    ``late`` records came below the position the job goes on from, and were left out.
    """

    records: int
    first: int
    last: int
    batch_id: int
    late: int = 0


def check_late(base: Savepoint | None, consumed: Consumed | None) -> None:
    """Raises if records were left out that the savepoint does not hold.

    A restored job may read its source from the start, and then leaves out just what the
    savepoint holds, or from the position on, and then leaves out nothing.
    """
    if base is None or consumed is None:
        return
    if consumed.late not in (0, base.position.records):
        raise SavepointError(
            f"{consumed.late} records came below seq {base.position.next_index}, where this job "
            f"goes on; its savepoint holds {base.position.records}: some are late, and in no state"
        )


def next_position(
    base: Savepoint | None, consumed: Consumed | None, source: DataFrame | None, first: int = 0
) -> Position:
    """Where a job restored from the new savepoint must go on.

    Raises unless the consumed records are exactly those from the start of the job
    to ``last``: a record that arrives late and below the position would be lost.
    With ``source``, the input as a static table, they are counted. Without, ``seq``
    must have no gaps, and begins with ``first``.
    """
    check_late(base, consumed)
    if consumed is None:
        if base is None:
            raise SavepointError("nothing is committed yet")
        return base.position
    if source is not None:
        below = source.filter(F.col("seq") <= consumed.last)
        if base is not None:
            below = below.filter(F.col("seq") >= base.position.next_index)
        expected = below.count()
    else:
        start = first if base is None else base.position.next_index
        expected = consumed.last - start + 1
    if consumed.records != expected:
        raise SavepointError(
            f"{consumed.records} records consumed up to seq {consumed.last}, {expected} "
            "expected: the input was not taken in seq order, run on and try again"
        )
    earlier = base.position.records if base else 0
    return Position(earlier + consumed.records, consumed.last + 1, consumed.batch_id)
