"""The five states of a stream with Spark's own aggregates, on any state backend.

One stateful query holds totals per key, counts per (key, value) and the consumed
position as grouping sets of a single aggregate: one shuffle, combined before it,
and all three committed with the same micro-batch. The list state needs no state
store: its long form is the records, written as Parquet by a second query, a folder
for each micro-batch with a line in a manifest.

A job restored from a savepoint reads the savepoint's tables as a further source of
the same query: their rows are partial measures of the same aggregate and enter the
state store with the first micro-batch. The store, whatever its backend and number
of partitions, then holds whole states, and nothing is merged when it is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from .. import names
from ..operators.reducing import (
    COMBINERS,
    ORDERED,
    Merge,
    combiner,
    fold,
    numbered_value,
    ordered,
    reducing_state_ordered,
    require_associative,
)
from ..plans.payloads import Outputs, result_lines, table_payloads
from ..workdir import materialize
from .backends import backend_settings, state_settings
from .batch_log import manifest, write_batch, written_rows
from .savepoint import Consumed, Savepoint, SavepointError, check_late, next_position
from .state import committed_batch, state_rows

# grouping_id() of the three grouping sets over (late, key, value); late is in all of them.
_PER_VALUE, _PER_KEY, _OVERALL = 0, 1, 3


@dataclass(frozen=True)
class OrderedFold:
    """Any associative column function, applied to the values of a key in ``seq`` order.

    The rows since the savepoint are folded when the state is read; a savepoint keeps the
    fold of all records below its position, which come before all that are read later.
    So the order in which records or slices arrive makes no difference.
    """

    merge: Merge
    associative: bool = False


@dataclass(frozen=True)
class BuiltinAggregate:
    """An accumulator of several measures: field -> (combiner, what it takes of the value, type).

    ``finish`` turns the accumulator, a struct of the fields, into the result. Null values
    are for the measures to leave out, as ``sum``, ``min`` and ``max`` do.
    """

    fields: dict[str, tuple[str, Callable[[Column], Column], str]] = field(
        default_factory=lambda: {"acc": ("sum", lambda value: value, "bigint")}
    )
    finish: Callable[[Column], Column] = lambda acc: acc["acc"]


def mean_aggregate(finish: Callable[[Column], Column]) -> BuiltinAggregate:
    """Sum and number of the values that are not null: fields ``total`` and ``n``."""
    return BuiltinAggregate(
        {
            "total": ("sum", lambda value: value.cast("bigint"), "bigint"),
            "n": ("sum", lambda value: value.isNotNull().cast("bigint"), "bigint"),
        },
        finish,
    )


@dataclass(frozen=True)
class _Measure:
    """One buffer of the aggregate. ``owner`` is the operator whose savepoint table seeds it."""

    how: str
    of: Column
    kind: str
    owner: str | None
    seed: Callable[[], Column] | None = None

    def combined(self, name: str) -> Column:
        return {**COMBINERS, **ORDERED}[self.how](F.col(name))


def _halt(query: StreamingQuery) -> None:
    """Stop a query, and pass on the error if it has failed."""
    failure = query.exception()
    query.stop()
    if failure is not None:
        raise failure


class BuiltinJob:
    """A job over a stream of (seq, key, value).

    ``reduce`` names a built-in combiner, ``first`` or ``last``, or is an ``OrderedFold``.
    ``aggregate`` names a combiner, whose accumulator ``finish`` turns into its result, or
    is a ``BuiltinAggregate``. ``savepoint`` makes the job go on from there, with a backend
    and partition count of its own. With ``live`` the job writes, batch by batch, the new
    state of the keys that a batch has changed, see :meth:`live_outputs`.
    """

    def __init__(
        self,
        spark: SparkSession,
        stream: DataFrame,
        home: str,
        backend: str = "rocksdb_incre",
        partitions: int | None = None,
        savepoint: Savepoint | None = None,
        operators: tuple[str, ...] = names.OPERATORS,
        reduce: str | OrderedFold = "sum",
        aggregate: str | BuiltinAggregate = "sum",
        finish=lambda acc: acc,
        drop_others: bool = False,
        first: int = 0,
        live: bool = False,
    ):
        backend_settings(backend)
        self.spark, self.home = spark, home.rstrip("/")
        self.backend, self.partitions, self.live = backend, partitions, live
        self.operators = operators
        self.fold = reduce if isinstance(reduce, OrderedFold) else None
        if self.fold is not None:
            require_associative(self.fold.associative)
        elif reduce not in ORDERED:
            combiner(reduce)
        self.reduce = reduce
        if isinstance(aggregate, str):
            value = lambda value: value
            aggregate = BuiltinAggregate({"acc": (aggregate, value, "bigint")}, lambda acc: finish(acc["acc"]))
            self._plain = True
        else:
            self._plain = False
        for how, _, _ in aggregate.fields.values():
            combiner(how)
        self.aggregate = aggregate
        self.base = savepoint
        self._scanned: dict[int, DataFrame] = {}
        self.before = (
            savepoint.select(operators, stream.schema, drop_others) if savepoint else None
        )
        self.first = first
        kind = stream.schema["value"].dataType
        if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
            raise ValueError(f"value must be an integer, not {kind.simpleString()}")
        # Records that the savepoint holds already, or that come too late for it.
        late = F.lit(False) if savepoint is None else F.col("seq") < savepoint.position.next_index
        self.all = stream.withColumn("late", late)
        self.stream = self.all.filter(~F.col("late")).drop("late")
        self._set_measures()

    @property
    def checkpoint(self) -> str:
        return f"{self.home}/totals-checkpoint"

    @property
    def _keeps_rows(self) -> bool:
        return names.LIST in self.operators or (self.fold is not None and names.REDUCING in self.operators)

    def start(self, **trigger) -> list[StreamingQuery]:
        """Start, or start again on the same checkpoints. Default trigger: all available."""
        trigger = trigger or {"availableNow": True}
        key, value, late = F.col("key"), F.col("value"), F.col("late")
        sets = [[late, key], [late]] + ([[late, key, value]] if names.MAP in self.operators else [])
        measured = [m.combined(name).alias(name) for name, m in self._measures.items()]
        totals = self._partials().groupingSets(sets, late, key, value).agg(*measured, F.grouping_id().alias("level"))
        writer = totals.writeStream.outputMode("update")
        writer = writer.foreachBatch(self._write_updates) if self.live else writer.format("noop")
        with state_settings(self.spark, self.backend, self.partitions):
            queries = [writer.option("checkpointLocation", self.checkpoint).trigger(**trigger).start()]
            if self._keeps_rows:
                folder = f"{self.home}/list"
                queries.append(
                    self.stream.select("key", "seq", "value")
                    .writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, batch_id, folder))
                    .option("checkpointLocation", f"{self.home}/list-checkpoint")
                    .trigger(**trigger)
                    .start()
                )
        return queries

    def run(self) -> BuiltinJob:
        """Take in all available input and stop."""
        for query in self.start():
            query.awaitTermination()
        return self

    def stop(
        self, queries: list[StreamingQuery], poll_seconds: float = 0.5, deadline_seconds: float = 600
    ) -> BuiltinJob:
        """Stop running queries at one common point, for a savepoint.

        The totals stop first. The list goes on until it holds all they have seen; if it
        does not within the deadline it is stopped too, and this raises.
        """
        totals, *lists = queries
        _halt(totals)
        consumed = self.consumed()
        give_up = time.monotonic() + deadline_seconds
        for query in lists:
            while consumed and consumed.records and query.isActive and self._held(consumed) < consumed.records:
                if time.monotonic() > give_up:
                    query.stop()
                    raise TimeoutError(f"the list had not come up to seq {consumed.last} after {deadline_seconds} s")
                time.sleep(poll_seconds)
            _halt(query)
        return self

    def consumed(self) -> Consumed | None:
        """Consumed input as committed with the state, or None before the first batch."""
        batch = committed_batch(self.spark, self.checkpoint)
        return None if batch is None else self._consumed(batch)

    def _consumed(self, batch: int) -> Consumed | None:
        measures = [self._held_measure(m).alias(m) for m in ("records", "first", "last")]
        rows = self._level(batch, _OVERALL, None).select("late", *measures).collect()  # at most two
        late = sum(r["records"] for r in rows if r["late"])
        for row in rows:
            if not row["late"] and row["records"]:
                return Consumed(row["records"], row["first"], row["last"], batch, late)
        return Consumed(0, 0, -1, batch, late)

    def flush(self) -> dict[str, DataFrame]:
        """State of every key, by operator: scalars, and long forms of list and map.

        Raises if records were left out that came too late for the savepoint. A job that
        reads its source again from the start is not there yet while it has left out some,
        but not all, of the savepoint's records; this raises then as well.
        """
        return self._state(self._scan())

    def results(self) -> dict[str, DataFrame]:
        """``flush`` with the aggregate finished: (key, aggregated)."""
        tables = self.flush()
        if names.AGGREGATING in tables:
            tables[names.AGGREGATING] = tables[names.AGGREGATING].select(
                "key", self.aggregate.finish(F.col("acc")).alias("aggregated")
            )
        return tables

    def outputs(self) -> Outputs:
        """Both outputs of the job: its records as they came, and its result lines."""
        consumed = self.consumed()
        if consumed is None:
            raise SavepointError("nothing is committed yet")
        return Outputs(self._list_rows(consumed), result_lines(table_payloads(self.results())))

    def live_outputs(self) -> Outputs:
        """Both outputs of a job that may be running, as written so far: the records of all
        batches, and the scalar states of every key after the last batch that changed it.

        Each is exactly once by itself: a batch that runs again replaces its own folder. They
        come from two queries, so that one may be ahead of the other until the job stops.
        """
        if not self.live or not self._keeps_rows:
            raise ValueError("live outputs need live=True and the list among the operators")
        schema = "key {0}, seq bigint, total {1}".format(self._type("key"), "struct<" + ", ".join(f"{n}: {m.kind}" for n, m in self._measures.items()) + ">")
        updates = written_rows(self.spark, f"{self.home}/updates", schema)
        last = updates.groupBy("key").agg(F.max_by("total", "batch").alias("held"))
        tables = {o: t for o, t in self._scalars(last).items()}
        if names.AGGREGATING in tables:
            done = self.aggregate.finish(F.col("acc")).alias("aggregated")
            tables[names.AGGREGATING] = tables[names.AGGREGATING].select("key", done)
        records = written_rows(self.spark, f"{self.home}/list", self._row_schema).select("key", "seq", "value")
        return Outputs(records, result_lines(table_payloads(tables)))

    def savepoint(self, path: str, source: DataFrame | None = None, whole: bool = False) -> Savepoint:
        """Write the state as of the last committed batch. Stop the queries first.

        ``source`` is the input as a static table, for inputs whose ``seq`` has gaps. Of the
        list only the rows since this job's own savepoint are written, unless ``whole``.
        """
        consumed = self._scan()
        own = self._own(consumed)
        position = next_position(self.base, own, source, self.first)
        tables, lists = self._state(consumed), ()
        if names.LIST in tables and self.base is not None and not whole:
            schema = self.stream.select("key", "seq", "value").schema
            tables[names.LIST] = self._list_rows(own) if own else self.spark.createDataFrame([], schema)
            lists = self.base.list_folders
        return Savepoint.write(self.spark, path, tables, position, lists)

    # What the state of a (key) or (key, value) group holds, each measure once.

    def _set_measures(self) -> None:
        """The aggregate's buffers by name, and which of them each operator reads.

        Operators with the same measure share it; the first of them seeds it.
        """
        value, seq = F.col("value").cast("bigint"), F.col("seq").cast("bigint")
        self._measures: dict[str, _Measure] = {
            "records": _Measure("sum", F.lit(1).cast("bigint"), "bigint", None),
            "first": _Measure("min", seq, "bigint", None),
            "last": _Measure("max", seq, "bigint", None),
        }
        self._read_by: dict[str, dict[str, str]] = {}

        def add(operator: str, column: str, how: str, of: Column, kind: str, seed: Callable[[], Column], shared: str | None) -> None:
            name = shared or f"{operator}_{column}"
            self._measures.setdefault(name, _Measure(how, of, kind, operator, seed))
            self._read_by.setdefault(operator, {})[column] = name

        if names.VALUE in self.operators:
            add(names.VALUE, "total", "sum", value, "bigint", lambda: F.col("total"), "sum_value")
        if names.REDUCING in self.operators and self.fold is None:
            if self.reduce in ORDERED:
                # All records that are still to come are behind the savepoint's.
                place = F.lit(self.base.position.next_index - 1 if self.base else 0)
                kind = "struct<seq: bigint, value: bigint>"
                add(names.REDUCING, "reduced", self.reduce, numbered_value(seq, value), kind, lambda: numbered_value(place, F.col("reduced")), None)
            else:
                add(names.REDUCING, "reduced", self.reduce, value, "bigint", lambda: F.col("reduced"), f"{self.reduce}_value")
        if names.AGGREGATING in self.operators:
            for name, (how, of, kind) in self.aggregate.fields.items():
                shared = f"{how}_value" if self._plain else None
                add(names.AGGREGATING, name, how, of(F.col("value")), kind, lambda name=name: F.col(f"acc.{name}"), shared)
        if names.MAP in self.operators:
            add(names.MAP, "n", "sum", F.lit(1).cast("bigint"), "bigint", lambda: F.col("n"), None)

    def _partials(self) -> DataFrame:
        """Rows of the stream and of the savepoint as (late, key, value, one column a measure)."""
        late = F.col("late")
        kept = lambda column: F.when(~late, column)
        # Late records are only counted: all of them in one group without key and value.
        rows = self.all.select(
            late,
            *(kept(F.col(c)).alias(c) for c in ("key", "value")),
            *((m.of if m.owner is None else kept(m.of)).cast(m.kind).alias(name) for name, m in self._measures.items()),
        )
        for operator in self.operators if self.base is not None else ():
            mine = [name for name, m in self._measures.items() if m.owner == operator]
            if not mine:
                continue
            table = self.before[operator]
            seeds = self.spark.readStream.schema(table.schema).parquet(f"{self.base.path}/state/{operator}")
            group = F.col("value") if operator == names.MAP else F.lit(None)
            rows = rows.unionByName(
                seeds.select(
                    F.lit(False).alias("late"),
                    "key",
                    group.cast(rows.schema["value"].dataType).alias("value"),
                    *(self._seed(name, m, name in mine).alias(name) for name, m in self._measures.items()),
                )
            )
        return rows

    def _seed(self, name: str, measure: _Measure, mine: bool) -> Column:
        if name == "records":  # the savepoint's own are not counted again
            return F.lit(0).cast("bigint")
        return (measure.seed() if mine else F.lit(None)).cast(measure.kind)

    def _held_measure(self, name: str) -> Column:
        return F.col(f"held.{name}")

    def _level(self, batch_id: int, level: int, late: bool | None = False) -> DataFrame:
        """State rows of one grouping set: key, value, held."""
        rows = self._scanned.get(batch_id)
        if rows is None:
            rows = self._read(batch_id)
        rows = rows.filter(F.col("level") == level).drop("level")
        return rows if late is None else rows.filter(F.col("late") == late).drop("late")

    def _read(self, batch_id: int) -> DataFrame:
        # Buffers are renamed by place: their own names may repeat.
        held = ", ".join(f"{name}: {m.kind}" for name, m in self._measures.items())
        return state_rows(self.spark, self.checkpoint, batch_id).select(
            "key.late",
            "key.key",
            "key.value",
            F.col("key.spark_grouping_id").alias("level"),
            F.col("value").cast(f"struct<{held}>").alias("held"),
        )

    def _scan(self) -> Consumed | None:
        """Write the committed state out once, for all operators to read."""
        batch = committed_batch(self.spark, self.checkpoint)
        if batch is None:
            return None
        if batch not in self._scanned:
            self._scanned = {batch: materialize(self._read(batch), "state", ("level",))}
        return self._consumed(batch)

    def _own(self, consumed: Consumed | None) -> Consumed | None:
        """None if all that came was left out, for which the savepoint must answer."""
        check_late(self.base, consumed)
        return consumed if consumed is not None and consumed.records else None

    def _state(self, consumed: Consumed | None) -> dict[str, DataFrame]:
        own = self._own(consumed)
        if consumed is None or (own is None and self.before is None):
            if self.before is None:
                raise SavepointError("nothing is committed yet")
            return dict(self.before)
        made = self._scalars(self._level(consumed.batch_id, _PER_KEY))
        if names.MAP in self.operators:
            n = self._held_measure(self._read_by[names.MAP]["n"]).alias("n")
            # A key's other seeds pass through a group without a value, and count nothing there.
            made[names.MAP] = self._level(consumed.batch_id, _PER_VALUE).select("key", "value", n).where("n is not null")
        if names.LIST in self.operators:
            rows = self._list_rows(own) if own else None
            made[names.LIST] = self._after(names.LIST, rows)
        if self.fold is not None and names.REDUCING in self.operators:
            made[names.REDUCING] = self._folded(own)
        return {o: made[o] for o in self.operators}

    def _after(self, operator: str, rows: DataFrame | None) -> DataFrame:
        """What the savepoint holds, and then ``rows``."""
        if self.before is None:
            return rows
        return self.before[operator] if rows is None else self.before[operator].unionByName(rows)

    def _scalars(self, per_key: DataFrame) -> dict[str, DataFrame]:
        made = {}
        for operator, columns in self._read_by.items():
            read = {c: self._held_measure(name) for c, name in columns.items()}
            if operator == names.VALUE:
                made[operator] = per_key.select("key", read["total"].alias("total"))
            elif operator == names.REDUCING:
                reduced = read["reduced"]["value"] if self.reduce in ORDERED else read["reduced"]
                made[operator] = per_key.select("key", reduced.alias("reduced"))
            elif operator == names.AGGREGATING:
                acc = F.struct(*(column.alias(c) for c, column in read.items()))
                made[operator] = per_key.select("key", acc.alias("acc"))
        return made

    def _folded(self, own: Consumed | None) -> DataFrame:
        """The savepoint's folds, each followed by the fold of the key's rows since."""
        rows = None
        if own is not None:
            rows = reducing_state_ordered(self._list_rows(own), self.fold.merge, associative=True)
        if self.before is None or rows is None:
            return self._after(names.REDUCING, rows)
        parts = self.before[names.REDUCING].withColumn("pos", F.lit(0)).unionByName(rows.withColumn("pos", F.lit(1)))
        folds = parts.groupBy("key").agg(ordered("pos", "reduced").alias("items"))  # two at most
        return folds.select("key", fold(F.col("items"), self.fold.merge).alias("reduced"))

    # Rows of the list, by batch.

    @property
    def _row_schema(self) -> str:
        return ", ".join(f"{c} {self._type(c)}" for c in ("key", "seq", "value"))

    def _type(self, column: str) -> str:
        return self.stream.schema[column].dataType.simpleString()

    def _write_updates(self, changed: DataFrame, batch_id: int) -> None:
        """The states of the keys that a batch has changed. The batch is read once: it is the
        run in which the state is committed."""
        per_key = changed.filter((F.col("level") == _PER_KEY) & ~F.col("late"))
        held = F.struct(*self._measures).alias("total")
        write_batch(per_key.select("key", F.col("last").alias("seq"), held), batch_id, f"{self.home}/updates")

    def _list_rows(self, consumed: Consumed) -> DataFrame:
        """List elements up to the position of the totals; the list may be ahead."""
        held = self._held(consumed)
        if held != consumed.records:
            raise SavepointError(
                f"the list holds {held} records up to seq {consumed.last}, the totals "
                f"{consumed.records}: run both queries to the same point"
            )
        return self._listed(consumed).select("key", "seq", "value")

    def _listed(self, consumed: Consumed) -> DataFrame:
        rows = written_rows(self.spark, f"{self.home}/list", self._row_schema)
        return rows.filter(F.col("seq") <= consumed.last)

    def _held(self, consumed: Consumed) -> int:
        """Rows of the list up to the position, from the manifest; only a batch that lies on
        both sides of the position is read."""
        lines = manifest(self.spark, f"{self.home}/list")
        if lines is None:
            return 0
        across = (F.col("first") <= consumed.last) & (F.col("last") > consumed.last)
        whole = F.sum(F.when(F.col("last") <= consumed.last, F.col("records")))
        counted, odd = lines.agg(F.coalesce(whole, F.lit(0)), F.collect_list(F.when(across, F.col("batch")))).first()
        if odd:  # batches of one stream that is behind the other: one, as a rule
            counted += self._listed(consumed).filter(F.col("batch").isin(odd)).count()
        return counted
