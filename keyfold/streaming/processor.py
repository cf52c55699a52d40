"""The five states of a stream as state variables, for functions Spark lacks.

Each operator is a named state variable: a value, a value folded with the user's
function, an accumulator, a list and a map. Rows of a micro-batch are dealt by group and
packed before they come to the state, a row for each group with its rows side by side, as
every row that comes there alone is turned into Python field by field. Python runs once per
key and part of up to ``_PART`` rows, and writes each state once.
Every state call crosses to the JVM, some ten for a key and part, so leave to
``BuiltinJob`` what needs no function of the user's: choose ``operators``. The map holds
its entries in pages, by a hash of the value; pages double in number as entries come, so
that a call moves few of them however many the key has.

State is grouped by (key, shard). With more than one shard a hot key spreads over
that many groups, and its partial states are merged when read; a cold key keeps the one
group. A key is hot in a batch of rows of a scan task that holds over ``spread_rows`` of
its rows, and only those rows are spread. For that the reduce and aggregate functions must
be associative and commutative. They must be so in any case here, as rows of a micro-batch
come in no fixed order; the list keeps ``seq``.

A null value is skipped by the value, reducing and aggregating state and kept in list and
map. A key with nothing but nulls has a null total, a null reduced value and the
accumulator that ``create`` makes. The null key is a key like any other, and is marked in a
column of its own, as state is kept under a key without nulls.
"""

from __future__ import annotations

import functools
import itertools
import json
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    IntegerType,
    LongType,
    NumericType,
    ShortType,
    StringType,
    StructType,
    TimestampType,
)

from .. import names
from ..plans.hot import HOT_ROWS, find_hot
from ..workdir import materialize
from .backends import state_settings
from .savepoint import Consumed, Savepoint, SavepointError, check_late, next_position
from .state import committed_batch, state_rows

_POSITION = "position"
# A list entry holds the rows of one part, side by side.
_CHUNK = "seqs array<bigint>, items array<bigint>"
# Rows of one key that Python takes at a time.
_PART = 10_000
# Rows of a partition that are packed at a time.
_PACK_ROWS = 250_000
# A page of the map; ``bits`` and ``entries``, of the whole map, are kept in page 0.
_PAGE = "bits int, entries bigint, items array<bigint>, counts array<bigint>"
_PAGE_ENTRIES = 256  # entries of a page, on average at most
# Rows of one key in a batch of rows of a scan task, beyond which they are spread. Such a
# batch has 10,000 rows unless the session says otherwise.
SPREAD_ROWS = 500

# Workers need no copy of this package: its classes and functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


def _sum(a, b):
    return a + b


_GROUP = ("key", "no_key", "shard")


def _key_columns(kind: DataType) -> tuple[Column, Column]:
    """The key without nulls, where its type has something to stand in, and the mark of a null."""
    key, no_key = F.col("key"), F.col("key").isNull().alias("no_key")
    if isinstance(kind, (NumericType, BooleanType, TimestampType)):
        key = F.coalesce(key, F.lit(0).cast(kind)).alias("key")
    elif isinstance(kind, StringType):
        key = F.coalesce(key, F.lit("")).alias("key")
    return key, no_key


def _key_of() -> Column:
    """The key of a row of state."""
    return F.when(~F.col("key.no_key"), F.col("key.key")).alias("key")


def _known(items: list[int | None]) -> list[int]:
    """The values that are not null."""
    return [item for item in items if item is not None]


def _page(value: int | None, bits: int) -> int:
    """The page of a value among ``2 ** bits``: low bits of a product, so it or it + 2 ** bits with one more."""
    return (((value or 0) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32) & ((1 << bits) - 1)


def _spread(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sets ``shard`` to 0 for rows of keys with at most ``limit`` rows in their batch."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names_ = batch.schema.names
            hashes = batch.column(names_.index("key_hash")).to_numpy()
            _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            shards = batch.column(names_.index("shard")).to_numpy()
            kept = np.where(counts[at] > limit, shards, 0).astype(np.int32)
            yield batch.set_column(names_.index("shard"), "shard", pa.array(kept))

    return place


def _exact_sum(values: pd.Series) -> int:
    """The sum in Python's integers; past 64 bits the state refuses it, where pandas wraps."""
    return sum(values.tolist())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group among up to ``_PACK_ROWS`` rows, with its rows as two arrays."""

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if pa.types.is_nested(table.schema.field("key").type):  # Arrow does not group by these
            table = table.combine_chunks()
            ends = pa.array(np.arange(table.num_rows + 1, dtype=np.int32))
            for name in ("seq", "value"):
                column = table[name].combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                table = table.append_column(f"{name}_list", pa.ListArray.from_arrays(ends, column))
        else:
            table = table.group_by(list(_GROUP), use_threads=False).aggregate([("seq", "list"), ("value", "list")])
        table = table.select([*_GROUP, "seq_list", "value_list"]).rename_columns([*_GROUP, "seqs", "items"])
        yield from table.to_batches(max_chunksize=_PART)

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= _PACK_ROWS:
            yield from packed(held)
            held, rows = [], 0
    if rows:
        yield from packed(held)


@dataclass(frozen=True)
class PythonAggregate:
    """A user aggregate. An accumulator is a tuple with the fields of ``schema``."""

    schema: str = "acc bigint"
    create: Callable[[], tuple] = lambda: (0,)
    add: Callable[[tuple, pd.Series], tuple] = lambda acc, values: (acc[0] + _exact_sum(values),)
    merge: Callable[[tuple, tuple], tuple] = lambda a, b: (a[0] + b[0],)
    finish: Callable[[Column], Column] = lambda acc: acc["acc"]


class KeyedStates(StatefulProcessor):
    """State variables of the chosen operators, for one (key, shard) at a time."""

    def __init__(
        self, operators: tuple[str, ...], reduce: Callable, aggregate: PythonAggregate, next_index: int | None = None
    ):
        self.operators, self.reduce, self.aggregate = operators, reduce, aggregate
        self.next_index = next_index

    def init(self, handle: StatefulProcessorHandle) -> None:
        make = {
            names.VALUE: lambda n: handle.getValueState(n, "total bigint"),
            names.REDUCING: lambda n: handle.getValueState(n, "reduced bigint"),
            names.AGGREGATING: lambda n: handle.getValueState(n, self.aggregate.schema),
            names.LIST: lambda n: handle.getListState(n, _CHUNK),
            names.MAP: lambda n: handle.getMapState(n, "page bigint", _PAGE),
        }
        self.states = {n: make[n](n) for n in self.operators}
        self.position = handle.getValueState(_POSITION, "records bigint, first bigint, last bigint, late bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        for row in rows:
            seqs, items = row["seqs"], row["items"]
            if self.next_index is not None:
                taken = [i for i, seq in enumerate(seqs) if seq >= self.next_index]
                if len(taken) < len(seqs):
                    self._count_late(len(seqs) - len(taken))
                    seqs, items = [seqs[i] for i in taken], [items[i] for i in taken]
            for start in range(0, len(seqs), _PART):
                self._take(seqs[start : start + _PART], items[start : start + _PART])
        return iter(())

    def _take(self, seqs: list[int], items: list[int | None]) -> None:
        values = _known(items)
        if names.VALUE in self.states:
            self._add_total(values)
        if names.REDUCING in self.states:
            self._reduce_with(values)
        if names.AGGREGATING in self.states:
            state = self.states[names.AGGREGATING]
            held = state.get()
            acc = tuple(held) if held else self.aggregate.create()
            state.update(self.aggregate.add(acc, pd.Series(values, dtype="int64")) if values else acc)
        if names.LIST in self.states:
            self._append(seqs, items)
        if names.MAP in self.states:
            self._add_entries(Counter(items))
        self._advance(len(seqs), min(seqs), max(seqs))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """Take over a snapshot row of this key; there are several for a long list or map."""
        for operator, items, numbers, acc in (part.values() for part in initialState["parts"]):
            if operator == names.VALUE:
                self._add_total(_known(items))
            elif operator == names.REDUCING:
                self._reduce_with(_known(items))
            elif operator == names.AGGREGATING:
                state = self.states[names.AGGREGATING]
                held = state.get()
                # Fields are in the order of the schema.
                taken = tuple(json.loads(acc).values())
                state.update(self.aggregate.merge(taken, tuple(held)) if held else taken)
            elif operator == names.LIST:
                for start in range(0, len(items), _PART):
                    self._append(numbers[start : start + _PART], items[start : start + _PART])
            elif operator == names.MAP:
                self._add_entries(dict(zip(items, numbers)))

    def close(self) -> None:
        pass

    def _add_total(self, values: list[int]) -> None:
        self._fold(names.VALUE, _sum, values)

    def _reduce_with(self, values: list[int]) -> None:
        self._fold(names.REDUCING, self.reduce, values)

    def _fold(self, operator: str, function: Callable[[int, int], int], values: list[int]) -> None:
        """One state of one number: null until a value that is not null comes."""
        state = self.states[operator]
        held = state.get()
        items = [held[0]] if held and held[0] is not None else []
        items += values
        if items or not held:
            state.update((functools.reduce(function, items) if items else None,))

    def _append(self, seqs: list[int], items: list[int | None]) -> None:
        """Rows of one part as one list entry: a part is bounded, the list is not."""
        self.states[names.LIST].appendValue((seqs, items))

    def _add_entries(self, counts: dict[int | None, int]) -> None:
        """Add to the counts of values, page by page."""
        state = self.states[names.MAP]
        first = state.getValue((0,))
        bits, entries = (first[0], first[1]) if first else (0, 0)
        while entries + len(counts) > _PAGE_ENTRIES << bits:
            if entries:
                self._double_pages(bits)
            bits += 1
        pages: dict[int, dict[int | None, int]] = {0: {}}
        for value, n in counts.items():
            pages.setdefault(_page(value, bits), {})[value] = n
        # Page 0 comes last, with the number of entries.
        for page in sorted(pages, reverse=True):
            held = self._entries_of(page)
            before = len(held)
            for value, n in pages[page].items():
                held[value] = held.get(value, 0) + n
            entries += len(held) - before
            state.updateValue((page,), (bits, entries, list(held), list(held.values())))

    def _entries_of(self, page: int) -> dict[int | None, int]:
        held = self.states[names.MAP].getValue((page,))
        return dict(zip(held[2], held[3])) if held else {}

    def _double_pages(self, bits: int) -> None:
        """Each page gives those of its entries that have one more bit to a page of their own."""
        state = self.states[names.MAP]
        for page in range(1 << bits):
            held = self._entries_of(page)
            for half in (page, page + (1 << bits)):
                kept = {v: n for v, n in held.items() if _page(v, bits + 1) == half}
                if kept or half == page:
                    state.updateValue((half,), (bits + 1, 0, list(kept), list(kept.values())))

    def _count_late(self, late: int) -> None:
        """Records left out, since they come below the position this job goes on from."""
        held = self.position.get()
        records, first, last, before = held or (0, None, None, 0)
        self.position.update((records, first, last, before + late))

    def _advance(self, records: int, first: int, last: int) -> None:
        held, late = self.position.get(), 0
        if held:
            late = held[3]
        if held and held[0]:
            records, first, last = held[0] + records, min(held[1], first), max(held[2], last)
        self.position.update((records, first, last, late))


class ProcessorJob:
    """A job over a stream of (seq, key, value), with user functions in Python.

    Needs one of the RocksDB backends. ``shards`` is the number of groups that a hot key is
    spread over, see the module; it may differ between a job and the one that is restored
    from its savepoint.
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
        reduce: Callable[[int, int], int] = _sum,
        aggregate: PythonAggregate = PythonAggregate(),
        shards: int = 1,
        drop_others: bool = False,
        first: int = 0,
        spread_rows: int = SPREAD_ROWS,
    ):
        if backend == "hashmap":
            raise ValueError("state variables need a rocksdb backend; use BuiltinJob on hashmap")
        self.spark, self.home = spark, home.rstrip("/")
        self.backend, self.partitions = backend, partitions
        self.shards, self.spread_rows = shards, spread_rows
        self.operators, self.reduce, self.aggregate = operators, reduce, aggregate
        self.base = savepoint
        self._scanned: dict[int, dict[str, DataFrame]] = {}
        self.before = (
            savepoint.select(operators, stream.schema, drop_others) if savepoint else None
        )
        self.first = first
        kind = stream.schema["value"].dataType
        if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
            raise ValueError(f"value must be an integer, not {kind.simpleString()}")
        # None: nothing is late for a job that begins anew.
        self.next_index = savepoint.position.next_index if savepoint else None
        self.stream = stream

    @property
    def checkpoint(self) -> str:
        return f"{self.home}/states-checkpoint"

    def start(self, **trigger) -> list[StreamingQuery]:
        """Start, or start again on the same checkpoint. Default trigger: all available."""
        rows = self._placed()
        initial = self._initial_rows()
        updates = rows.groupBy(*_GROUP).transformWithState(
            KeyedStates(self.operators, self.reduce, self.aggregate, self.next_index),
            outputStructType="key string",
            outputMode="update",
            timeMode="none",
            initialState=initial.groupBy(*_GROUP) if initial is not None else None,
        )
        with state_settings(self.spark, self.backend, self.partitions):
            query = (
                updates.writeStream.format("noop")
                .outputMode("update")
                .option("checkpointLocation", self.checkpoint)
                .trigger(**(trigger or {"availableNow": True}))
                .start()
            )
        return [query]

    def run(self) -> ProcessorJob:
        for query in self.start():
            query.awaitTermination()
        return self

    def stop(self, queries: list[StreamingQuery]) -> ProcessorJob:
        for query in queries:
            failure = query.exception()
            query.stop()
            if failure is not None:
                raise failure
        return self

    def consumed(self) -> Consumed | None:
        batch = committed_batch(self.spark, self.checkpoint)
        if batch is None:
            return None
        row = (
            self._variable(_POSITION, batch)
            .agg(
                F.sum("value.records").alias("records"),
                F.min("value.first").alias("first"),
                F.max("value.last").alias("last"),
                F.coalesce(F.sum("value.late"), F.lit(0)).alias("late"),
            )
            .first()
        )
        if not row["records"]:
            return Consumed(0, 0, 0, batch, row["late"])
        return Consumed(row["records"], row["first"], row["last"], batch, row["late"])

    def flush(self) -> dict[str, DataFrame]:
        """State of every key, by operator: scalars, and long forms of list and map."""
        batch = committed_batch(self.spark, self.checkpoint)
        if batch is None:
            if self.before is None:
                raise SavepointError("nothing is committed yet")
            return dict(self.before)
        check_late(self.base, self.consumed())
        if batch not in self._scanned:
            # Written once: a later read does not load the state again.
            tables = {o: materialize(self._table(o, batch), o) for o in self.operators}
            self._scanned = {batch: tables}
        return dict(self._scanned[batch])

    def results(self) -> dict[str, DataFrame]:
        tables = self.flush()
        if names.AGGREGATING in tables:
            done = self.aggregate.finish(F.col("acc")).alias("aggregated")
            tables[names.AGGREGATING] = tables[names.AGGREGATING].select("key", done)
        return tables

    def savepoint(self, path: str, source: DataFrame | None = None) -> Savepoint:
        """Write the state as of the last committed batch. Stop the query first."""
        consumed = self.consumed()
        check_late(self.base, consumed)
        if consumed is not None and not consumed.records:
            consumed = None
        position = next_position(self.base, consumed, source, self.first)
        return Savepoint.write(self.spark, path, self.flush(), position)

    def fan_out(self) -> DataFrame:
        """(key, groups): over how many groups the state of each key is spread."""
        groups = self._variable(_POSITION, committed_batch(self.spark, self.checkpoint))
        return groups.groupBy(_key_of()).agg(F.count(F.lit(1)).alias("groups"))

    def _placed(self) -> DataFrame:
        """The stream's rows with their shard, packed by group."""
        rows = self.stream.select(
            *_key_columns(self.stream.schema["key"].dataType),
            "seq",
            F.col("value").cast("bigint").alias("value"),
            self._shard(F.col("seq")).alias("shard"),
        )
        if self.shards > 1:
            hashed = rows.withColumn("key_hash", F.xxhash64("key", "no_key"))
            rows = hashed.mapInArrow(_spread(self.spread_rows), hashed.schema).drop("key_hash")
        packed = rows.select(
            *_GROUP, F.array("seq").alias("seqs"), F.array(F.col("value").cast("bigint")).alias("items")
        ).schema
        return rows.repartition(*_GROUP).mapInArrow(_pack, packed)

    def _shard(self, of: Column) -> Column:
        if self.shards == 1:
            return F.lit(0)
        return F.pmod(F.xxhash64(of), F.lit(self.shards)).cast("int")

    def _shards_of(self, table: DataFrame, of: Column) -> DataFrame:
        """A savepoint's rows with shard and chunk: 0 but for keys that have very many of them."""
        hot = find_hot(table, HOT_ROWS)
        if hot is None:
            return table.withColumns({"shard": F.lit(0), "chunk": F.lit(0).cast("bigint")})
        # The count is a flag too, as the hot key may be the null key.
        joined = table.join(hot.table, table["key"].eqNullSafe(hot.table["hot_key"]), "left")
        is_hot = F.col("hot_rows").isNotNull()
        chunk = F.pmod(F.xxhash64(of, F.lit("chunk")), F.ceil(F.col("hot_rows") / HOT_ROWS))
        placed = {"shard": F.when(is_hot, self._shard(of)).otherwise(0), "chunk": F.when(is_hot, chunk).otherwise(0)}
        return joined.withColumns(placed).drop("hot_key", "hot_rows")

    def _variable(self, variable: str, batch: int) -> DataFrame:
        return state_rows(self.spark, self.checkpoint, batch, variable)

    def _table(self, operator: str, batch: int) -> DataFrame:
        rows = self._variable(operator, batch)
        key = _key_of()
        if operator == names.LIST:
            pairs = F.explode(F.arrays_zip("list_element.seqs", "list_element.items"))
            return rows.select(key, pairs.alias("pair")).select(
                "key", F.col("pair.seqs").alias("seq"), F.col("pair.items").alias("value")
            )
        if operator == names.MAP:
            pairs = F.explode(F.arrays_zip("user_map_value.items", "user_map_value.counts"))
            entries = rows.select(key, pairs.alias("pair")).select(
                "key", F.col("pair.items").alias("value"), F.col("pair.counts").alias("n")
            )
            if self.shards == 1:
                return entries
            return entries.groupBy("key", "value").agg(F.sum("n").alias("n"))
        if operator == names.VALUE:
            totals = rows.select(key, "value.total")
            if self.shards == 1:
                return totals
            return totals.groupBy("key").agg(F.sum("total").alias("total"))
        if operator == names.REDUCING:
            return self._merge_shards(rows.select(key, "value.reduced"), self._reduced_of)
        return self._merge_shards(rows.select(key, F.col("value").alias("acc")), self._acc_of)

    def _merge_shards(self, partial: DataFrame, merge: Callable[[list], Any]) -> DataFrame:
        """One row per key. A key has at most ``shards`` rows."""
        if self.shards == 1:
            return partial
        column = partial.columns[1]
        # Nulls are left out: a key with nothing else has an empty array.
        gathered = partial.groupBy("key").agg(F.collect_list(column).alias(column))

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                partials = batch.column(1)
                whole = pa.array([merge(of_key) for of_key in partials.to_pylist()], partials.type.value_type)
                yield pa.RecordBatch.from_arrays([batch.column(0), whole], ["key", column])

        return gathered.mapInArrow(merged, partial.schema)

    @property
    def _reduced_of(self) -> Callable[[list[int]], int | None]:
        reduce = self.reduce
        return lambda values: functools.reduce(reduce, values) if values else None

    @property
    def _acc_of(self) -> Callable[[list[dict]], dict]:
        aggregate = self.aggregate
        fields = StructType.fromDDL(aggregate.schema).names

        def merge(partials: list[dict]) -> dict:
            accs = [tuple(acc[f] for f in fields) for acc in partials]
            return dict(zip(fields, functools.reduce(aggregate.merge, accs)))

        return merge

    def _initial_rows(self) -> DataFrame | None:
        """Savepoint rows, one per group with all its operators, and further ones for a long list or map."""
        if self.before is None:
            return None
        none = F.expr("cast(array() as array<bigint>)")
        stacked = None
        for operator, table in self.before.items():
            kind = table.schema["key"].dataType
            fill: dict[str, Column] = {"items": none, "numbers": none, "acc": F.lit("")}
            placed = table.withColumns({"shard": F.lit(0), "chunk": F.lit(0).cast("bigint")})
            if operator == names.VALUE:
                fill["items"] = F.array("total")
            elif operator == names.REDUCING:
                fill["items"] = F.array("reduced")
            elif operator == names.AGGREGATING:
                fields = StructType.fromDDL(self.aggregate.schema).names
                fill["acc"] = F.to_json(F.struct(*(F.col(f"acc.{f}") for f in fields)), {"ignoreNullFields": "false"})
            else:
                of, number = ("seq", "seq") if operator == names.LIST else ("value", "n")
                pair = F.struct(F.col("value"), F.col(number).alias("number"))
                placed = self._shards_of(table, F.col(of)).groupBy("key", "shard", "chunk")
                placed = placed.agg(F.collect_list(pair).alias("pairs"))
                fill["items"], fill["numbers"] = F.col("pairs.value"), F.col("pairs.number")
            rows = placed.select(
                *_key_columns(kind),
                "shard",
                "chunk",
                F.struct(F.lit(operator).alias("operator"), *(c.alias(name) for name, c in fill.items())).alias("part"),
            )
            stacked = rows if stacked is None else stacked.unionByName(rows)
        return stacked.groupBy(*_GROUP, "chunk").agg(F.collect_list("part").alias("parts")).drop("chunk")
