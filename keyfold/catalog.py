"""Registered queries: each a Spark query over the given tables and its SQL.

Two views of ``events`` serve as input. ``keyed`` has real keys (users) and a measure
from JSON; ``indexed`` is the numbered sequence, ``event_id`` being the index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import names
from .functions import (
    histogram_text,
    int_div,
    list_text,
    parse_histogram_rows,
    parse_list_rows,
    parse_payload_lines,
    parse_total_lines,
    scalar_text,
    state_line,
    unwrap,
    wrap,
)
from .operators import (
    ColumnAggregate,
    aggregating_state,
    histogram_parts,
    histogram_rows,
    list_parts,
    list_rows,
    reducing_state,
    reducing_state_ordered,
    route,
    running_value,
    value_state,
)
from .plans import checks, row_checks
from .plans.five_state import keyed_state
from .plans.hot import HOT_ROWS
from .plans.payloads import as_text, result_lines, state_payloads, table_payloads
from .plans.sinks import read_lines, write_lines, write_result_lines
from .sources import events_as_sequence, events_keyed, land_slices, open_slices, table
from .streaming import BuiltinJob, OrderedFold, ProcessorJob, PythonAggregate, log_batches, mean_aggregate
from .workdir import fresh_dir

Query = Callable[[SparkSession, str], DataFrame]

KEYS = 100  # keys of the numbered sequence
SLICES = 4  # slices a table is landed in for the streams; they stop after half of them
SPLIT_ROWS = 64  # rows per group in the queries that split every key they can
SHARDS = 16  # state groups a hot key may be spread over in the Python job

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KEYED = """keyed as (
  select event_id as seq, user_id as key, cast(json_extract(props, '$.k') as bigint) as value
  from events)"""
_INDEXED = f"""indexed as (
  select event_id as seq, event_id % {KEYS} as key, event_id // {KEYS} as value
  from events)"""
# Records per key of the sequence, from the size of the table.
_COUNTS = f"""counts as (
  select k.key, n // {KEYS} + case when k.key < n % {KEYS} then 1 else 0 end as m
  from (select range as key from range({KEYS})) k, (select count(*) as n from events) t)"""
_CUT = f"""cut as (
  select lo + {SLICES // 2} * cast(ceil((hi - lo + 1) / {SLICES}.0) as bigint) as next_index
  from (select min(event_id) as lo, max(event_id) as hi from events))"""


def _with(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        SQL[name] = sql
        return query

    return add


# Sources, projections, text

@register(
    "sequence_source",
    _with(_INDEXED) + "select seq, key, value from indexed",
)
def sequence_source(spark, sf_dir):
    return events_as_sequence(spark, sf_dir, KEYS)


@register(
    "struct_key_group",
    _with(_KEYED) + "select key, cast(sum(value) as bigint) as total from keyed group by key",
)
def struct_key_group(spark, sf_dir):
    """Key and value wrapped in structs; grouped by the key inside."""
    return value_state(unwrap(wrap(events_keyed(spark, sf_dir))))


@register("pass_through", _with(_KEYED) + "select seq, key, value from keyed")
def pass_through(spark, sf_dir):
    """The records as they come out of a job that keeps their state."""
    return _live(spark, sf_dir).records.select("seq", "key", "value")


@register(
    "value_text",
    _with(_KEYED) + "select key || ' ' || cast(sum(value) as bigint) as line from keyed group by key",
)
def value_text(spark, sf_dir):
    totals = value_state(events_keyed(spark, sf_dir))
    return totals.select(state_line(F.col("key"), scalar_text(F.col("total"))).alias("line"))


@register(
    "text_sink_roundtrip",
    _with(_KEYED) + "select key || ' ' || cast(sum(value) as bigint) as line from keyed group by key",
)
def text_sink_roundtrip(spark, sf_dir):
    path = fresh_dir(spark, "lines")
    write_lines(value_text(spark, sf_dir), path)
    return read_lines(spark, path).withColumnRenamed("value", "line")


@register(
    "parse_result_lines",
    _with(_KEYED) + "select key, cast(sum(value) as bigint) as total from keyed group by key",
)
def parse_result_lines(spark, sf_dir):
    path = fresh_dir(spark, "lines")
    write_lines(value_text(spark, sf_dir), path)
    return parse_total_lines(read_lines(spark, path)).select("key", "total")


@register(
    "parse_list_lines",
    _with(_KEYED)
    + """select key, string_agg(cast(value as varchar), ' ' order by seq) as payload
from keyed group by key""",
)
def parse_list_lines(spark, sf_dir):
    parts = list_parts(events_keyed(spark, sf_dir))
    path = fresh_dir(spark, "lines")
    write_lines(
        parts.select(state_line(F.col("key"), list_text(F.col("items"))).alias("line")), path
    )
    return parse_payload_lines(read_lines(spark, path)).select("key", "payload")


def _lines_in_parts(spark, sf_dir, operators):
    """Folder of the result lines of ``operators``, lists and maps in parts of SPLIT_ROWS."""
    records = events_keyed(spark, sf_dir)
    tables = {names.LIST: list_rows(records), names.MAP: histogram_rows(records)}
    path = fresh_dir(spark, "lines")
    payloads = table_payloads({o: tables[o] for o in operators}, SPLIT_ROWS)
    write_result_lines(result_lines(payloads), path)
    return path


@register(
    "list_lines_in_parts",
    _with(_KEYED)
    + """select key, row_number() over (partition by key order by seq) - 1 as pos, value from keyed""",
)
def _(spark, sf_dir):
    """Lists written as lines, in parts, and read back with every element at its place."""
    path = _lines_in_parts(spark, sf_dir, (names.LIST,))
    return parse_list_rows(read_lines(spark, f"{path}/operator={names.LIST}"), SPLIT_ROWS)


@register(
    "map_lines_in_parts",
    _with(_KEYED)
    + """select key, row_number() over (partition by key order by value) - 1 as pos, value, n
from (select key, value, count(*) as n from keyed group by key, value)""",
)
def _(spark, sf_dir):
    path = _lines_in_parts(spark, sf_dir, (names.MAP,))
    return parse_histogram_rows(read_lines(spark, f"{path}/operator={names.MAP}"), SPLIT_ROWS)


@register(
    "expected_list",
    _with(_COUNTS)
    + f"""select key, part,
  array_to_string(range(part * {HOT_ROWS}, least(m, (part + 1) * {HOT_ROWS})), ' ') as items
from (select *, unnest(range((m + {HOT_ROWS} - 1) // {HOT_ROWS})) as part from counts where m > 0)""",
)
def expected_list(spark, sf_dir):
    total = table(spark, sf_dir, "events").count()
    parts = checks.expected_parts(spark, total, KEYS)
    items = checks.expected_items(F.col("m"), F.col("part"))
    return parts.select("key", "part", list_text(items).alias("items"))


# The keyed operators

_TOTAL = _with(_KEYED) + "select key, cast(sum(value) as bigint) as {} from keyed group by key"


@register("value_state", _TOTAL.format("total"))
def _(spark, sf_dir):
    return value_state(events_keyed(spark, sf_dir))


_RUNNING = (
    _with(_KEYED)
    + """select seq, key, cast(sum(value) over (
  partition by key order by seq rows unbounded preceding) as bigint) as running from keyed"""
)


@register("value_state_running", _RUNNING)
def _(spark, sf_dir):
    return running_value(events_keyed(spark, sf_dir))


@register("value_state_running_split", _RUNNING)
def _(spark, sf_dir):
    """The same with the plan for hot keys forced on most keys."""
    return running_value(events_keyed(spark, sf_dir), SPLIT_ROWS)


@register("reducing_state", _TOTAL.format("reduced"))
def _(spark, sf_dir):
    return reducing_state(events_keyed(spark, sf_dir))


@register(
    "reducing_state_max",
    _with(_KEYED) + "select key, max(value) as reduced from keyed group by key",
)
def _(spark, sf_dir):
    return reducing_state(events_keyed(spark, sf_dir), "max")


@register("reducing_state_function", _TOTAL.format("reduced"))
def _(spark, sf_dir):
    return reducing_state_ordered(events_keyed(spark, sf_dir), lambda a, b: a + b, associative=True)


@register(
    "reducing_state_last",
    _with(_KEYED) + "select key, arg_max(value, seq) as reduced from keyed group by key",
)
def _(spark, sf_dir):
    """Associative, not commutative: the right operand wins. Hot keys split."""
    return reducing_state_ordered(events_keyed(spark, sf_dir), lambda a, b: b, SPLIT_ROWS, associative=True)


@register("aggregating_state", _TOTAL.format("aggregated"))
def _(spark, sf_dir):
    return aggregating_state(events_keyed(spark, sf_dir))


@register("aggregating_state_merge", _TOTAL.format("aggregated"))
def _(spark, sf_dir):
    return aggregating_state(events_keyed(spark, sf_dir), hot_rows=SPLIT_ROWS)


def integer_mean() -> ColumnAggregate:
    """An accumulator unlike its input and its result."""
    big = lambda n: F.lit(n).cast("bigint")
    acc = lambda total, n: F.struct(total.alias("total"), n.alias("n"))
    return ColumnAggregate(
        zero=lambda: acc(big(0), big(0)),
        add=lambda a, v: acc(a["total"] + v, a["n"] + big(1)),
        merge=lambda a, b: acc(a["total"] + b["total"], a["n"] + b["n"]),
        finish=lambda a: int_div(a["total"], a["n"]),
        associative=True,
    )


@register(
    "aggregating_state_mean",
    _with(_KEYED)
    + "select key, cast(sum(value) as bigint) // count(*) as aggregated from keyed group by key",
)
def _(spark, sf_dir):
    return aggregating_state(events_keyed(spark, sf_dir), integer_mean(), SPLIT_ROWS)


@register(
    "list_state",
    _with(_KEYED)
    + f"""select key, part, string_agg(cast(value as varchar), ' ' order by seq) as items
from (select *, (row_number() over (partition by key order by seq) - 1) // {HOT_ROWS} as part
      from keyed)
group by key, part""",
)
def _(spark, sf_dir):
    parts = list_parts(events_keyed(spark, sf_dir))
    return parts.withColumn("items", list_text(F.col("items")))


@register("list_state_long", _with(_KEYED) + "select key, seq, value from keyed")
def _(spark, sf_dir):
    return list_rows(events_keyed(spark, sf_dir))


@register(
    "list_state_parts",
    _with(_KEYED)
    + f"""select key, part, string_agg(cast(value as varchar), ' ' order by seq) as items
from (select *, (row_number() over (partition by key order by seq) - 1) // {SPLIT_ROWS} as part
      from keyed)
group by key, part""",
)
def _(spark, sf_dir):
    parts = list_parts(events_keyed(spark, sf_dir), per_row=SPLIT_ROWS)
    return parts.withColumn("items", list_text(F.col("items")))


_HISTOGRAM = "select key, value, count(*) as n from keyed group by key, value"


@register("map_state_long", _with(_KEYED) + _HISTOGRAM)
def _(spark, sf_dir):
    return histogram_rows(events_keyed(spark, sf_dir))


@register(
    "map_state",
    _with(_KEYED)
    + f"""select key, part, string_agg(value || ',' || n, ' ' order by value) as hist
from (select *, (row_number() over (partition by key order by value) - 1) // {HOT_ROWS} as part
      from ({_HISTOGRAM}))
group by key, part""",
)
def _(spark, sf_dir):
    parts = histogram_parts(events_keyed(spark, sf_dir))
    return parts.select("key", "part", histogram_text(F.col("entries")).alias("hist"))


@register(
    "map_state_parts",
    _with(_KEYED)
    + f"""select key, part, string_agg(value || ',' || n, ' ' order by value) as hist
from (select *, (row_number() over (partition by key order by value) - 1) // 32 as part
      from ({_HISTOGRAM}))
group by key, part""",
)
def _(spark, sf_dir):
    parts = histogram_parts(events_keyed(spark, sf_dir), per_row=32)
    return parts.select("key", "part", histogram_text(F.col("entries")).alias("hist"))


def route_sql(hot_rows=HOT_ROWS):
    return (
        _with(_KEYED)
        + f"""select key, (count(*) + {hot_rows} - 1) // {hot_rows} as lanes, count(*) as n,
  1::bigint as partitions
from keyed group by key"""
    )


@register(
    "keyed_route",
    route_sql(),
)
def keyed_route(spark, sf_dir, hot_rows=HOT_ROWS):
    """Every (key, lane) is in one partition, at most; a key has a lane per ``hot_rows`` rows."""
    placed = route(events_keyed(spark, sf_dir), hot_rows=hot_rows)
    per_place = placed.withColumn("at", F.spark_partition_id()).groupBy("key", "lane", "at").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_lane = per_place.groupBy("key", "lane").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("partitions")
    )
    return per_lane.groupBy("key").agg(
        (F.max("lane") + 1).alias("lanes"), F.sum("n").alias("n"), F.max("partitions").alias("partitions")
    )


# All five at once

_LINES = f"""
totals as (select key, cast(sum(value) as bigint) as total from keyed group by key),
lists as (
  select key, part, string_agg(cast(value as varchar), ' ' order by seq) as items
  from (select *, (row_number() over (partition by key order by seq) - 1) // {HOT_ROWS} as part
        from keyed)
  group by key, part),
hists as (
  select key, part, string_agg(value || ',' || n, ' ' order by value) as hist
  from (select *, (row_number() over (partition by key order by value) - 1) // {HOT_ROWS} as part
        from ({_HISTOGRAM}))
  group by key, part)"""

_FIVE_LINES = (
    _with(_KEYED, _LINES)
    + """select operator, key, 0::bigint as part, key || ' ' || total as line
from totals, (values ('value_state'), ('reducing_state'), ('aggregating_state')) o(operator)
union all select 'list_state', key, part, key || ' ' || items from lists
union all select 'map_state', key, part, key || ' ' || hist from hists"""
)


@register(
    "five_state",
    _with(_KEYED, _LINES)
    + """select key, part, case when part = 0 then total end as value_state,
  case when part = 0 then total end as reducing_state,
  case when part = 0 then total end as aggregating_state, items as list_state, hist as map_state
from totals join lists using (key) left join hists using (key, part)""",
)
def five_state(spark, sf_dir):
    return as_text(keyed_state(events_keyed(spark, sf_dir)))


# Nulls: skipped by the folds, kept in list and map.
_NULLED = """nulled as (
  select seq, key, nullif(value % 7, 3) as value from keyed)"""


@register(
    "five_state_nulls",
    _with(_KEYED, _NULLED)
    + """select key, 0::bigint as part, cast(sum(value) as bigint) as value_state,
  cast(sum(value) as bigint) as reducing_state, cast(sum(value) as bigint) as aggregating_state,
  string_agg(coalesce(cast(value as varchar), 'null'), ' ' order by seq) as list_state,
  any_value(map_state) as map_state
from nulled join (
  select key, string_agg(coalesce(cast(value as varchar), 'null') || ',' || n, ' '
    order by value nulls first) as map_state
  from (select key, value, count(*) as n from nulled group by key, value) group by key)
using (key) group by key""",
)
def _(spark, sf_dir):
    records = events_keyed(spark, sf_dir)
    return as_text(keyed_state(records.withColumn("value", F.expr("nullif(value % 7, 3)"))))


@register("five_state_lines", _FIVE_LINES)
def _(spark, sf_dir):
    return result_lines(state_payloads(keyed_state(events_keyed(spark, sf_dir))))


@register(
    "five_state_split",
    _with(_KEYED)
    + f""", placed as (
  select *, (row_number() over (partition by key order by seq) - 1) // {SPLIT_ROWS} as part
  from keyed),
lists as (
  select key, part, string_agg(cast(value as varchar), ' ' order by seq) as list_state
  from placed group by key, part),
ranked as (
  select *, (row_number() over (partition by key order by value) - 1) // {SPLIT_ROWS} as part
  from ({_HISTOGRAM})),
hists as (
  select key, part, string_agg(value || ',' || n, ' ' order by value) as map_state
  from ranked group by key, part),
totals as (
  select key, 0::bigint as part, cast(sum(value) as bigint) as value_state
  from keyed group by key)
select key, part, value_state, value_state as reducing_state, value_state as aggregating_state,
  list_state, map_state
from lists left join hists using (key, part) left join totals using (key, part)""",
)
def _(spark, sf_dir):
    """The plan for hot keys, forced on most keys."""
    return as_text(keyed_state(events_keyed(spark, sf_dir), hot_rows=SPLIT_ROWS))


# Streams


def _land(spark, sf_dir, only=None, into=None):
    """Slices of the keyed events in the shared folder; (path, how they were cut)."""
    records = events_keyed(spark, sf_dir)
    path = into or fresh_dir(spark, "slices")
    return path, land_slices(records, path, SLICES, only=only)


def _open(spark, sf_dir, path, cut):
    schema = events_keyed(spark, sf_dir).schema
    return open_slices(spark, path, schema, cut.files_per_slice)


def _stopped(spark, sf_dir, make_job):
    """A job that took in the first half of the slices, and the rest landed after it."""
    half = SLICES // 2
    path, cut = _land(spark, sf_dir, range(half))
    stream = _open(spark, sf_dir, path, cut)
    job = make_job(stream).run()
    return job, stream, lambda: _land(spark, sf_dir, range(half, SLICES), path)


def _restored(spark, sf_dir, first, second):
    """Result lines of a job stopped half-way and gone on from by another one."""
    job, stream, land_rest = _stopped(spark, sf_dir, first)
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_rest()
    return result_lines(table_payloads(second(stream, saved).run().results()))


def _partitions(spark, sf_dir, kind=BuiltinJob):
    """State partitions: as many as the input has scan partitions, within the session's.

    A stream keeps its count for good, and each partition costs a store per batch. Python's
    time goes with the rows, not the bytes, so its job has two for each core at least: a job
    with half as many still keeps all cores busy.
    """
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = 2 * spark.sparkContext.defaultParallelism if kind is ProcessorJob else 4
    return min(session, max(least, table(spark, sf_dir, "events").rdd.getNumPartitions()))


def _job(kind, spark, sf_dir, backend, scale=1.0, **more):
    """Makes a job of ``kind`` with ``scale`` times the usual partitions."""
    partitions = max(1, int(scale * _partitions(spark, sf_dir, kind)))

    def make(stream, savepoint=None):
        home = fresh_dir(spark, "job")
        return kind(spark, stream, home, backend, partitions, savepoint, **more)

    return make


@register(
    "paced_read",
    f"""with bounds as (select min(event_id) as lo, max(event_id) as hi from events),
cut as (select lo, cast(ceil((hi - lo + 1) / {SLICES}.0) as bigint) as width from bounds)
select (event_id - lo) // width as batch_id, count(*) as records,
  min(event_id) as first, max(event_id) as last
from events, cut group by 1""",
)
def _(spark, sf_dir):
    path, cut = _land(spark, sf_dir)
    return log_batches(spark, _open(spark, sf_dir, path, cut), fresh_dir(spark, "job"))


@register(
    "resume_from_position",
    _with(_KEYED)
    + """select key, count(*) as n, min(seq) as first, max(seq) as last
from keyed group by key""",
)
def _(spark, sf_dir):
    """Records taken before the stop, and those from the saved position on."""
    job, _, _ = _stopped(spark, sf_dir, _job(BuiltinJob, spark, sf_dir, "rocksdb", operators=(names.LIST,)))
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    rest = events_keyed(spark, sf_dir).filter(F.col("seq") >= saved.position.next_index)
    both = saved.tables[names.LIST].unionByName(list_rows(rest))
    return both.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last")
    )


@register("checkpoint_restart", _FIVE_LINES)
def _(spark, sf_dir):
    """Stopped half-way and started again on the same checkpoints."""
    job, _, land_rest = _stopped(spark, sf_dir, _job(BuiltinJob, spark, sf_dir, "rocksdb_incre"))
    land_rest()
    return result_lines(table_payloads(job.run().results()))


@register("end_of_input_flush", _FIVE_LINES)
def _(spark, sf_dir):
    """One stream to the end of its input, then a line for every key."""
    path, cut = _land(spark, sf_dir)
    job = _job(BuiltinJob, spark, sf_dir, "hashmap")(_open(spark, sf_dir, path, cut)).run()
    return result_lines(table_payloads(job.results()))


@register("state_scan", _with(_KEYED) + _HISTOGRAM)
def _(spark, sf_dir):
    """State of every (key, value), read from the checkpoint."""
    path, cut = _land(spark, sf_dir)
    make = _job(BuiltinJob, spark, sf_dir, "rocksdb", operators=(names.MAP,))
    return make(_open(spark, sf_dir, path, cut)).run().flush()[names.MAP]


@register("state_variable_scan", _with(_KEYED) + "select key, seq, value from keyed")
def _(spark, sf_dir):
    """Elements of a list state variable, read from the checkpoint; a hot key is in many groups."""
    path, cut = _land(spark, sf_dir)
    make = _job(ProcessorJob, spark, sf_dir, "rocksdb", operators=(names.LIST,), shards=SHARDS)
    return make(_open(spark, sf_dir, path, cut)).run().flush()[names.LIST]


@register(
    "savepoint_export",
    _with(_KEYED, _CUT)
    + """select key, value, count(*) as n, any_value(next_index) as next_index
from keyed, cut where seq < next_index group by key, value""",
)
def _(spark, sf_dir):
    """The map state and the position of a job stopped half-way."""
    job, _, _ = _stopped(spark, sf_dir, _job(BuiltinJob, spark, sf_dir, "rocksdb"))
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    return saved.tables[names.MAP].withColumn(
        "next_index", F.lit(saved.position.next_index).cast("bigint")
    )


@register("savepoint_restore", _FIVE_LINES)
def _(spark, sf_dir):
    same = _job(BuiltinJob, spark, sf_dir, "hashmap")
    return _restored(spark, sf_dir, same, same)


@register("rescale_restore", _FIVE_LINES)
def _(spark, sf_dir):
    """Gone on from with twice as many partitions."""
    first = _job(BuiltinJob, spark, sf_dir, "rocksdb")
    return _restored(spark, sf_dir, first, _job(BuiltinJob, spark, sf_dir, "rocksdb", scale=2))


@register("backend_switch_restore", _FIVE_LINES)
def _(spark, sf_dir):
    """Another backend, and half as many partitions."""
    first = _job(BuiltinJob, spark, sf_dir, "hashmap")
    second = _job(BuiltinJob, spark, sf_dir, "rocksdb_incre", scale=0.5)
    return _restored(spark, sf_dir, first, second)


@register("processor_restore", _FIVE_LINES)
def _(spark, sf_dir):
    """State variables, hot keys spread over shards, another shard count after."""
    first = _job(ProcessorJob, spark, sf_dir, "rocksdb", shards=2)
    second = _job(ProcessorJob, spark, sf_dir, "rocksdb_incre", scale=0.5, shards=3)
    return _restored(spark, sf_dir, first, second)


@register(
    "processor_functions_restore",
    _with(_KEYED)
    + """select key, max(value) as reduced, cast(sum(value) as bigint) // count(*) as aggregated
from keyed group by key""",
)
def _(spark, sf_dir):
    """A reduce and an aggregate function in Python, over a stop and a restore."""
    mean = PythonAggregate(
        schema="total bigint, n bigint",
        create=lambda: (0, 0),
        add=lambda acc, values: (acc[0] + sum(values.tolist()), acc[1] + len(values)),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        finish=lambda acc: int_div(acc["total"], acc["n"]),
    )
    more = dict(operators=(names.REDUCING, names.AGGREGATING), reduce=max, aggregate=mean, shards=SHARDS)
    job, stream, land_rest = _stopped(spark, sf_dir, _job(ProcessorJob, spark, sf_dir, "rocksdb", **more))
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_rest()
    found = _job(ProcessorJob, spark, sf_dir, "rocksdb_incre", **more)(stream, saved).run().results()
    return found[names.REDUCING].join(found[names.AGGREGATING], "key")


@register(
    "processor_nulls_restore",
    _with(_KEYED, _NULLED)
    + """select operator, key, 0::bigint as part, key || ' ' || total as line
from (select key, cast(sum(value) as bigint) as total from nulled group by key),
  (values ('value_state'), ('reducing_state'), ('aggregating_state')) o(operator)
union all
select 'list_state', key, part,
  key || ' ' || string_agg(coalesce(cast(value as varchar), 'null'), ' ' order by seq)
from (select *, (row_number() over (partition by key order by seq) - 1) // """
    + f"{HOT_ROWS} as part from nulled"
    + """) group by key, part
union all
select 'map_state', key, 0, key || ' ' || string_agg(
  coalesce(cast(value as varchar), 'null') || ',' || n, ' ' order by value nulls first)
from (select key, value, count(*) as n from nulled group by key, value) group by key""",
)
def _(spark, sf_dir):
    """Null values in the Python job, over a stop and a restore."""
    records = events_keyed(spark, sf_dir).withColumn("value", F.expr("nullif(value % 7, 3)"))
    path = fresh_dir(spark, "slices")
    half = SLICES // 2
    cut = land_slices(records, path, SLICES, only=range(half))
    stream = open_slices(spark, path, records.schema, cut.files_per_slice)
    job = _job(ProcessorJob, spark, sf_dir, "rocksdb", shards=SHARDS)(stream).run()
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_slices(records, path, SLICES, only=range(half, SLICES))
    second = _job(ProcessorJob, spark, sf_dir, "rocksdb_incre", scale=0.5, shards=SHARDS)
    return result_lines(table_payloads(second(stream, saved).run().results()))


def _live(spark, sf_dir):
    """Both outputs of a job that writes them batch by batch."""
    path, cut = _land(spark, sf_dir)
    make = _job(BuiltinJob, spark, sf_dir, "rocksdb", operators=(names.VALUE, names.LIST), live=True)
    return make(_open(spark, sf_dir, path, cut)).run().live_outputs()


@register(
    "side_output_split",
    _with(_KEYED)
    + """select 'records' as output, key, seq || ' ' || value as payload from keyed
union all
select 'result', key, key || ' ' || cast(sum(value) as bigint) from keyed group by key""",
)
def _(spark, sf_dir):
    out = _live(spark, sf_dir)
    lines = out.state.filter(F.col("operator") == names.VALUE)
    return out.records.select(
        F.lit("records").alias("output"), "key", F.concat_ws(" ", "seq", "value").alias("payload")
    ).unionByName(lines.select(F.lit("result").alias("output"), "key", F.col("line").alias("payload")))


@register("restored_state_scan", _with(_KEYED) + _HISTOGRAM)
def _(spark, sf_dir):
    """State of every (key, value) in the store of a restored job, and of nothing else."""
    make = lambda backend, scale: _job(BuiltinJob, spark, sf_dir, backend, scale, operators=(names.MAP,))
    job, stream, land_rest = _stopped(spark, sf_dir, make("hashmap", 1))
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_rest()
    return make("rocksdb_incre", 2)(stream, saved).run().flush()[names.MAP]


def _late_slices(spark, sf_dir, **more):
    """A job restored half-way; of each half the later slice comes first."""
    middle = SLICES // 2
    path, cut = _land(spark, sf_dir, reversed(range(middle)))
    stream = _open(spark, sf_dir, path, cut)
    operators = (names.REDUCING,)
    job = _job(BuiltinJob, spark, sf_dir, "rocksdb", operators=operators, **more)(stream).run()
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    _land(spark, sf_dir, reversed(range(middle, SLICES)), path)
    return _job(BuiltinJob, spark, sf_dir, "hashmap", 2, operators=operators, **more)(stream, saved).run().results()[names.REDUCING]


@register(
    "reducing_state_last_stream",
    _with(_KEYED) + "select key, arg_max(value, seq) as reduced from keyed group by key",
)
def _(spark, sf_dir):
    """The last value of every key, held in the state store."""
    return _late_slices(spark, sf_dir, reduce="last")


@register(
    "reducing_state_fold_stream",
    _with(_KEYED)
    + """select key, coalesce(arg_max(value, seq) filter (where value % 3 = 0),
  arg_min(value, seq)) as reduced from keyed group by key""",
)
def _(spark, sf_dir):
    """A function of one's own that wants the order: the last multiple of three, or else the first value."""
    last_third = lambda a, b: F.when(b % 3 == 0, b).otherwise(a)
    return _late_slices(spark, sf_dir, reduce=OrderedFold(last_third, associative=True))


@register(
    "aggregating_state_mean_restore",
    _with(_KEYED)
    + "select key, cast(sum(value) as bigint) // count(*) as aggregated from keyed group by key",
)
def _(spark, sf_dir):
    """An accumulator of two fields in the state store, over a stop and a restore."""
    mean = mean_aggregate(lambda acc: int_div(acc["total"], acc["n"]))
    make = lambda backend, scale: _job(
        BuiltinJob, spark, sf_dir, backend, scale, operators=(names.AGGREGATING,), aggregate=mean
    )
    job, stream, land_rest = _stopped(spark, sf_dir, make("hashmap", 1))
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_rest()
    return make("rocksdb", 0.5)(stream, saved).run().results()[names.AGGREGATING]


# Checks, each on a sound result and on a damaged one


def _indexed(spark, sf_dir):
    records = events_as_sequence(spark, sf_dir, KEYS)
    return records, table(spark, sf_dir, "events").count()


# Which keys of a result are damaged, and how.
_DROPPED, _DOUBLED, _CHANGED, _ADDED = 7, 3, 5, KEYS + 1


def _damage(result, change):
    """One key dropped, one doubled, one changed, one added."""
    key = F.col("key")
    changed = {c: F.when(key == _CHANGED, e).otherwise(F.col(c)) for c, e in change.items()}
    kept = result.filter(key != _DROPPED).withColumns(changed)
    doubled = result.filter(key == _DOUBLED)
    added = result.filter(key == 1).withColumn("key", F.lit(_ADDED).cast("bigint"))
    return kept.unionByName(doubled).unionByName(added)


def _damage_sql(view, columns, change):
    picked = ", ".join(
        f"case when key = {_CHANGED} then {change[c]} else {c} end as {c}" if c in change else c
        for c in columns
    )
    plain = ", ".join(columns)
    return f"""damaged as (
  select key, {picked} from {view} where key <> {_DROPPED}
  union all select key, {plain} from {view} where key = {_DOUBLED}
  union all select {_ADDED}, {plain} from {view} where key = 1)"""


_STATUS = """case when coalesce(r.results, 0) = 0 then 'missing' when e.key is null then 'extra'
  when r.results > 1 then 'duplicate' when r.found = e.expected then 'ok' else 'wrong' end as status"""


def _compare_sql(view, found, extra="", on="key"):
    return f"""select {on}, r.found, e.expected, {_STATUS}
from (select {on}, count(*) as results, max({found}) as found from {view} group by {on}) r
full join expected e using ({on}){extra}"""


_TOTALS = "totals as (select key, cast(sum(value) as bigint) as total from indexed group by key)"
_EXPECTED_SUM = "expected as (select key, m * (m - 1) // 2 as expected from counts)"
_TOTAL_DAMAGE = _damage_sql("totals", ["total"], {"total": "total + 1"})


def _damaged_totals(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return _damage(value_state(records), {"total": F.col("total") + 1}), total


@register("expected_counts", _with(_COUNTS) + "select key, m from counts")
def _(spark, sf_dir):
    return checks.expected_counts(spark, table(spark, sf_dir, "events").count(), KEYS)


@register(
    "check_duplicates",
    _with(_INDEXED, _TOTALS, _TOTAL_DAMAGE)
    + "select key, count(*) as n from damaged group by key having count(*) > 1",
)
def _(spark, sf_dir):
    return checks.duplicates(_damaged_totals(spark, sf_dir)[0])


@register(
    "check_missing",
    _with(_INDEXED, _TOTALS, _TOTAL_DAMAGE, _COUNTS)
    + "select key from counts where key not in (select key from damaged)",
)
def _(spark, sf_dir):
    damaged, total = _damaged_totals(spark, sf_dir)
    return checks.missing(damaged, checks.expected_counts(spark, total, KEYS))


@register(
    "check_sum",
    _with(_INDEXED, _TOTALS, _COUNTS, _EXPECTED_SUM) + _compare_sql("totals", "total"),
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return checks.check_totals(value_state(records), total, KEYS)


@register(
    "check_sum_damaged",
    _with(_INDEXED, _TOTALS, _TOTAL_DAMAGE, _COUNTS, _EXPECTED_SUM)
    + f"select * from ({_compare_sql('damaged', 'total')}) where status <> 'ok'",
)
def _(spark, sf_dir):
    damaged, total = _damaged_totals(spark, sf_dir)
    return checks.faults(checks.check_totals(damaged, total, KEYS))


def _cut_views(per_row):
    """Lists and maps of the sequence in parts of ``per_row``, found and expected."""
    return f"""lists as (
  select key, part, string_agg(cast(value as varchar), ' ' order by seq) as items
  from (select *, (row_number() over (partition by key order by seq) - 1) // {per_row} as part
        from indexed)
  group by key, part),
hists as (
  select key, part, string_agg(value || ',' || n, ' ' order by value) as hist
  from (select *, (row_number() over (partition by key order by value) - 1) // {per_row} as part
        from (select key, value, count(*) as n from indexed group by key, value))
  group by key, part),
parts as (
  select key, part, range(part * {per_row}, least(m, (part + 1) * {per_row})) as items
  from (select *, unnest(range((m + {per_row} - 1) // {per_row})) as part from counts where m > 0))"""


# The changed list comes in reverse order.
_LIST_DAMAGE = _damage_sql(
    "lists",
    ["part", "items"],
    {"items": "array_to_string(list_reverse(string_split(items, ' ')), ' ')"},
)
_EXPECTED_LIST = """expected as (
  select key, part, array_to_string(items, ' ') as expected from parts)"""


def _as_list_text(compared):
    return compared.withColumns({c: list_text(F.col(c)) for c in ("found", "expected")})


def check_list_sql(per_row=HOT_ROWS):
    views = _with(_INDEXED, _COUNTS, _cut_views(per_row), _EXPECTED_LIST)
    return views + _compare_sql("lists", "items", on="key, part")


def check_list_damaged_sql(per_row=HOT_ROWS):
    views = _with(_INDEXED, _COUNTS, _cut_views(per_row), _LIST_DAMAGE, _EXPECTED_LIST)
    compared = _compare_sql("damaged", "items", on="key, part")
    return f"{views}select * from ({compared}) where status <> 'ok'"


@register("check_list", check_list_sql())
def check_list(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    return _as_list_text(checks.check_list(list_parts(records, per_row), total, KEYS, per_row))


@register("check_list_damaged", check_list_damaged_sql())
def check_list_damaged(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    damaged = _damage(list_parts(records, per_row), {"items": F.reverse("items")})
    return _as_list_text(checks.faults(checks.check_list(damaged, total, KEYS, per_row)))


# In the changed map every value was counted twice.
_HIST_DAMAGE = _damage_sql("hists", ["part", "hist"], {"hist": "replace(hist || ' ', ',1 ', ',2 ')"})
_EXPECTED_HIST = """expected as (
  select key, part, array_to_string(list_transform(items, lambda v: v || ',1'), ' ') as expected
  from parts)"""


def _as_histogram_text(compared):
    return compared.withColumns({c: histogram_text(F.col(c)) for c in ("found", "expected")})


def check_map_sql(per_row=HOT_ROWS):
    views = _with(_INDEXED, _COUNTS, _cut_views(per_row), _EXPECTED_HIST)
    return views + _compare_sql("hists", "hist", on="key, part")


def check_map_damaged_sql(per_row=HOT_ROWS):
    views = _with(_INDEXED, _COUNTS, _cut_views(per_row), _HIST_DAMAGE, _EXPECTED_HIST)
    compared = _compare_sql("damaged", "hist", on="key, part")
    return f"""{views}select key, part, trim(found) as found, expected, status
from ({compared}) where status <> 'ok'"""


@register("check_map", check_map_sql())
def check_map(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    compared = checks.check_histogram(histogram_parts(records, per_row), total, KEYS, per_row)
    return _as_histogram_text(compared)


@register("check_map_damaged", check_map_damaged_sql())
def check_map_damaged(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    twice = F.transform(
        "entries", lambda e: F.struct(e["value"].alias("value"), (e["n"] * 2).alias("n"))
    )
    damaged = _damage(histogram_parts(records, per_row), {"entries": twice})
    return _as_histogram_text(checks.faults(checks.check_histogram(damaged, total, KEYS, per_row)))


_REPORT = """found as (
  select 'value_state' as operator, key, 0::bigint as part, cast(total as varchar) as found
  from {0} where total is not null
  union all select 'reducing_state', key, 0, cast(total as varchar) from {0} where total is not null
  union all select 'aggregating_state', key, 0, cast(total as varchar) from {0} where total is not null
  union all select 'list_state', key, part, items from {1}
  union all select 'map_state', key, part, hist from {2}),
sums as (select key, cast(m * (m - 1) // 2 as varchar) as expected from counts),
expected as (
  select operator, key, 0::bigint as part, expected
  from sums, (values ('value_state'), ('reducing_state'), ('aggregating_state')) o(operator)
  union all select 'list_state', key, part, array_to_string(items, ' ') from parts
  union all select 'map_state', key, part,
    array_to_string(list_transform(items, lambda v: v || ',1'), ' ') from parts)"""
# Scalars stand in the first part.
_WIDE = """wide as (
  select key, part, case when part = 0 then total end as total, items, hist
  from totals join lists using (key) join hists using (key, part))"""


def check_report_sql(per_row=HOT_ROWS):
    views = _with(_INDEXED, _TOTALS, _COUNTS, _cut_views(per_row), _REPORT.format("totals", "lists", "hists"))
    return views + _compare_sql("found", "found", on="operator, key, part")


def check_report_damaged_sql(per_row=HOT_ROWS):
    views = _with(
        _INDEXED,
        _TOTALS,
        _COUNTS,
        _cut_views(per_row),
        _WIDE,
        _damage_sql("wide", ["part", "total", "items", "hist"], {"total": "total - 1"}),
        _REPORT.format("damaged", "damaged", "damaged"),
    )
    compared = _compare_sql("found", "found", on="operator, key, part")
    return f"{views}select * from ({compared}) where status <> 'ok'"


@register("check_report", check_report_sql())
def check_report(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    payloads = state_payloads(keyed_state(records, hot_rows=per_row))
    return checks.check_report(payloads, total, KEYS, per_row=per_row)


@register("check_report_damaged", check_report_damaged_sql())
def check_report_damaged(spark, sf_dir, per_row=HOT_ROWS):
    records, total = _indexed(spark, sf_dir)
    less = {c: F.col(c) - 1 for c in (names.VALUE, names.REDUCING, names.AGGREGATING)}
    payloads = state_payloads(_damage(keyed_state(records, hot_rows=per_row), less))
    return checks.faults(checks.check_report(payloads, total, KEYS, per_row=per_row))


@register(
    "check_replay",
    _with(_KEYED)
    + """select 'list_state' as operator, count(*) as rows, 0::bigint as faults from keyed
union all select 'map_state', count(*), 0 from (select distinct key, value from keyed)
union all select 'value_state', count(distinct key), 0 from keyed""",
)
def _(spark, sf_dir):
    """State of a stopped and restored stream against a pass over all records."""
    first = _job(BuiltinJob, spark, sf_dir, "rocksdb", operators=(names.VALUE, names.LIST, names.MAP))
    second = _job(BuiltinJob, spark, sf_dir, "hashmap", operators=(names.VALUE, names.LIST, names.MAP))
    job, stream, land_rest = _stopped(spark, sf_dir, first)
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_rest()
    found = second(stream, saved).run().flush()
    records = events_keyed(spark, sf_dir)
    replayed = {
        names.VALUE: value_state(records),
        names.LIST: list_rows(records),
        names.MAP: histogram_rows(records),
    }
    report = None
    for operator, table_ in found.items():
        faulty = row_checks.differing_rows(table_, replayed[operator]).agg(F.count(F.lit(1)).alias("faults"))
        row = table_.agg(
            F.lit(operator).alias("operator"), F.count(F.lit(1)).alias("rows")
        ).withColumn("faults", faulty.scalar())
        report = row if report is None else report.unionByName(row)
    return report


@register(
    "check_replay_damaged",
    _with(_KEYED)
    + f""", totals as (select key, cast(sum(value) as bigint) as total from keyed group by key),
{_TOTAL_DAMAGE}
select key, total, cast(sum(side) as bigint) as surplus
from (select key, total, 1 as side from damaged union all select key, total, -1 from totals)
group by key, total having sum(side) <> 0""",
)
def _(spark, sf_dir):
    totals = value_state(events_keyed(spark, sf_dir))
    return checks.difference(_damage(totals, {"total": F.col("total") + 1}), totals)


# Checks in long form, one row an element


def _row_compare_sql(found, expected, columns, on="key"):
    return f"""select {on}, cast(sum(f) as bigint) as rows, cast(sum(e) as bigint) as wanted,
  cast(sum(greatest(e - f, 0)) as bigint) as lacking, cast(sum(greatest(f - e, 0)) as bigint) as surplus,
  case when sum(f) = 0 then 'missing' when sum(e) = 0 then 'extra'
    when sum(abs(f - e)) = 0 then 'ok'
    when bool_and(f >= e and (f = e or e > 0)) then 'duplicate' else 'wrong' end as status
from (select {columns}, sum(f) as f, sum(e) as e
  from (select {columns}, 1 as f, 0 as e from {found}
    union all select {columns}, 0, 1 from {expected}) both_sides
  group by {columns}) each_row
group by {on}"""


# The sequence as it must be, from its number of records alone.
_MADE = f"""made as (
  select range as seq, range % {KEYS} as key, range // {KEYS} as value
  from range((select count(*) from events)))"""
_MADE_MAP = "made_map as (select key, value, count(*) as n from made group by key, value)"
_MAPS = "maps as (select key, value, count(*) as n from indexed group by key, value)"
# In the changed list one element comes with the value of the next; in the changed map
# one value was counted twice.
_SEQ_DAMAGE = _damage_sql(
    "indexed", ["seq", "value"], {"value": f"case when seq < {KEYS} then value + 1 else value end"}
)
_MAP_DAMAGE = _damage_sql("maps", ["value", "n"], {"n": "case when value = 0 then n + 1 else n end"})


def _damaged_list(records):
    first = F.col("seq") < KEYS
    return _damage(
        list_rows(records),
        {"value": F.when(first, F.col("value") + 1).otherwise(F.col("value"))},
    )


def _damaged_map(records):
    first = F.col("value") == 0
    return _damage(
        histogram_rows(records), {"n": F.when(first, F.col("n") + 1).otherwise(F.col("n"))}
    )


@register(
    "check_list_rows",
    _with(_INDEXED, _MADE) + _row_compare_sql("indexed", "made", "key, seq, value"),
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return row_checks.check_list_rows(list_rows(records), total, KEYS)


@register(
    "check_list_rows_damaged",
    _with(_INDEXED, _MADE, _SEQ_DAMAGE) + _row_compare_sql("damaged", "made", "key, seq, value"),
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return row_checks.check_list_rows(_damaged_list(records), total, KEYS)


@register(
    "check_map_rows",
    _with(_INDEXED, _MAPS, _MADE, _MADE_MAP) + _row_compare_sql("maps", "made_map", "key, value, n"),
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return row_checks.check_map_rows(histogram_rows(records), total, KEYS)


@register(
    "check_map_rows_damaged",
    _with(_INDEXED, _MAPS, _MADE, _MADE_MAP, _MAP_DAMAGE)
    + _row_compare_sql("damaged", "made_map", "key, value, n"),
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    return row_checks.check_map_rows(_damaged_map(records), total, KEYS)


def _report_rows_sql(totals, lists, maps):
    sides = []
    for name, a, b, c in (("found", totals, lists, maps), ("wished", "sums", "made", "made_map")):
        scalars = " union all ".join(
            f"select '{o}' as operator, key, total as x, cast(null as bigint) as y from {a}"
            for o in (names.VALUE, names.REDUCING, names.AGGREGATING)
        )
        sides.append(f"""{name} as ({scalars}
  union all select '{names.LIST}', key, seq, value from {b}
  union all select '{names.MAP}', key, value, n from {c})""")
    sums = "sums as (select key, m * (m - 1) // 2 as total from counts)"
    return [sums, *sides]


@register(
    "check_report_rows",
    _with(_INDEXED, _TOTALS, _COUNTS, _MAPS, _MADE, _MADE_MAP, *_report_rows_sql("totals", "indexed", "maps"))
    + _row_compare_sql("found", "wished", "operator, key, x, y", "operator, key"),
)
def _(spark, sf_dir):
    """All five operators of a stopped and restored stream of the numbered sequence."""
    records, total = _indexed(spark, sf_dir)
    path, half = fresh_dir(spark, "slices"), SLICES // 2
    cut = land_slices(records, path, SLICES, only=range(half))
    stream = open_slices(spark, path, records.schema, cut.files_per_slice)
    job = _job(BuiltinJob, spark, sf_dir, "hashmap")(stream).run()
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    land_slices(records, path, SLICES, only=range(half, SLICES))
    restored = _job(BuiltinJob, spark, sf_dir, "rocksdb", 0.5)(stream, saved).run()
    return row_checks.check_report_rows(restored.results(), total, KEYS)


_TOTALS_DAMAGED, _LISTS_DAMAGED, _MAPS_DAMAGED = (
    sql.replace("damaged as", f"damaged_{view} as", 1)
    for sql, view in ((_TOTAL_DAMAGE, "totals"), (_SEQ_DAMAGE, "lists"), (_MAP_DAMAGE, "maps"))
)


@register(
    "check_report_rows_damaged",
    _with(
        _INDEXED,
        _TOTALS,
        _COUNTS,
        _MAPS,
        _MADE,
        _MADE_MAP,
        _TOTALS_DAMAGED,
        _LISTS_DAMAGED,
        _MAPS_DAMAGED,
        *_report_rows_sql("damaged_totals", "damaged_lists", "damaged_maps"),
    )
    + "select * from ("
    + _row_compare_sql("found", "wished", "operator, key, x, y", "operator, key")
    + ") where status <> 'ok'",
)
def _(spark, sf_dir):
    records, total = _indexed(spark, sf_dir)
    totals = _damage(value_state(records), {"total": F.col("total") + 1})
    scalars = dict.fromkeys((names.VALUE, names.REDUCING, names.AGGREGATING), totals)
    nested = {names.LIST: _damaged_list(records), names.MAP: _damaged_map(records)}
    return checks.faults(row_checks.check_report_rows({**scalars, **nested}, total, KEYS))


@register(
    "check_replay_rows_damaged",
    _with(_KEYED)
    + """select key, seq, value, cast(sum(side) as bigint) as surplus
from (select key, seq, value + case when seq % 97 = 5 then 1 else 0 end as value, 1 as side
    from keyed where seq % 89 <> 7
  union all select key, seq, value, 1 from keyed where seq % 83 = 11
  union all select key, seq, value, -1 from keyed)
group by key, seq, value having sum(side) <> 0""",
)
def _(spark, sf_dir):
    """A list with rows changed, dropped and doubled, against a pass over all records."""
    replayed = list_rows(events_keyed(spark, sf_dir))
    changed = F.col("value") + F.when(F.col("seq") % 97 == 5, 1).otherwise(0)
    found = replayed.filter(F.col("seq") % 89 != 7).withColumn("value", changed)
    found = found.unionByName(replayed.filter(F.col("seq") % 83 == 11))
    return row_checks.differing_rows(found, replayed)
