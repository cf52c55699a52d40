"""Streams: restart, stop, savepoint, restore, and what must be refused."""

import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keyfold import names
from keyfold.operators import histogram_rows, list_rows, reducing_state, value_state
from keyfold.plans import checks
from keyfold.sources import land_slices, open_slices, sequence, sequence_stream
from keyfold.streaming import (
    BuiltinJob,
    ProcessorJob,
    PythonAggregate,
    Savepoint,
    SavepointError,
    log_batches,
    state_settings,
)
from keyfold.streaming.state import committed_batch
from keyfold.workdir import fresh_dir, shared_dir

RECORDS, KEYS, SLICES = 1205, 50, 4


@pytest.fixture(scope="module")
def records(spark):
    return sequence(spark, RECORDS, KEYS)


@pytest.fixture()
def source(spark, records):
    """Lands the asked slices; returns the stream over what is landed."""
    path = fresh_dir(spark, "slices")

    def land(*slices):
        for i in slices:
            land_slices(records, path, SLICES, files_per_slice=1, only=range(i, i + 1))
        return open_slices(spark, path, records.schema)

    return land


def assert_complete(tables, records):
    expected = {
        names.VALUE: value_state(records),
        names.LIST: list_rows(records),
        names.MAP: histogram_rows(records),
    }
    for operator in set(tables) & set(expected):
        assert rows(checks.difference(tables[operator], expected[operator])) == [], operator
    totals = value_state(records)
    if names.REDUCING in tables:
        reduced = tables[names.REDUCING].withColumnRenamed("reduced", "total")
        assert rows(checks.difference(reduced, totals)) == []
    if names.AGGREGATING in tables:
        acc = tables[names.AGGREGATING].selectExpr("key", "acc.acc as total")
        assert rows(checks.difference(acc, totals)) == []


def partitions_on_disk(job):
    """Partition folders of the first stateful operator in a job's checkpoint."""
    state = f"{job.checkpoint}/state/0"
    return len([d for d in os.listdir(state) if d.isdigit()])


@pytest.mark.parametrize("kind", [BuiltinJob, ProcessorJob])
def test_restart_on_the_same_checkpoint(spark, records, source, kind):
    stream = source(0, 1)
    home = fresh_dir(spark, "job")
    kind(spark, stream, home, "rocksdb", 2).run()
    source(2, 3)
    again = kind(spark, stream, home, "rocksdb", 2).run()
    assert_complete(again.flush(), records)


@pytest.mark.parametrize(
    "operator,mode",
    [
        (value_state, "complete"),
        (lambda df: reducing_state(df, "max"), "complete"),
        (histogram_rows, "complete"),
        (list_rows, "append"),
    ],
)
def test_operators_are_the_same_calls_on_a_stream(spark, records, source, operator, mode):
    name = f"out_{os.urandom(4).hex()}"
    query = (
        operator(source(0, 1, 2, 3))
        .writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", fresh_dir(spark, "job"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert rows(checks.difference(spark.table(name), operator(records))) == []


def test_each_batch_is_one_slice(spark, source):
    log = rows(log_batches(spark, source(0, 1, 2, 3), fresh_dir(spark, "job")))
    assert [r[0] for r in log] == [0, 1, 2, 3]
    assert [r[1] for r in log] == [302, 302, 302, 299]
    assert [r[2] for r in log] == [0, 302, 604, 906]


def test_restore_of_a_restore(spark, records, source):
    stream = source(0)
    first = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "hashmap", 2).run()
    one = first.savepoint(fresh_dir(spark, "savepoint"))
    assert (one.position.records, one.position.next_index) == (302, 302)
    source(1, 2)
    second = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "rocksdb", 3, one).run()
    two = second.savepoint(fresh_dir(spark, "savepoint"))
    assert two.position.next_index == 906
    source(3)
    third = ProcessorJob(spark, stream, fresh_dir(spark, "job"), "rocksdb_incre", 4, two).run()
    assert_complete(third.flush(), records)
    three = third.savepoint(fresh_dir(spark, "savepoint"))
    assert (three.position.records, three.position.next_index) == (RECORDS, RECORDS)
    assert (partitions_on_disk(first), partitions_on_disk(second)) == (2, 3)
    # Nothing is left to read: the state is the savepoint's.
    idle = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "hashmap", 2, three).run()
    assert_complete(idle.flush(), records)
    assert idle.savepoint(fresh_dir(spark, "savepoint")).position.next_index == RECORDS


def test_stop_while_running(spark, records):
    """A live stop at any moment; the two queries end at one common point."""
    stream = sequence_stream(spark, RECORDS, KEYS, records_per_batch=100)
    job = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "rocksdb", 2)
    queries = job.start(processingTime="100 milliseconds")
    deadline = time.time() + 120
    while (job.consumed() is None or job.consumed().records < 200) and time.time() < deadline:
        time.sleep(0.5)
    saved = job.stop(queries).savepoint(fresh_dir(spark, "savepoint"))
    start = saved.position.next_index
    assert start >= 200 and start % 100 == 0 or start == RECORDS
    rest = sequence_stream(spark, RECORDS, KEYS, RECORDS, start)
    after = BuiltinJob(spark, rest, fresh_dir(spark, "job"), "hashmap", 3, saved).run()
    assert_complete(after.flush(), records)


def test_input_out_of_order_is_refused(spark, records, source):
    stream = source(1)
    source(0, 2)  # slice 0 comes late: stop before it is read
    home = fresh_dir(spark, "job")
    job = BuiltinJob(spark, stream, home, "rocksdb", 2)
    job.run()
    assert job.savepoint(fresh_dir(spark, "savepoint"), source=records).position.next_index == 906

    late = source(3)
    gap_path = fresh_dir(spark, "gap")
    land_slices(records, gap_path, SLICES, files_per_slice=1, only=range(0, 1))
    land_slices(records, gap_path, SLICES, files_per_slice=1, only=range(2, 3))
    gappy = open_slices(spark, gap_path, late.schema)
    bad = BuiltinJob(spark, gappy, fresh_dir(spark, "job"), "rocksdb", 2).run()
    for known in (None, records):
        with pytest.raises(SavepointError, match="seq order"):
            bad.savepoint(fresh_dir(spark, "savepoint"), source=known)


def test_sparse_seq_needs_the_source(spark, records):
    sparse = records.withColumn("seq", records["seq"] * 10)
    path = fresh_dir(spark, "slices")
    land_slices(sparse, path, 2, files_per_slice=1)
    stream = open_slices(spark, path, sparse.schema)
    job = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "hashmap", 2).run()
    with pytest.raises(SavepointError):
        job.savepoint(fresh_dir(spark, "savepoint"))
    saved = job.savepoint(fresh_dir(spark, "savepoint"), source=sparse)
    assert saved.position.next_index == (RECORDS - 1) * 10 + 1


def test_savepoint_is_matched_by_operator_name(spark, source):
    stream = source(0)
    only = (names.MAP, names.VALUE)
    job = BuiltinJob(spark, stream, fresh_dir(spark, "job"), "rocksdb", 2, operators=only).run()
    path = fresh_dir(spark, "savepoint")
    saved = job.savepoint(path)
    assert set(Savepoint.open(spark, path).tables) == set(only)

    def restore(operators, **more):
        home = fresh_dir(spark, "job")
        return BuiltinJob(spark, stream, home, "hashmap", 2, saved, operators, **more)

    with pytest.raises(SavepointError, match="list_state"):
        restore((names.VALUE, names.MAP, names.LIST))
    with pytest.raises(SavepointError, match="map_state"):
        restore((names.VALUE,))
    restore((names.VALUE,), drop_others=True)
    restore((names.VALUE, names.MAP))  # another order is the same job


def test_savepoint_without_meta_is_no_savepoint(spark, source):
    job = BuiltinJob(spark, source(0), fresh_dir(spark, "job"), "rocksdb", 2)
    with pytest.raises(SavepointError, match="nothing is committed"):
        job.savepoint(fresh_dir(spark, "savepoint"))
    with pytest.raises(SavepointError, match="no complete savepoint"):
        Savepoint.open(spark, fresh_dir(spark, "savepoint"))


def test_key_type_must_match(spark, records, source):
    saved = (
        BuiltinJob(spark, source(0), fresh_dir(spark, "job"), "rocksdb", 2)
        .run()
        .savepoint(fresh_dir(spark, "savepoint"))
    )
    other = sequence_stream(spark, 10, 2, 10).selectExpr("seq", "string(key) as key", "value")
    with pytest.raises(SavepointError, match="string"):
        BuiltinJob(spark, other, fresh_dir(spark, "job"), "rocksdb", 2, saved)


def test_other_combiners_and_finish(spark, records, source):
    job = BuiltinJob(
        spark,
        source(0, 1),
        fresh_dir(spark, "job"),
        "hashmap",
        2,
        reduce="max",
        aggregate="min",
        finish=lambda acc: acc + 100,
    ).run()
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    stream = source(2, 3)
    after = BuiltinJob(
        spark,
        stream,
        fresh_dir(spark, "job"),
        "rocksdb",
        3,
        saved,
        reduce="max",
        aggregate="min",
        finish=lambda acc: acc + 100,
    ).run()
    found = after.results()
    assert rows(found[names.REDUCING]) == rows(
        records.groupBy("key").agg({"value": "max"})
    )
    assert {r.aggregated for r in found[names.AGGREGATING].collect()} == {100}


def test_python_functions_with_shards(spark, records, source):
    """A mean and a bit-or in Python, a hot key spread over shards, another count after."""
    one_key = records.withColumn("key", records["key"] * 0)
    mean = PythonAggregate(
        schema="total bigint, n bigint",
        create=lambda: (0, 0),
        add=lambda acc, values: (acc[0] + int(values.sum()), acc[1] + len(values)),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1]),
        finish=lambda acc: acc["total"] / acc["n"],
    )
    path = fresh_dir(spark, "slices")
    land_slices(one_key, path, SLICES, files_per_slice=1, only=range(2))
    stream = open_slices(spark, path, one_key.schema)
    functions = dict(reduce=lambda a, b: a | b, aggregate=mean)
    first = ProcessorJob(
        spark, stream, fresh_dir(spark, "job"), "rocksdb", 4, shards=4, **functions
    ).run()
    saved = first.savepoint(fresh_dir(spark, "savepoint"))
    land_slices(one_key, path, SLICES, files_per_slice=1, only=range(2, 4))
    after = ProcessorJob(
        spark, stream, fresh_dir(spark, "job"), "rocksdb_incre", 2, saved, shards=3, **functions
    ).run()
    tables = after.results()
    values = [i // KEYS for i in range(RECORDS)]
    everything = 0
    for v in values:
        everything |= v
    assert rows(tables[names.REDUCING]) == [(0, everything)]
    assert rows(tables[names.AGGREGATING]) == [(0, sum(values) / RECORDS)]
    del tables[names.REDUCING], tables[names.AGGREGATING]
    assert_complete(tables, one_key)


@pytest.mark.parametrize("kind", [BuiltinJob, ProcessorJob])
def test_struct_keys_in_a_stream(spark, kind):
    wrapped = sequence_stream(spark, 120, 7, 120, wrapped=True)
    stream = wrapped.selectExpr("seq", "key", "value.value as value")
    job = kind(spark, stream, fresh_dir(spark, "job"), "rocksdb", 2).run()
    saved = job.savepoint(fresh_dir(spark, "savepoint"))
    assert saved.key_type == "struct<value:bigint>"
    rest = sequence_stream(spark, 120, 7, 1, start=120, wrapped=True)
    rest = rest.selectExpr("seq", "key", "value.value as value")
    job = kind(spark, rest, fresh_dir(spark, "job"), "rocksdb_incre", 3, saved).run()
    expected = sequence(spark, 120, 7, wrapped=True).selectExpr("seq", "key", "value.value as value")
    assert_complete(job.flush(), expected)


def test_backends_by_name(spark):
    with pytest.raises(ValueError, match="heap"):
        BuiltinJob(spark, sequence_stream(spark, 1, 1, 1), "unused", "heap")
    with pytest.raises(ValueError, match="rocksdb"):
        ProcessorJob(spark, sequence_stream(spark, 1, 1, 1), "unused", "hashmap")
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    with state_settings(spark, "rocksdb_incre", 17):
        assert spark.conf.get(setting) == "17"
    assert spark.conf.get(setting) == before


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def _records(spark, frm, to, keys=2):
    return sequence(spark, to, keys).filter(F.col("seq") >= frm)


@pytest.mark.parametrize("job", [BuiltinJob, ProcessorJob])
def test_late_records_are_refused(spark, tmp_path, job):
    def stream():
        schema = sequence(spark, 1, 1).schema
        return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    add = lambda frm, to: _records(spark, frm, to).write.mode("append").parquet(str(tmp_path / "in"))
    add(10, 20)
    first = job(spark, stream(), str(tmp_path / "first")).run()
    with pytest.raises(SavepointError):  # 0 to 9 have not come yet
        first.savepoint(str(tmp_path / "too-early"))
    add(0, 10)
    saved = first.run().savepoint(str(tmp_path / "saved"))
    assert (saved.position.records, saved.position.next_index) == (20, 20)
    add(20, 30)
    second = job(spark, stream(), str(tmp_path / "second"), savepoint=saved).run()
    assert second.results()["list_state"].count() == 30  # from the start: 20 are left out
    add(5, 6)
    with pytest.raises(SavepointError):  # one more below the position
        second.run().savepoint(str(tmp_path / "late"))
    with pytest.raises(SavepointError):
        second.flush()


def test_declared_start(spark, tmp_path):
    _records(spark, 7, 20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sequence(spark, 1, 1).schema).parquet(str(tmp_path / "in"))
    with pytest.raises(SavepointError):
        BuiltinJob(spark, stream, str(tmp_path / "a")).run().savepoint(str(tmp_path / "sa"))
    saved = BuiltinJob(spark, stream, str(tmp_path / "b"), first=7).run().savepoint(str(tmp_path / "sb"))
    assert saved.position.records == 13


@pytest.mark.parametrize("job", [BuiltinJob, ProcessorJob])
def test_only_integers_are_taken(spark, tmp_path, job):
    stream = spark.readStream.schema("seq bigint, key bigint, value double").parquet(str(tmp_path))
    with pytest.raises(ValueError):
        job(spark, stream, str(tmp_path / "x"))


def test_mixed_accumulator_over_a_restore(spark, tmp_path):
    from keyfold.streaming import PythonAggregate

    mixed = PythonAggregate(
        schema="n bigint, mean double, label string",
        create=lambda: (0, 0.0, ""),
        add=lambda acc, v: (acc[0] + len(v), acc[1] + float(v.sum()) / 2, max(acc[2], f"v{int(v.max()):03d}")),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])),
        finish=lambda acc: F.concat_ws(" ", acc["n"].cast("string"), acc["mean"].cast("string"), acc["label"]),
    )
    make = lambda home, saved=None: ProcessorJob(
        spark, spark.readStream.schema(sequence(spark, 1, 1).schema).parquet(str(tmp_path / "in")), str(tmp_path / home),
        savepoint=saved, operators=("aggregating_state",), aggregate=mixed,
    )
    _records(spark, 0, 10).write.parquet(str(tmp_path / "in"))
    saved = make("one").run().savepoint(str(tmp_path / "saved"))
    _records(spark, 10, 20).write.mode("append").parquet(str(tmp_path / "in"))
    found = make("two", saved).run().results()["aggregating_state"].collect()
    assert sorted(r.aggregated for r in found) == ["10 22.5 v009", "10 22.5 v009"]


def _nulled(spark, big=0):
    """Keys 0 and 1 with some nulls, key 2 with nothing else, and the null key."""
    return spark.createDataFrame(
        [(i, [0, 1, 2, None][i % 4], None if i % 4 == 2 or i % 3 == 0 else big + i) for i in range(120)],
        "seq bigint, key bigint, value bigint",
    )


@pytest.mark.parametrize("shards", [1, 3])
def test_nulls_in_the_python_job(spark, shards):
    # Numbers past 2^53, which no float holds.
    records = _nulled(spark, 2**55)
    path = fresh_dir(spark, "slices")
    land_slices(records, path, 2, files_per_slice=1, only=range(1))
    stream = open_slices(spark, path, records.schema)
    make = lambda n, saved=None: ProcessorJob(
        spark, stream, fresh_dir(spark, "job"), "rocksdb", 2, saved, shards=n, spread_rows=2
    )
    saved = make(shards).run().savepoint(fresh_dir(spark, "savepoint"))
    land_slices(records, path, 2, files_per_slice=1, only=range(1, 2))
    tables = make(4 - shards, saved).run().flush()
    acc = rows(tables[names.AGGREGATING].selectExpr("key", "acc.acc as total"))
    totals = rows(value_state(records))
    # The accumulator of a key with nulls alone is what it was made as.
    assert acc == sorted([(k, t or 0) for k, t in totals], key=repr)
    reduced = tables[names.REDUCING]
    assert rows(reduced) == totals
    del tables[names.AGGREGATING], tables[names.REDUCING]
    assert_complete(tables, records)


def test_only_hot_keys_are_spread(spark):
    # Key 0 has a third of all rows, each other key fewer than are spread.
    records = spark.range(3000).selectExpr(
        "id as seq", "case when id % 3 = 0 then 0L else 1 + id % 97 end as key", "id as value"
    )
    path = fresh_dir(spark, "slices")
    cut = land_slices(records, path, 1, files_per_slice=1)
    stream = open_slices(spark, path, records.schema, cut.files_per_slice)
    job = ProcessorJob(spark, stream, fresh_dir(spark, "job"), "rocksdb", 2, shards=8, spread_rows=200).run()
    groups = dict(rows(job.fan_out()))
    assert groups.pop(0) == 8
    assert set(groups.values()) == {1}
    assert_complete(job.flush(), records)


@pytest.mark.parametrize("spread", [1, 2**40 + 1])
def test_the_map_of_the_python_job_is_in_pages(spark, spread):
    """1,500 values a key, near each other or not, come in two batches and over a restore."""
    records = spark.range(6000).selectExpr(
        "id as seq", "id % 2 as key", f"if(id % 1000 < 2, null, (id div 4 - 700) * {spread}L) as value"
    )
    path = fresh_dir(spark, "slices")
    land_slices(records, path, SLICES, files_per_slice=1, only=range(2))
    stream = open_slices(spark, path, records.schema)
    make = lambda saved=None: ProcessorJob(
        spark, stream, fresh_dir(spark, "job"), "rocksdb", 2, saved, operators=(names.MAP, names.LIST)
    )
    first = make().run()
    saved = first.savepoint(fresh_dir(spark, "savepoint"))
    land_slices(records, path, SLICES, files_per_slice=1, only=range(2, 4))
    second = make(saved).run()
    assert_complete(second.flush(), records)
    # A state entry holds many map entries, and no entry grows past a few pages' worth.
    for job, most in ((first, 8), (second, 16)):
        pages = job._variable(names.MAP, committed_batch(spark, job.checkpoint))
        sizes = [r[0] for r in pages.selectExpr("size(user_map_value.items)").collect()]
        assert len(sizes) <= 2 * most and max(sizes) < 512


def test_a_group_comes_to_the_state_in_one_row(spark):
    import pyarrow as pa

    from keyfold.streaming.processor import _pack

    rows_ = {"key": [5, 5, 0, 5, 0], "no_key": [False] * 2 + [True, False, False], "shard": [0, 0, 0, 1, 0]}
    batch = pa.RecordBatch.from_pydict(rows_ | {"seq": [1, 2, 3, 4, 5], "value": [7, None, 8, 9, 10]})
    found = [tuple(r.values()) for b in _pack(iter([batch, batch.slice(0, 1)])) for r in b.to_pylist()]
    expected = [(0, False, 0, [5], [10]), (0, True, 0, [3], [8]), (5, False, 0, [1, 2, 1], [7, None, 7]), (5, False, 1, [4], [9])]
    assert sorted(found, key=repr) == expected


def test_the_python_job_has_partitions_for_every_core(spark, sf_dir):
    """Also with half as many; the rows of a small file may be many."""
    from keyfold import catalog

    cores, setting = spark.sparkContext.defaultParallelism, "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "200")
        assert catalog._partitions(spark, sf_dir, ProcessorJob) // 2 >= cores
        assert catalog._partitions(spark, sf_dir) == 4
    finally:
        spark.conf.set(setting, before)
