"""What a restored job holds in its own store, ordered folds, live outputs, list deltas."""

import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keyfold import names
from keyfold.functions import int_div
from keyfold.operators import histogram_rows, list_rows, reducing_state, value_state
from keyfold.plans.checks import difference
from keyfold.sources import land_slices, open_slices, sequence, sequence_stream
from keyfold.streaming import BuiltinJob, OrderedFold, ProcessorJob, Savepoint, mean_aggregate
from keyfold.streaming.batch_log import manifest, write_batch, written_rows
from keyfold.streaming.state import committed_batch, state_rows
from keyfold.workdir import fresh_dir

RECORDS, KEYS, SLICES = 605, 20, 4


@pytest.fixture(scope="module")
def records(spark):
    """The sequence with some nulls, in key 3 nulls only."""
    made = sequence(spark, RECORDS, KEYS)
    return made.withColumn("value", F.expr("case when key = 3 or value % 7 = 5 then null else value end"))


@pytest.fixture()
def landed(spark, records):
    path = fresh_dir(spark, "slices")

    def land(*slices):
        land_slices(records, path, SLICES, files_per_slice=1, only=slices)
        return open_slices(spark, path, records.schema)

    return land


def make(spark, stream, backend, partitions, saved=None, **more):
    return BuiltinJob(spark, stream, fresh_dir(spark, "job"), backend, partitions, saved, **more)


def stopped(spark, landed, backend, slices=(0, 1), **more):
    stream = landed(*slices)
    job = make(spark, stream, backend, 2, **more).run()
    return stream, job.savepoint(fresh_dir(spark, "savepoint"))


@pytest.mark.parametrize("before, after, partitions", [("hashmap", "rocksdb", 3), ("rocksdb_incre", "hashmap", 1)])
def test_the_store_of_a_restored_job_holds_whole_states(spark, records, landed, before, after, partitions):
    stream, saved = stopped(spark, landed, before)
    landed(2, 3)
    job = make(spark, stream, after, partitions, saved).run()
    held = state_rows(spark, job.checkpoint, committed_batch(spark, job.checkpoint)).where("not key.late")
    level = held.withColumn("level", F.col("key.spark_grouping_id"))
    assert len(level.select("value.*").columns) == 5  # records, first, last, one sum, n
    per_key = job._level(committed_batch(spark, job.checkpoint), 1).select("key", F.col("held.sum_value").alias("total"))
    assert rows(difference(per_key, value_state(records))) == []
    per_value = job._level(committed_batch(spark, job.checkpoint), 0).select("key", "value", F.col(f"held.{names.MAP}_n").alias("n"))
    assert rows(difference(per_value.where("n is not null"), histogram_rows(records))) == []
    assert level.where("level = 1").count() == KEYS
    found = job.flush()
    assert rows(difference(found[names.LIST], list_rows(records))) == []
    assert job.savepoint(fresh_dir(spark, "savepoint")).position.records == RECORDS


def test_a_restored_job_goes_on_after_a_restart(spark, records, landed):
    """The savepoint enters the store once, however often the job starts."""
    stream, saved = stopped(spark, landed, "rocksdb")
    home = fresh_dir(spark, "job")
    landed(2)
    BuiltinJob(spark, stream, home, "hashmap", 2, saved).run()
    landed(3)
    job = BuiltinJob(spark, stream, home, "hashmap", 2, saved).run()
    found = job.flush()
    assert rows(difference(found[names.VALUE], value_state(records))) == []
    assert rows(difference(found[names.MAP], histogram_rows(records))) == []


def test_restore_without_new_records(spark, landed):
    stream, saved = stopped(spark, landed, "rocksdb", (0,))
    job = make(spark, stream, "hashmap", 3, saved).run()
    for operator, table in job.flush().items():
        assert rows(difference(table, saved.tables[operator])) == [], operator
    assert job.savepoint(fresh_dir(spark, "savepoint")).position == saved.position


def test_from_the_python_job_into_the_store(spark, landed):
    plain = sequence(spark, 300, 7)
    first = ProcessorJob(spark, sequence_stream(spark, 150, 7, 150), fresh_dir(spark, "job"), "rocksdb", 2).run()
    saved = first.savepoint(fresh_dir(spark, "savepoint"))
    job = make(spark, sequence_stream(spark, 300, 7, 150, 150), "hashmap", 3, saved).run()
    assert rows(difference(job.flush()[names.VALUE], value_state(plain))) == []
    assert rows(difference(job.flush()[names.MAP], histogram_rows(plain))) == []


LAST_THIRD = OrderedFold(lambda a, b: F.when(b % 3 == 0, b).otherwise(a), associative=True)


@pytest.mark.parametrize("how", ["first", "last", LAST_THIRD])
def test_order_is_kept_whatever_slice_comes_first(spark, records, landed, how):
    stream, saved = stopped(spark, landed, "rocksdb", (1, 0), operators=(names.REDUCING,), reduce=how)
    landed(3, 2)
    job = make(spark, stream, "hashmap", 3, saved, operators=(names.REDUCING,), reduce=how).run()
    found = job.results()[names.REDUCING]
    if isinstance(how, str):
        expected = rows(reducing_state(records, how))
    else:
        kept = {}
        for r in records.orderBy("seq").collect():
            if r.value is not None:
                kept[r.key] = r.value if r.key not in kept or r.value % 3 == 0 else kept[r.key]
        expected = sorted(((k, kept.get(k)) for k in range(KEYS)), key=repr)
    assert rows(found) == expected
    again = job.savepoint(fresh_dir(spark, "savepoint"))
    assert again.position.records == RECORDS and rows(again.tables[names.REDUCING]) == expected


def test_folds_must_be_stated_associative(spark):
    with pytest.raises(ValueError, match="associative"):
        BuiltinJob(spark, sequence_stream(spark, 1, 1, 1), "unused", reduce=OrderedFold(lambda a, b: a - b))


def test_an_accumulator_of_two_fields(spark, records, landed):
    mean = mean_aggregate(lambda acc: int_div(acc["total"], acc["n"]))
    stream, saved = stopped(spark, landed, "hashmap", operators=(names.AGGREGATING,), aggregate=mean)
    assert saved.tables[names.AGGREGATING].schema["acc"].dataType.names == ["total", "n"]
    landed(2, 3)
    job = make(spark, stream, "rocksdb", 4, saved, operators=(names.AGGREGATING,), aggregate=mean).run()
    expected = records.groupBy("key").agg(F.expr("cast(try_divide(sum(value), count(value)) as bigint)"))
    assert rows(job.results()[names.AGGREGATING]) == rows(expected)


def test_outputs_of_a_running_job(spark):
    total = 300
    stream = sequence_stream(spark, total, 7, records_per_batch=60)
    job = make(spark, stream, "rocksdb", 2, operators=(names.VALUE, names.LIST, names.REDUCING), live=True)
    queries = job.start(processingTime="100 milliseconds")
    give_up = time.time() + 120
    out = None
    while time.time() < give_up:
        time.sleep(1)
        try:
            out = job.live_outputs()
            if out.records.count() == total and job.consumed().records == total:
                break
        except Exception as error:  # nothing is written yet
            assert "PATH_NOT_FOUND" in str(error) or "NoneType" in str(error)
    assert all(q.isActive for q in queries)
    plain = sequence(spark, total, 7)
    assert rows(difference(out.records.select("key", "seq", "value"), list_rows(plain))) == []
    deadline = time.time() + 60
    lines = lambda: rows(job.live_outputs().state.where(f"operator = '{names.VALUE}'").select("line"))
    expected = sorted(((f"{r.key} {r.total}",) for r in value_state(plain).collect()), key=repr)
    while lines() != expected and time.time() < deadline:
        time.sleep(1)
    assert lines() == expected
    job.stop(queries)


def test_live_outputs_must_be_asked_for(spark):
    with pytest.raises(ValueError, match="live"):
        make(spark, sequence_stream(spark, 1, 1, 1), "rocksdb", 1).live_outputs()


def test_a_batch_that_runs_again_adds_no_row(spark):
    path = fresh_dir(spark, "batches")
    batch = sequence(spark, 20, 3)
    for _ in range(2):
        write_batch(batch, 0, path)
    write_batch(batch.where("seq < 0"), 1, path)
    batch.write.parquet(f"{path}/rows/batch=7")  # without its line in the manifest
    assert written_rows(spark, path, "seq bigint, key bigint, value bigint").count() == 20
    assert rows(manifest(spark, path)) == sorted([(20, 0, 19, 0), (0, None, None, 1)], key=repr)


def test_a_savepoint_writes_what_is_new_of_the_list(spark, records, landed):
    stream, one = stopped(spark, landed, "hashmap", (0, 1))
    landed(2)
    two = make(spark, stream, "hashmap", 2, one).run().savepoint(fresh_dir(spark, "savepoint"))
    landed(3)
    job = make(spark, stream, "rocksdb", 2, two).run()
    three, whole = job.savepoint(fresh_dir(spark, "savepoint")), job.savepoint(fresh_dir(spark, "savepoint"), whole=True)
    written = lambda s: spark.read.parquet(f"{s.path}/state/{names.LIST}").count()
    per_slice = -(-RECORDS // SLICES)
    assert [written(s) for s in (one, two, three, whole)] == [2 * per_slice, per_slice, RECORDS - 3 * per_slice, RECORDS]
    for saved in (three, whole, Savepoint.open(spark, three.path)):
        assert rows(difference(saved.tables[names.LIST], list_rows(records))) == []
    assert whole.lists == () and len(three.lists) == 2


def test_a_list_that_does_not_come_up_ends_the_wait(spark):
    job = make(spark, sequence_stream(spark, 100, 5, 50), "rocksdb", 2)
    queries = job.start(processingTime="100 milliseconds")
    give_up = time.time() + 60
    while (job.consumed() is None or not job.consumed().records) and time.time() < give_up:
        time.sleep(0.5)
    job._held = lambda consumed: 0
    with pytest.raises(TimeoutError):
        job.stop(queries, deadline_seconds=0.5)
    assert not any(q.isActive for q in queries)
