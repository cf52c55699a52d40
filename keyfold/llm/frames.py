"""Small helpers that the operators share."""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from keyfold.workdir import fresh_dir, materialize  # noqa: F401

#: Bytes of text an Arrow operator works on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at a time, if the session has no bound of its own.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def per_worker(name: tuple, make: Callable[[], Any]) -> Any:
    """A value made once in each Python process. Functions of this package travel to the
    workers by value, so a cache of their own would be empty in every task."""
    kept = vars(sys).setdefault("_keyfold", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(rows: DataFrame) -> DataFrame:
    """The rows, for work on whole texts in Python: from here on their session hands rows over
    ``BATCH_BYTES`` at a time, or one that is longer, and not 10,000 of whatever length. The JVM
    and the worker hold a batch once or twice each, and keep the room that it took."""
    conf = rows.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows


def local_rows(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table of the driver. Made of Arrow columns: rows of Python objects would be read by
    Python workers of a kind of their own, which stay on every executor beside the others."""
    return spark.createDataFrame(pa.table(columns))


def own_names(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a function of documents that gives back their columns and adds helpers, named with
    two underscores, on its way: columns of the documents with such names are set aside in a
    struct meanwhile, and come back with their names, values and places."""

    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"

    @functools.wraps(stage)
    def run(documents: DataFrame, *args, **more) -> DataFrame:
        columns = documents.columns
        aside = [c for c in columns if c.startswith("__")]
        if not aside:
            return stage(documents, *args, **more)
        box = "aside"
        while box in {c.lower() for c in columns}:
            box += "_"
        kept = [F.col(quoted(c)) for c in columns if c not in aside]
        found = stage(documents.select(*kept, F.struct(*(F.col(quoted(c)) for c in aside)).alias(box)), *args, **more)
        return found.select(*(F.col(f"{box}.{quoted(c)}").alias(c) if c in aside else F.col(quoted(c)) for c in columns))

    return run


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in pieces of at most ``most`` bytes of ``column``."""
    if not batch.num_rows:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(n)
    yield batch.slice(begin)


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str, most: int = 50_000) -> DataFrame:
    """``rows`` with ``name``: the place, from 0 and without gaps, of each row in its group.

    The order within a group is that of a hash of ``order``, then ``order``. A group may be
    of any size: it is cut by the hash into parts of about ``most`` rows, and only the
    parts' counts are summed up. ``rows`` is read twice and should be a written table.
    """
    parts = max(1, math.ceil(rows.count() / most))
    part = "__part"
    cut = rows.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        cut.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(part).alias("__at"), "__before")
    )
    same = F.col(part) == F.col("__at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    return (
        cut.join(counts, same)
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("__before"))
        .drop(part, "__at", "__before", *(f"__{k}" for k in keys))
    )


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, nulls being empty, and each text's bounds."""
    texts = pa.compute.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.empty(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def flat_words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words in a row with A-Z lowered, and the bounds of each text among them.

    ``between`` tells of each byte value whether it stands between words.
    """
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(bounds), np.int64)
    inside = ~between[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] |= inside[edges]
    at = np.flatnonzero(first)
    kept = LOWER[data[inside]]
    begins = (np.cumsum(inside) - inside)[at]
    offsets = np.append(begins, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(at, bounds)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """For :func:`flat_words`: the byte values in the given ranges, ends included."""
    chosen = np.zeros(256, bool)
    for low, high in ranges:
        chosen[low : high + 1] = True
    return chosen


#: What parts words in texts cut at white space, and in texts cut at any sign.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
SIGNS = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def numbered(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with ids that are unique, and the way back (id, doc_id, hash), if the
    documents' own ids are not."""
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    odd = own.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if not odd.take(1):
        return own.withColumnRenamed("doc_id", "id"), None
    hashed = own.withColumn("hash", F.xxhash64("text", F.length("text")))
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash").asc()]
    parts = materialize(
        hashed.select("doc_id", "hash").distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("part").orderBy(*order)
    ids = parts.join(sizes, "part").select("doc_id", "hash", (F.col("before") + F.row_number().over(inside)).alias("id"))
    ids = materialize(ids, "numbers")
    same = hashed["doc_id"].eqNullSafe(ids["doc_id"]) & (hashed["hash"] == ids["hash"])
    return hashed.join(ids, same).select("id", "text").dropDuplicates(["id"]), ids


def renamed(documents: DataFrame, result: DataFrame, numbers: DataFrame | None) -> DataFrame:
    """A result by the ids of :func:`numbered`, given to every row under its own id."""
    if numbers is None:
        return result.withColumnRenamed("id", "doc_id")
    text = F.col("text").cast("string")
    own = documents.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64(text, F.length(text)).alias("__hash"))
    same = F.col("__doc").eqNullSafe(F.col("doc_id")) & (F.col("__hash") == F.col("hash"))
    return own.join(numbers, same).select("id", "doc_id").join(result, "id").drop("id")
