"""Removal of repeated byte strings by blockwise suffix sorting.

A byte goes if a string of ``length`` bytes over it also starts earlier: in a document
with a smaller id, or further left in the same one. Suffixes are handled in buckets.

1. *Buckets.* The bucket of a window of ``length`` bytes is its least ``GRAM``-byte string by
   hash, so equal windows share a bucket wherever they stand. A document falls into runs
   of neighbouring windows that share the same occurrence of it. Runs are sorted by (bucket,
   content, document, start). A bucket met once holds no repeat and needs no sorting. Runs
   with equal bytes tie in all their windows: all but the first are repeats.
2. *Blocks.* The different runs of a bucket are sorted window by window, some megabytes at
   a time, with a difference cover: samples are ranked first, and windows that tie for
   its period are told apart by the ranks of samples (``difference_cover``). Windows equal
   to their neighbour in that order are repeats of the first of them.
3. *Buckets over several blocks* hand on one row for each different window, and these are
   compared by content; so memory is bounded by the block, not by the bucket.

Every step is a shuffle by bucket or document. Runs that repeat within one slice of text are
settled before the shuffle, so that a bucket that very many documents share is combined first.

Defined results: a null text is an empty one. Rows with the same id and text are one
document, all with its result; rows with the same id and other texts, and rows without an
id, count as documents of their own, in the order of their texts' hashes, those without
an id last. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .difference_cover import equal_neighbours, sort_suffixes
from .frames import flat_bytes, materialize, numbered, own_names, per_worker, renamed, slices, small_batches, table

LENGTH = 100
GRAM = 24
UNIT_BYTES = 1 << 20  # longer texts are cut, with an overlap of a window
BLOCK_BYTES = 1 << 20  # of run bytes sorted together
_LONGEST = UNIT_BYTES + (1 << 14)  # bytes whose runs are found at a time
PART_RUNS = 4096  # of one bucket in one task
_PLACES = np.uint64((1 << 23) - 1)
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return per_worker(("powers",), _made_tables)


def _made_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, and powers of an odd base and of its inverse, modulo 2**64."""
    base, n = 0x9E3779B97F4A7C15, _LONGEST
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.ones(n, np.uint64)
        done = 1
        while done < n:
            powers[done : 2 * done] = powers[: min(done, n - done)] * _U(pow(b, done, 1 << 64))
            done *= 2
        both.append(powers)
    return np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64), *both


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    width = 1
    while width * 2 <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if n > width else values


def runs(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, number of windows, bucket, content) of each run, in order of start."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    table_, powers, inverse = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table_[data] * powers[: len(data)], out=sums[1:])
    grams = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    least = _least((grams & ~_PLACES) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    chosen = (least & _PLACES).astype(np.int64)
    fits = np.diff(bounds) >= length
    edges = np.zeros(len(data) + 1, np.int32)
    np.add.at(edges, bounds[:-1][fits], 1)
    np.add.at(edges, bounds[1:][fits] - length + 1, -1)
    valid = np.cumsum(edges)[: len(chosen)] > 0
    begins = valid.copy()
    begins[1:] &= (chosen[1:] != chosen[:-1]) | ~valid[:-1]
    start = np.flatnonzero(begins)
    last = np.flatnonzero(valid & ~np.append(valid[1:], False))
    end = np.minimum(np.append(start[1:], len(data)), last[np.searchsorted(last, start)] + 1)
    content = _mixed((sums[end + length - 1] - sums[start]) * inverse[start])
    content = _mixed(content ^ ((end - start) << 32 | (chosen[start] - start)).astype(np.uint64))
    return start, end - start, grams[chosen[start]], content


def _units(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, document, offset in it) of texts, the long ones cut with overlap."""
    data, bounds = flat_bytes(part["text"])
    ids = part["id"].to_numpy()
    if len(data) <= UNIT_BYTES:
        yield data, bounds, ids, np.zeros(len(ids), np.int64)
        return
    for i, doc in enumerate(ids):
        own = data[bounds[i] : bounds[i + 1]]
        for at in range(0, max(1, len(own) - length + 1), UNIT_BYTES):
            unit = own[at : at + UNIT_BYTES + length - 1]
            yield unit, np.array([0, len(unit)]), np.array([doc]), np.array([at])


_RUNS = pa.schema([("bucket", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("again", pa.bool_())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def all_runs(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all texts (id, text); ``again``: an equal one came before in the same slice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                for data, bounds, ids, offsets in _units(part, length):
                    start, n, bucket, content = runs(data, bounds, length, gram)
                    which = np.searchsorted(bounds, start, side="right") - 1
                    doc, at = ids[which], start - bounds[which] + offsets[which]
                    order = np.lexsort((at, doc, content, bucket))
                    b, c = bucket[order], content[order]
                    again = np.zeros(len(order), bool)
                    again[1:] = (b[1:] == b[:-1]) & (c[1:] == c[:-1])
                    yield _batch(_RUNS, b.view(np.int64), c.view(np.int64), doc[order], at[order], n[order], again)

    return small_batches(texts).mapInArrow(cut, "bucket long, content long, id long, start long, n int, again boolean")


_FOUND = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("repeat", pa.bool_())])


def settled(found: DataFrame) -> DataFrame:
    """Repeats of whole runs, and the different runs of buckets that have several.

    Reads a sorted stream of rows: a row is a repeat if the one before is of its content; a
    run is to be sorted if a neighbour among the first of each content is of its bucket.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # first of the latest content, and whether it has a neighbour
        for batch in batches:
            local = batch.filter(batch["again"])
            if local.num_rows:
                yield _batch(_FOUND, *(local[k] for k in ("bucket", "id", "start", "n")), np.ones(local.num_rows, bool))
                batch = batch.filter(pc.invert(batch["again"]))
            if not batch.num_rows:
                continue
            b, c, doc, at, n = (batch[k].to_numpy() for k in ("bucket", "content", "id", "start", "n"))
            before_b, before_c = (held[0], held[1]) if held else (~b[0], ~c[0])
            new = np.append(before_b, b[:-1]) != b
            first = new | (np.append(before_c, c[:-1]) != c)
            rep = np.flatnonzero(~first)
            if len(rep):
                yield _batch(_FOUND, b[rep], doc[rep], at[rep], n[rep], np.ones(len(rep), bool))
            at_first = np.flatnonzero(first)
            if not len(at_first):
                continue
            fb = b[at_first]
            joined = ~new[at_first]  # has a neighbour before
            followed = np.append(joined[1:], False)
            rows = [b[at_first], doc[at_first], at[at_first], n[at_first]]
            if held and (held[5] or joined[0]):
                yield _batch(_FOUND, [held[0]], [held[2]], [held[3]], [held[4]], [False])
            keep = np.flatnonzero((joined | followed)[:-1])
            if len(keep):
                yield _batch(_FOUND, *(x[keep] for x in rows), np.zeros(len(keep), bool))
            i = at_first[-1]
            held = [fb[-1], c[i], doc[i], at[i], n[i], bool(joined[-1])]
        if held and held[5]:
            yield _batch(_FOUND, [held[0]], [held[2]], [held[3]], [held[4]], [False])

    # Rows settled before are spread evenly; they only pass through.
    to = F.when(F.col("again"), F.xxhash64("id", "start")).otherwise(F.col("bucket"))
    rows = found.repartition(to).sortWithinPartitions("again", "bucket", "content", "id", "start")
    return rows.mapInArrow(sweep, "bucket long, id long, start long, n int, repeat boolean")


def packed(texts: DataFrame) -> DataFrame:
    """(id, z): texts made small for the way to their runs."""
    schema = pa.schema([("id", pa.int64()), ("z", pa.binary())])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat_bytes(part["text"])
                z = [press.compress(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(z, pa.binary())], schema=schema)

    return small_batches(texts).mapInArrow(shrink, "id long, z binary")


_BYTES = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("raw", pa.binary())])


def with_bytes(open_runs: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The runs with their bytes."""
    each = open_runs.groupBy("id").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("runs"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch["runs"][i].values
                text = press.decompress(batch["z"][i].as_py())
                bucket, start, n = (own.field(k).to_numpy() for k in ("bucket", "start", "n"))
                raw = [text[s : s + k + length - 1] for s, k in zip(start.tolist(), n.tolist())]
                yield _batch(_BYTES, bucket, np.full(len(start), batch["id"][i].as_py()), start, n, raw)

    return packed(texts).join(each, "id").select("id", "z", "runs").mapInArrow(take, "bucket long, id long, start long, n int, raw binary")


_WINDOWS = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("content", pa.binary())])


def sorted_blocks(rows: DataFrame, length: int) -> DataFrame:
    """Repeats among the windows of different runs (id, start, n windows in a row), and, of
    buckets that go over several blocks, the first of each window with its content."""

    # A bucket of very many runs is dealt out to several tasks; it goes over blocks then.
    many = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PART_RUNS).alias("parts")).where("parts > 1")

    def block(held: list[tuple], cut: set[int]) -> Iterator[pa.RecordBatch]:
        bucket = np.array([h[0] for h in held])
        doc, begin, n = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 3))
        text = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
        heads = np.cumsum(n + length - 1) - (n + length - 1)
        which = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        starts = heads[which] + inside
        order = sort_suffixes(text, starts)
        same = equal_neighbours(text, starts[order], length)
        tie = np.cumsum(~same) - 1
        # The first window of each tie in order of document and start is no repeat.
        by = np.lexsort(((begin[which] + inside)[order], doc[which][order], tie))
        repeat = np.zeros(len(order), bool)
        repeat[order[by[1:]]] = tie[by[1:]] == tie[by[:-1]]
        begins = repeat.copy()
        begins[1:] &= ~repeat[:-1] | (inside[1:] == 0)
        ends = repeat & np.append(~repeat[1:] | (inside[1:] == 0), True)
        at, last = np.flatnonzero(begins), np.flatnonzero(ends)
        none = pa.nulls(len(at), pa.binary())
        yield _batch(_WINDOWS, doc[which[at]], begin[which[at]] + inside[at], last - at + 1, none)
        if cut:
            rest = np.flatnonzero(~repeat & np.isin(bucket[which], list(cut)))
            content = [text[s : s + length].tobytes() for s in starts[rest].tolist()]
            yield _batch(_WINDOWS, doc[which[rest]], begin[which[rest]] + inside[rest], np.ones(len(rest)), content)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, cut = [], 0, set()
        for batch in batches:
            for row in zip(*(batch[k].to_pylist() for k in (*_BYTES.names, "parts"))):
                if row[5]:
                    cut.add(row[0])
                if held and size + len(row[4]) > BLOCK_BYTES:
                    if held[-1][0] == row[0]:
                        cut.add(row[0])
                    yield from block(held, cut)
                    cut = {row[0]} & cut
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from block(held, cut)

    dealt = rows.join(many, "bucket", "left").select(*_BYTES.names, "parts")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "start"), F.col("parts")))
    ordered = dealt.repartition("bucket", part).sortWithinPartitions("bucket", "id", "start")
    return ordered.mapInArrow(sweep, "id long, start long, n int, content binary")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, start, n): each of ``n`` windows from ``start`` on also starts earlier. ``texts``
    has ``id``, unique and in the order that counts, and ``text``."""
    swept = materialize(settled(all_runs(texts, length, gram)), "runs")
    blocks = materialize(sorted_blocks(with_bytes(swept.where("not repeat"), texts, length), length), "blocks")
    over = blocks.where("content is not null").groupBy("content")
    later = over.agg(F.min(F.struct("id", "start")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    again = blocks.where("content is not null").join(later, "content").where("struct(id, start) > first")
    return (
        swept.where("repeat").select("id", "start", "n")
        .unionByName(blocks.where("content is null").select("id", "start", "n"))
        .unionByName(again.select("id", "start", "n"))
    )


_KEPT = pa.schema([
    ("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.string()),
])


def _deduplicated(texts: DataFrame, length: int, gram: int, with_kept: bool) -> DataFrame:
    marks = repeats(texts, length, gram).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("marks"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in _KEPT]
            size = 0
            for doc, z, own in zip(batch["id"].to_pylist(), batch["z"], batch["marks"]):
                text, spans, left, end = press.decompress(z.as_py()), [], [], 0
                if own.is_valid:
                    start, n = (own.values.field(k).to_numpy() for k in ("start", "n"))
                    order = np.argsort(start)
                    a, b = start[order], np.maximum.accumulate((start + n + length - 1)[order])
                    fresh = np.append(True, a[1:] > b[:-1])
                    firsts = np.flatnonzero(fresh)
                    spans = list(zip(a[firsts].tolist(), b[np.append(firsts[1:], len(b)) - 1].tolist()))
                for s, e in spans:
                    left.append(text[end:s])
                    end = e
                left = b"".join((*left, text[end:]))
                row = (doc, len(text), len(text) - len(left), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if with_kept else None)
                for column, value in zip(out, row):
                    column.append(value)
                size += len(text)
                if size > UNIT_BYTES:
                    yield _batch(_KEPT, *out)
                    out, size = [[] for _ in _KEPT], 0
            yield _batch(_KEPT, *out)

    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept string"
    return packed(texts).join(marks, "id", "left").select("id", "z", "marks").mapInArrow(keep, schema)


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """Every document with n_bytes, n_removed, the removed spans, and what stays: the digest of
    its bytes and, unless ``with_kept`` is false, its text, less code points cut in two."""
    texts, numbers = numbered(documents)
    if numbers is not None:
        texts = materialize(texts, "texts")
    return renamed(documents, _deduplicated(texts, length, gram, with_kept), numbers)


@own_names
def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with what stays as their text, and its code points as ``n_chars``."""
    texts, numbers = numbered(documents)
    text = F.col("text").cast("string")
    keyed = documents.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": F.xxhash64(text, F.length(text))}).drop("text", "n_chars")
    if numbers is None:
        same = F.col("__id") == F.col("__number")
        rest = _deduplicated(texts, length, gram, True).select("id", F.col("kept").alias("__kept"))
    else:
        rest = _deduplicated(materialize(texts, "texts"), length, gram, True).select("id", F.col("kept").alias("__kept"))
        rest = rest.join(numbers.select("id", F.col("doc_id").alias("__doc"), F.col("hash").alias("__numbered")), "id")
        same = F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__numbered"))
    rest = rest.withColumnRenamed("id", "__number")
    found = keyed.join(rest, same).withColumn("text", F.col("__kept")).withColumn("n_chars", F.length("__kept").cast("long"))
    return found.select(*documents.columns)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, rid of every 100-byte string that starts earlier too."""
    found = deduplicated(table(spark, sf_dir, "documents"), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
