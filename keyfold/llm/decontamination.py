"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: each row is a shard, the postings of some megabytes of
text, with one list of positions for each term. A phrase is found by taking its rarest
term's list in each shard, shifting it by the term's place in the phrase, and keeping the
positions that the shifted lists of the next rarer terms have too. With ``slack`` over 0
every term may stand that many words off its place: proximity matches.

The index holds the terms of the test set; no query asks for another. The test set goes
to the tasks in blocks of at most ``BLOCK_BYTES`` of text, so that what is broadcast is bounded
however large it is; the matches of all blocks meet by document.

Defined results: a null or empty text has no words and is never contaminated. An item
without words is never found; items that share an id count once; a null id reads as the
empty string. Repeated documents are judged each for themselves. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import SIGNS, flat_bytes, flat_words, local_rows, materialize, own_names, slices, small_batches, table

WINDOW = 13
BLOCK_BYTES = 8 << 20
_GAP = 64  # positions between two documents of a shard; a window and its slack are shorter


class Phrases(NamedTuple):
    """The different windows of some test items, and the items that have each."""

    terms: list[str]
    windows: np.ndarray  # one row a window: term numbers, then -1
    items: list[str]
    owners: list[list[int]]  # of each window, numbers of items


def phrases(rows: list[tuple[str, str]], size: int = WINDOW) -> Phrases:
    """Windows of ``size`` words of each (item, text); a shorter text is one window."""
    data, bounds = flat_bytes(pa.array([t for _, t in rows], pa.string()))
    words, cut = flat_words(data, bounds, SIGNS)
    coded = words.cast(pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy()
    items = sorted({i for i, _ in rows})
    number = {i: n for n, i in enumerate(items)}
    owners: dict[tuple[int, ...], set[int]] = {}
    for (item, _), a, b in zip(rows, cut, cut[1:]):
        own = codes[a:b].tolist()
        for i in range(max(1, len(own) - size + 1) if own else 0):
            owners.setdefault(tuple(own[i : i + size]), set()).add(number[item])
    windows = np.full((len(owners), size), -1, np.int64)
    for i, w in enumerate(owners):
        windows[i, : len(w)] = w
    return Phrases(coded.dictionary.to_pylist(), windows, items, [sorted(o) for o in owners.values()])


def test_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The items (item_id, text) in blocks of bounded size, one block at a time."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    for item, text in rows.toLocalIterator():
        if block and held + len(text) > most // 4:
            yield block
            block, held = [], 0
        block.append((item, text))
        held += len(text)
    if block:
        yield block


INDEX_SCHEMA = "shard long, doc_ids array<long>, doc_words array<int>, terms array<string>, counts array<int>, positions binary"
_INDEX_ARROW = pa.schema([
    ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.list_(pa.int32())),
    ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("positions", pa.binary()),
])


def positional_index(documents: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """The shards of the index, written to the shared folder.

    A document's words stand at positions that follow one another; between two documents
    of a shard ``_GAP`` positions stay free. ``positions`` holds, for each term of the shard,
    ``counts`` ascending 32-bit positions, term after term.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if vocabulary is None else pa.array(vocabulary, pa.string())
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                words, cut = flat_words(*flat_bytes(part["text"]), SIGNS)
                coded = words.cast(pa.string()).dictionary_encode()
                codes = coded.indices.to_numpy()
                counts = np.diff(cut)
                position = np.arange(len(codes)) + _GAP * (1 + np.repeat(np.arange(len(counts)), counts))
                terms = coded.dictionary
                if wanted is not None:
                    keep = pc.is_in(terms, wanted).to_numpy(zero_copy_only=False)
                    number = np.where(keep, np.cumsum(keep) - 1, -1)[codes] if len(codes) else codes
                    terms, position, codes = terms.filter(pa.array(keep)), position[number >= 0], number[number >= 0]
                order = np.argsort(codes, kind="stable")
                sizes = np.bincount(codes, minlength=len(terms)) if len(terms) else []
                row = (base + n, part["doc_id"].to_pylist(), counts, terms.to_pylist(), sizes, position[order].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _INDEX_ARROW)], schema=_INDEX_ARROW)
                n += 1

    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return materialize(small_batches(texts).mapInArrow(build, INDEX_SCHEMA), "index")


def term_counts(index: DataFrame) -> DataFrame:
    """How often each term of the index stands in the corpus."""
    lists = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    return lists.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))


def intersect(keys: np.ndarray, windows: np.ndarray, offsets: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of each match in one shard.

    ``keys`` are ascending ``term << 32 | position``. Each row of ``windows`` has term numbers,
    rarest first, -1 where there is none, and ``offsets`` the place of each in the phrase.
    """
    low = np.searchsorted(keys, windows[:, 0] << 32)
    n = np.searchsorted(keys, (windows[:, 0] + 1) << 32) - low
    which = np.repeat(np.arange(len(windows)), n)
    within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    start = (keys[low[which] + within] & 0xFFFFFFFF) - offsets[which, 0]
    for k in range(1, windows.shape[1]):
        term = windows[which, k]
        wanted = (term << 32) + start + offsets[which, k]
        at = np.searchsorted(keys, wanted - slack)
        held = keys[np.minimum(at, len(keys) - 1)]
        good = (term < 0) | (at < len(keys)) & (held <= wanted + slack)
        which, start = which[good], start[good]
    return which, start


MATCH_SCHEMA = "shard long, place int, doc_id long, item_id string, spans array<struct<first:long,end:long>>"
_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_MATCH_ARROW = pa.schema([
    ("shard", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("item_id", pa.string()), ("spans", pa.list_(_SPAN)),
])


def spans(place: np.ndarray, item: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Occurrences joined where they touch: place, item, and number of spans of each (place,
    item), then first and end of all spans. One item's windows are of one length."""
    order = np.lexsort((first, item, place))
    place, item, first, end = place[order], item[order], first[order], end[order]
    group = np.ones(len(place), bool)
    group[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
    begins = group.copy()
    begins[1:] |= first[1:] > end[:-1]
    at = np.flatnonzero(begins)
    ends = end[np.append(at[1:], len(end))[: len(at)] - 1]
    heads = np.flatnonzero(group)
    each = np.diff(np.append(np.searchsorted(at, heads), len(at)))
    return place[heads], item[heads], each, first[at], ends


def matches(index: DataFrame, wanted: Phrases, slack: int = 0) -> DataFrame:
    """One row for each document and item of which a window occurs there: the spans of its
    words that occurrences cover. With slack, the place a window would have without it."""
    if not 0 <= slack < _GAP - wanted.windows.shape[1]:
        raise ValueError(f"slack must be from 0 to {_GAP - wanted.windows.shape[1] - 1}")
    spark = index.sparkSession
    # At most the different words of one block.
    vocabulary = local_rows(spark, term=pa.array(wanted.terms, pa.string()))
    counts = dict(map(tuple, term_counts(index).join(F.broadcast(vocabulary), "term", "left_semi").collect()))
    often = np.array([counts.get(t, 0) for t in wanted.terms] + [1 << 60])
    found = (often[wanted.windows] > 0).all(1)
    windows, owners = wanted.windows[found], [o for o, f in zip(wanted.owners, found) if f]
    order = np.argsort(often[windows], 1, kind="stable")
    sent = spark.sparkContext.broadcast((np.take_along_axis(windows, order, 1), order, owners, wanted.items, wanted.terms))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, offsets, owners, items, terms = sent.value
        numbers = {t: i for i, t in enumerate(terms)}
        lengths = (rows >= 0).sum(1)
        sizes = np.array([len(o) for o in owners], np.int64)
        heads = np.cumsum(sizes) - sizes
        owner = np.array([i for o in owners for i in o], np.int64)
        for batch in batches:
            for shard in batch.to_pylist():
                own = [numbers.get(t, -1) for t in shard["terms"]]
                position = np.frombuffer(shard["positions"], "<u4").astype(np.int64)
                keys = np.repeat(np.array(own, np.int64), shard["counts"]) << 32 | position
                keys = np.sort(keys[keys >= 0])
                if not len(keys) or not len(rows):
                    continue
                which, start = intersect(keys, rows, offsets, slack)
                words = np.array(shard["doc_words"], np.int64)
                begins = np.cumsum(words) - words + _GAP * (1 + np.arange(len(words)))
                place = np.searchsorted(begins, start + slack, side="right") - 1
                end = np.minimum(start - begins[place] + lengths[which], words[place])
                first = np.maximum(start - begins[place], 0)
                many = sizes[which]
                item = owner[np.repeat(heads[which] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                place, item, each, first, end = spans(np.repeat(place, many), item, np.repeat(first, many), np.repeat(end, many))
                if len(place):
                    flat = pa.StructArray.from_arrays([pa.array(first), pa.array(end)], fields=list(_SPAN))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(each)), pa.int32()), flat)
                    out = [[shard["shard"]] * len(place), place, [shard["doc_ids"][p] for p in place], [items[i] for i in item], lists]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if c is not lists else c for c, f in zip(out, _MATCH_ARROW)], schema=_MATCH_ARROW)

    return index.mapInArrow(search, MATCH_SCHEMA)


def find(documents: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """The documents as the index has them (shard, place, doc_id, n_words), and the matches.

    A test set of one block gets an index of its own terms, a larger one an index of all.
    """
    blocks = test_blocks(items)
    first, second = next(blocks, []), next(blocks, None)
    wanted = phrases(first, size)
    index = positional_index(documents, wanted.terms if second is None else None)
    found = matches(index, wanted, slack)
    for block in itertools.chain([second] if second else [], blocks):
        found = found.unionByName(matches(index, phrases(block, size), slack))
    listed = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("place", "d"))
    return listed.select("shard", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words")), found


def covered(spans_: Column) -> Column:
    """Number of words in any of the spans."""
    step = F.aggregate(
        F.array_sort(spans_),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"),
            (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["first"]), F.lit(0).cast("long"))).alias("n"),
        ),
    )
    return step["n"]


def judged(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with n_words, n_hit, item_ids (sorted) and contaminated: at least one
    word of twenty is inside an occurrence of a window."""
    docs, found = find(documents, items)
    hits = found.groupBy("shard", "place").agg(
        covered(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    return docs.join(hits, ["shard", "place"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


@own_names
def clean_documents(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bad = judged(documents.select(key.alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias("__bad"))
    keyed = documents.withColumn("__key", key)
    return keyed.join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all of ``benchmark``."""
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP10_SQL = f"""
with items as (
  select cast(item_id as varchar) as item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
docs as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from (select *, least(len(w), {WINDOW}) as n from items where len(w) > 0))),
placed as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from docs, (select distinct n from windows) where len(w) >= n)),
found as (select doc_id, item_id, i, n from placed join windows using (n, t)),
hit as (
  select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
named as (
  select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids
  from found group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)"""
