"""Packing of token sequences by cutting-stock column generation.

A document's ids are cut into whole sequences, one piece that is a multiple of ``unit``
tokens, and a tail of fewer than ``unit`` tokens. So there are at most
``2 * unit + capacity / unit`` different lengths, whatever the corpus. Their histogram is the demand of a
cutting-stock problem: a linear program over patterns (how many pieces of each length
share a sequence), whose columns are priced by a knapsack dynamic program. The rounded
patterns are dealt to the pieces by their rank within their length.

Defined results: a null text is an empty one; a document always has the end id, so it has
at least one token and one piece. Repeated rows are packed each for themselves. An empty
table gives an empty table. Columns besides the id and the text are not looked at.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import LOWER, byte_set, flat_bytes, local_rows, materialize, per_worker, ranked, slices, small_batches, table

CAPACITY = 2048
UNIT = 64
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
_CACHED = 150_000  # words a worker remembers before it starts afresh
_LONG_WORD = 64  # bytes; longer ones are not remembered


_PARTS = byte_set((0x20, 0x20), (0x0A, 0x0A))
_PUNCTUATION = byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_LATIN = byte_set((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF))  # after 0xC3: letters
_LETTERS = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+")


def word_bounds(data: np.ndarray, bounds: np.ndarray, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of every word: a run without space or newline, of which a last run
    of punctuation after a letter or digit is a word of its own if ``apart``."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = _PARTS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    inside = ~gap[:-1]
    first = inside.copy()
    first[1:] &= gap[:-2] | edge[1:-1]
    mark = _PUNCTUATION[data]
    begins = mark.copy()
    begins[1:] &= ~mark[:-1] | edge[1:-1]
    ends = mark & (~np.append(mark[1:], False) | edge[1:])
    runs, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    ok = (gap[last] | edge[last]) & (runs > 0) & ~edge[runs]
    runs = runs[ok]
    latin = (data[np.maximum(runs - 2, 0)] == 0xC3) & _LATIN[data[runs - 1]]
    runs = runs[_ALNUM[data[runs - 1]] | latin]
    first[runs] |= apart
    starts = np.flatnonzero(first)
    # A word ends where a gap, a text or another word begins.
    stops = np.flatnonzero((gap | edge | np.append(first, True))[1:] & inside) + 1
    return starts, stops


class WordTokenizer:
    """Ids of whole texts, found word by word.

    The tokenizer drops white space and never joins across it, nor letters or digits with
    punctuation that ends a run, so a text's ids are those of its words one after another,
    and a word met before need not be encoded again. It also lowers all letters, so A-Z may
    be lowered first. Texts that may hold the string of a special token are only cut at
    spaces and newlines.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        self._encode = coder.encode_batch_fast
        self._known: dict[bytes, bytes] = {}
        self._ends = np.zeros(coder.get_vocab_size() + 1, bool)
        self._ends[[i for t, i in coder.get_vocab().items() if t.endswith("</w>")]] = True

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. Words of letters only end with the first token that ends a word,
        so many can be encoded at a time."""
        plain, other = [], []
        for w in words:
            text = w.decode()
            (plain if _LETTERS.fullmatch(text) else other).append((w, text))
        found = {}
        if plain:
            ids = np.array(self._encode([" ".join(t for _, t in plain)], add_special_tokens=False)[0].ids, "<u4")
            at = [0, *(np.flatnonzero(self._ends[ids]) + 1).tolist()]
            if len(at) - 1 == len(plain):
                raw = ids.tobytes()
                found = {w: raw[4 * a : 4 * b] for (w, _), a, b in zip(plain, at, at[1:])}
            else:
                other += plain
        codes = self._encode([t for _, t in other], add_special_tokens=False)
        return found | {w: np.array(e.ids, "<u4").tobytes() for (w, _), e in zip(other, codes)}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        known = self._known
        if len(known) > _CACHED:
            known.clear()
        new = [w for w in words if w not in known]
        for at in range(0, len(new), 20_000):
            known |= self._fresh([w for w in new[at : at + 20_000] if len(w) <= _LONG_WORD])
        long = self._fresh([w for w in new if len(w) > _LONG_WORD])
        return [known[w] if len(w) <= _LONG_WORD else long[w] for w in words]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text among them."""
        data, bounds = flat_bytes(texts)
        if not len(data):
            return np.empty(0, np.uint32), bounds
        special = b"<|" in data.tobytes()
        data = data if special else LOWER[data]
        starts, stops = word_bounds(data, bounds, not special)
        inside = ~_PARTS[data]
        kept = data[inside]
        offsets = np.append(0, np.cumsum(stops - starts)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        coded = words.dictionary_encode()
        ids = self._ids(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        begins = np.cumsum(sizes) - sizes
        words = coded.indices.to_numpy()
        n = sizes[words]
        ends = np.cumsum(n)
        at = np.repeat(begins[words] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return flat[at], np.concatenate(([0], ends))[np.searchsorted(starts, bounds)]


def _tokenizer(name: str) -> WordTokenizer:
    import public_tokenizers

    return per_worker(("words", name), lambda: WordTokenizer(public_tokenizers.path(name)))


def encode(texts: pa.Array, name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """Ids of each text with the end id; a long text is encoded in stretches."""
    coder = _tokenizer(name)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if len(texts) > 1:
        ids, bounds = coder(texts)
        for i in range(len(texts)):
            yield np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(END_ID))
        return
    for text in texts.to_pylist():
        parts, begin = [], 0
        while begin < len(text):
            end = text.find(" ", begin + (1 << 20))
            end = len(text) if end < 0 else end
            parts.append(coder(pa.array([text[begin:end]]))[0])
            begin = end
        yield np.append(np.concatenate(parts or [np.empty(0, np.uint32)]), np.uint32(END_ID))


def cuts(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """Where ``n`` tokens are cut: whole sequences, a multiple of ``unit``, a tail."""
    return sorted({*range(0, n + 1, capacity), n - n % unit, n})


def pieces(
    documents: DataFrame, with_ids: bool = True, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, unit: int = UNIT
) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and the
    ids themselves as little-endian 32-bit numbers unless ``with_ids`` is false."""
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    kinds += [("ids", pa.binary())] * with_ids
    schema = pa.schema(kinds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[list] = [[] for _ in kinds]
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"], tokenizer)):
                    at = cuts(len(ids), capacity, unit)
                    for begin, end in itertools.pairwise(at):
                        raw = ids[begin:end].astype("<u4").tobytes()
                        row = (doc, begin, end - begin, zlib.crc32(raw), len(ids), raw)
                        for column, value in zip(out, row):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(out, kinds)], schema=schema)

    columns = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    spark_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return small_batches(columns).mapInArrow(cut, spark_schema)


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of a sequence that is worth most, by dynamic programming over its room.

    ``lengths`` ascend."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        if k := fitting[room]:
            gain = value[room - lengths[:k]] + worth[:k]
            i = gain.argmax()
            if gain[i] > value[room] + 1e-12:
                value[room], taken[room] = gain[i], i
    pattern, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= lengths[taken[room]]
    return float(pattern @ worth), pattern


def column_generation(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they use every piece exactly once.

    Revised simplex on the covering program, one basis column per length. The solution is
    rounded down and what is left is filled greedily, longest first.
    """
    if not len(lengths):
        return []
    counts = counts.astype(np.int64)
    basis = np.diag(capacity // lengths).astype(float)
    inverse = np.linalg.inv(basis)
    for turn in range(1, rounds + 1):
        gain, pattern = best_pattern(lengths, np.maximum(inverse.sum(0), 0), capacity)
        if gain <= 1 + 1e-9:
            break
        used, change = inverse @ counts, inverse @ pattern
        ratio = np.where(change > 1e-9, used / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        if turn % 50:
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
        else:  # afresh, so that errors do not add up
            inverse = np.linalg.inv(basis)
    used = np.linalg.solve(basis, counts)
    plan, left = [], counts.copy()
    for column, times in zip(basis.T.round().astype(np.int64), np.floor(used + 1e-9).astype(np.int64)):
        times = min([times, *(left[column > 0] // column[column > 0])])
        if times > 0:
            plan.append((column, int(times)))
            left -= times * column
    while left.any():
        column, room = np.zeros_like(left), capacity
        for i in np.argsort(-lengths, kind="stable"):
            column[i] = min(left[i], room // lengths[i])
            room -= column[i] * lengths[i]
        times = int((left[column > 0] // column[column > 0]).min())
        plan.append((column, times))
        left -= times * column
    return plan


def pattern_rows(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a sequence, first sequence, offset) for each
    length of each pattern: which ranks of that length it takes, and where they go."""
    out, taken, sequence = [], dict.fromkeys(lengths.tolist(), 0), 0
    for column, times in plan:
        offset = 0
        for n, each in zip(lengths.tolist(), column.tolist()):
            if each:
                out.append((n, taken[n], taken[n] + each * times, each, sequence, offset))
                taken[n] += each * times
                offset += each * n
        sequence += times
    return out


def pack(
    documents: DataFrame, with_ids: bool = True, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, unit: int = UNIT
) -> DataFrame:
    """Every piece with its place: the columns of :func:`pieces`, ``sequence_id``, ``offset``.

    To the driver comes the histogram, of at most ``2 * unit + capacity / unit`` rows; the patterns that
    go back are at most twice as many.
    """
    spark = documents.sparkSession
    cut = materialize(pieces(documents, with_ids, tokenizer, capacity, unit), "pieces")
    histogram = sorted(map(tuple, cut.groupBy("length").count().collect()))
    lengths = np.array([n for n, _ in histogram], np.int64)
    plan = column_generation(lengths, np.array([n for _, n in histogram], np.int64), capacity)
    rows = pattern_rows(lengths, plan)
    columns = zip(*rows) if rows else [()] * 6
    places = local_rows(spark, **{k: pa.array(c, pa.int64()) for k, c in zip(("length", "first", "end", "each", "sequence", "base"), columns)})
    at = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "__rank")
    inside = F.col("__rank") - F.col("first")
    return (
        at.join(F.broadcast(places), "length")
        .where("__rank >= first and __rank < end")
        .withColumn("sequence_id", F.col("sequence") + F.floor(inside / F.col("each")))
        .withColumn("offset", F.col("base") + F.pmod(inside, F.col("each")) * F.col("length"))
        .drop("__rank", "first", "end", "each", "sequence", "base")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; each piece's digest and place."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
