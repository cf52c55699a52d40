"""Packing: ids, cuts, places and little padding."""

import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from keyfold.llm import packing


def test_ids_of_real_texts(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].combine_chunks()
    assert [x.tolist() for x in packing.encode(texts)] == [plain_ids(t) for t in texts.to_pylist()]


@functools.cache
def coder():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def plain_ids(text):
    return coder().encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


TEXTS = [
    "", None, " ", "a", "It's  a\tb\n\nc don't WE'LL", "　x y\u0085z", "Ångström é ́x", "<|endoftext|> a<|startoftext|>b",
    "ΟΔΥΣΣΕΥΣ Σ ς", "日本語 テキスト", "word " * 5000, "x" * 3000, "0123 45.6!?", "İstanbul ﬁ ퟿", "a\rb\x0bc\x0cd",
    "end. end, (end) end!!! élan. naïve? 3× 2÷, x×. ñ| a|b| don't. it's, o'clock' 'tis rock'n'roll. ,", "İ. A̐! Å, e\u0301. x\u0301, >\u0338 a>\u0338",
    "<|ENDOFTEXT|> A.", "Word. word, WORD: wOrd; É. È, ß. ø! þ÷.", "a.", ".", "..", ". .", "¿qué? «sí». \x00. \x7f.",
]


def test_ids_equal_those_of_the_whole_text():
    found = [x.tolist() for x in packing.encode(pa.array(TEXTS))]
    assert found == [plain_ids(t) for t in TEXTS]
    assert [next(iter(packing.encode(pa.array([t])))).tolist() for t in TEXTS[1:]] == found[1:]


def test_ids_of_a_text_encoded_in_stretches():
    # Beyond 1 Mi characters: cut at blanks, with a run of signs and no blank at the first cut.
    text = "don't stop, 12 words. " * 47_600 + "x" * 3_000 + "\n" * 2_000 + " É. end|a " * 60_000
    assert next(iter(packing.encode(pa.array([text])))).tolist() == plain_ids(text)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 2047, 2048, 2049, 2112, 5000])
def test_cuts(n):
    at = packing.cuts(n)
    assert at[0] == 0 and at[-1] == n and all(0 < b - a <= 2048 for a, b in zip(at, at[1:]))


def test_column_generation_uses_each_piece_once_and_is_near_the_bound():
    rng = np.random.default_rng(7)
    lengths = np.array([*range(1, 64), *range(64, 2048, 64)])
    counts = rng.integers(1, 400, len(lengths))
    plan = packing.column_generation(lengths, counts, 2048)
    assert (sum(c * n for c, n in plan) == counts).all()
    assert all(c @ lengths <= 2048 for c, _ in plan)
    assert sum(n for _, n in plan) <= -(-int(lengths @ counts) // 2048) + 3


def test_hostile_rows(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(0, "", 1), (0, "", 1), (None, "a b", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    found = packing.pack(docs).collect()
    spans = defaultdict(list)
    for r in found:
        spans[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for s in spans.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048
    got = defaultdict(list)
    for r in found:
        got[r.doc_id].append((r.start, bytes(r.ids)))
    for i, t in enumerate(TEXTS):
        ids = b"".join(raw for _, raw in sorted(got[i])[-1 if i == 0 else 0 :])
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(t)
    assert len(got[0]) == 3 and len(got[None]) == 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    found = packing.op8_packing(spark, sf_dir).toPandas()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for doc, own in found.groupby("doc_id"):
        raw = np.array(plain_ids(docs[doc]), "<u4")
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(raw)
        assert own.ids_crc32.tolist() == [zlib.crc32(raw[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    assert set(docs) == set(found.doc_id)
    used = found.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and len(used) <= -(-int(used.sum()) // 2048) + 3
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
