"""Suffix deduplication against brute force."""

import hashlib
import random

import pytest

from keyfold.llm import suffix_dedup as s


def brute(docs, length):
    """docs: (id, text) in the order that counts."""
    seen, out = set(), []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(frame, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in s.deduplicated(frame, **more).collect()), key=repr)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéf") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randint(5, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.25 and docs:
            words = docs[rng.randrange(len(docs))][1].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            t = " ".join(words)
        elif kind < 0.35:
            t = rng.choice(["ab", "xyz ", "q"]) * rng.randint(1, 400)
        else:
            t = text(rng.randint(0, 80)) + rng.choice(shared) + text(rng.randint(0, 30)) + rng.choice(shared)
        docs.append((i, t))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, seed):
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(frame) == brute(docs, 100)


def test_small_units_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "UNIT_BYTES", 150)
    monkeypatch.setattr(s, "BLOCK_BYTES", 300)
    monkeypatch.setattr(s, "PART_RUNS", 3)
    docs = corpus(7, 25)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert found(frame, length=24, gram=6) == brute(docs, 24)


def test_hostile_rows(spark):
    t = "The quick brown fox jumps over the lazy dog, and so on. " * 2
    rows = [(5, t), (5, t), (None, t), (1, t + "x"), (2, None), (3, ""), (None, None), (7, "y" * 99), (8, "z" * 300_000), (5, "!" + t), (-4, "é" * 50)]
    frame = spark.createDataFrame([(i, x, "s", 1, 2) for i, x in rows], "doc_id long, text string, kept string, id long, start int")
    got = found(frame)
    assert [r[:3] for r in got if r[0] in (1, 7, 8, -4)] == [(-4, 100, 0), (1, 113, 0), (7, 99, 0), (8, 300_000, 299_999 + 1 - 1)]
    assert [r[1:3] for r in got if r[0] == 5].count((112, 112)) == 2 and (5, 113, 112) in [r[:3] for r in got]
    assert sorted(r[1:3] for r in got if r[0] is None) == [(0, 0), (112, 112)] and len(got) == len(rows)
    assert s.deduplicated(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(map(tuple, s.op5_suffix_dedup(spark, sf_dir).collect()), key=repr) == brute(docs, 100)
