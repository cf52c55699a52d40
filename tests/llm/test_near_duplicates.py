"""Near duplicates against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from keyfold.llm import near_duplicates as nd
from keyfold.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n, percent=80):
    """docs: (id, text) with different ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def found(frame, *args):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame, *args).collect()), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "C", "ü", "x."]) + str(rng.randrange(60))
    docs, passage = [], [word() for _ in range(40)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.55 and docs:
            words = docs[rng.randrange(max(0, len(docs) - 12), len(docs))][1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 9))):
                words[rng.randrange(len(words))] = word()
            docs.append((i, " ".join(words)))
        else:
            docs.append((i, " ".join([word() for _ in range(rng.randint(0, 60))] + passage * (kind > 0.85))))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed,crowd", [(0, 64), (1, 0), (2, 64)])
def test_random_corpora(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(nd, "CROWD", crowd)
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    n = 5 if seed == 2 else 2
    assert found(frame, n) == sorted(brute(docs, n), key=repr)


def test_hostile_rows(spark):
    rows = [(4, "a b c"), (4, "a b c"), (3, "A  B\tC"), (None, "a b c"), (1, None), (0, ""), (2, " \n"), (7, "one"), (6, "ONE"), (9, "w " * 50_000), (8, "w w"), (4, "other text here")]
    frame = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id long, text string, id long, component int")
    got = found(frame, 2)
    # No words: its own component, kept. Same id and text: the same row twice.
    expected = [
        (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False), (None, 2, 3, False), (1, 0, 1, True), (0, 0, 0, True), (2, 0, 2, True),
        (7, 1, 6, False), (6, 1, 6, True), (9, 1, 8, False), (8, 1, 8, True), (4, 2, 4, True),
    ]
    assert got == sorted(expected, key=repr)
    assert nd.near_duplicates(frame.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_posterior():
    assert nd.chance(0, 0, 0.8) == pytest.approx(0.2)
    assert nd.chance(200, 200, 0.8) > 0.999999 and nd.least_matches(20, 0.8) <= 5
    rng = np.random.default_rng(0)
    a = rng.integers(0, 9, (2000, nd.BANDS * nd.ROWS))
    b = np.where(rng.random(a.shape) < 0.8, a, 99)
    assert nd.compare(a, b, 0.8)[0].all()
    survive, near = nd.compare(a, np.where(rng.random(a.shape) < 0.15, a, 99), 0.8)
    assert not survive.any() and not near.any()


def test_signatures_estimate_similarity():
    words = [f"w{i}" for i in range(400)]
    texts = pa.array([" ".join(words[:300]), " ".join(words[100:400])])
    sets, bounds = nd.shingle_sets(texts, 1)
    a, b = (set(sets[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
    assert len(a & b) / len(a | b) == 0.5


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, nd.op7_near_duplicates(spark, sf_dir).collect()), key=repr) == sorted(brute(docs, 2), key=repr)
