"""Decontamination against brute force."""

import re

import numpy as np

from keyfold.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, size=13):
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(size, len(v))
            for window in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == window:
                        hit |= set(range(i, i + n))
                        named.add(item)
        out.append((doc, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


LONG = " ".join(f"w{i % 37}x{i % 11}" for i in range(60))
DOCS = [
    (1, None), (2, ""), (3, " ,. "), (4, LONG), (5, LONG.upper() + "!" + LONG), (5, LONG.upper() + "!" + LONG), (None, "Über-Größe é a b"),
    (6, "a a a a b"), (7, " ".join(LONG.split()[3:15])), (8, "z " * 3000 + " ".join(LONG.split()[3:16]) + " q" * 300), (9, "x\0y GRÖSSE größe"),
]
ITEMS = [("i1", LONG), ("i2", "a a"), ("i10", "größe"), ("i3", None), ("i4", "...'"), (None, "x y"), ("i1", "a b"), ("i5", "absent words")]


def frames(spark):
    docs = [(i, t, "s", 1) for i, t in DOCS]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, item_id string, n_words int").repartition(3),
        spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id string, text string, doc_id int"),
    )


def test_hostile_rows(spark, monkeypatch):
    docs, items = frames(spark)
    expected = brute(DOCS, [(i or "", t) for i, t in ITEMS])
    assert sorted((tuple(r) for r in d.judged(docs, items).collect()), key=repr) == expected
    monkeypatch.setattr(d.test_blocks, "__defaults__", (8,))  # each item a block of its own
    assert sorted((tuple(r) for r in d.judged(docs, items).collect()), key=repr) == expected
    assert d.judged(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in d.judged(docs, items.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two big three"), (2, "one two three"), (3, "three x x x x one two")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    near = {s: sorted(r.doc_id for r in d.find(docs, items, slack=s)[1].collect()) for s in (0, 1, 7)}
    assert near == {0: [2], 1: [1, 2], 7: [1, 2, 3]}


def test_intersection_takes_every_window():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 4, 500)
    keys = np.sort((text << 32) + np.arange(500) + 64)
    windows = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    which, start = d.intersect(keys, windows, np.tile(np.arange(3), (64, 1)))
    assert sorted(start - 64) == list(range(498))
    assert all((text[s - 64 : s - 61] == windows[w]).all() for w, s in zip(which, start))
