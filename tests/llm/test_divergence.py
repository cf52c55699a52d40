"""The audit against a plain count over every source and kept term."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyfold.llm import divergence as m

SCHEMA = "doc_id long, text string, lang string, source string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        count = lambda s, t: counts[lang, s][t]
        others = sorted(s for g, s in groups if g == lang)

        def price(n, total):
            return 1 + 10**9 * (n + 2) // (total + 2 * len(kept))

        total = {s: sum(count(s, t) for t in kept) for s in others}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = []
        for other in others:
            if other != source:
                value = sum(f(price(count(source, t), total[source]), price(count(other, t), total[other])) for t in kept)
                pairs.append((-value, other.encode(), other))
        out += [(lang, source, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
        words = []
        for t in kept:
            p, q = price(count(source, t), total[source]), price(sum(count(s, t) for s in others), sum(total.values()))
            if count(source, t) > 0 and p > q:
                words.append((-f(p, q), t.encode(), t))
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(words)[:top])]
    return sorted(out)


def check(spark, rows, **more):
    found = m.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), **more)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(rows, **more)


def corpus(seed, n=300, sources=5):
    rng = random.Random(seed)
    words = ["Word", "é", "naïve", "日本", "x", "the", "The", "THE", "a1b", "don't", "É", *(f"w{chr(97 + i)}" for i in range(20))]
    text = lambda: " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(rng.randrange(40)))
    return [(i, text(), rng.choice(["en", "de"]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}") for i in range(n)]


def test_equals_plain_counts(spark):
    check(spark, corpus(1))
    check(spark, corpus(2), least=1, top=3)


@pytest.mark.parametrize("sources, entries, columns", [(2, 7, 9), (3, 1000, 4), (64, 20, 1024)])
def test_blocks_of_terms_and_sources(spark, monkeypatch, sources, entries, columns):
    for name, value in (("SOURCES", sources), ("ENTRIES", entries), ("COLUMNS", columns)):
        monkeypatch.setattr(m, name, value)
    check(spark, corpus(3, 200, 9), least=2)


def test_odd_rows(spark):
    rows = [
        (1, None, "en", "a"), (2, "", "en", "b"), (None, "word word", None, None), (None, "word word", None, None), (3, "word", "", "c"), (3, "word", "", "c"),
        (4, "12 34 _`{", "xx", "alone"), (5, "Word\x00wOrd", "en", "é"), (6, "ÉÉ é", "en", "é"), (7, "w" * 70000, "en", "a"), (8, "long " * 50000, "en", "a"),
    ]
    check(spark, rows, least=1)
    check(spark, rows, least=2)
    check(spark, rows)  # no kept terms: every pair has the value 0


def test_empty_table_and_other_columns(spark):
    assert m.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = corpus(4, 60)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "n", "docs", "words", "terms", "blocks", "value", "rank", "p")})
    assert sorted(map(tuple, m.audit(clash, 3).collect())) == brute(rows, 3)


def test_joint_tables_hold_every_term(spark):
    rows = corpus(5)
    own = spark.createDataFrame(rows, SCHEMA).select("lang", "source", "text")
    kept, langs = m.kept_terms(m.term_counts(own), 1)
    groups = m.sized_groups(own, kept, langs)
    sums = {(r.lang, r.one, r.two): r.n for r in m.joint_tables(kept, groups).groupBy("lang", "one", "two").agg(F.sum("terms").alias("n")).collect()}
    terms = {r.lang: r.terms for r in langs.collect()}
    of = defaultdict(list)
    for r in groups.collect():
        of[r.lang].append(r.source)
    assert sums == {(lang, *pair): terms[lang] for lang, names in of.items() for pair in itertools.combinations(sorted(names), 2)}


def test_block_product_is_the_matrix_product():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (30, 3))
    rows = [("t%d" % t, "s%d" % s, int(n)) for t, line in enumerate(counts) for s, n in enumerate(line) if n]
    rows += [(None, f"s{s}", 0) for s in range(3)]
    present = counts.any(1)
    table = pa.table({
        "lang": ["en"] * len(rows), "term": pa.array([r[0] for r in rows], pa.string()), "source": [r[1] for r in rows], "n": [r[2] for r in rows],
        "p": [10 * r[2] + 1 for r in rows], "column_block": [0] * len(rows), "block": [0] * len(rows), "terms": [int(present.sum())] * len(rows), "low": [0] * len(rows), "high": [0] * len(rows),
    })
    found = {(r["one"], r["level_one"], r["two"], r["level_two"]): r["terms"] for r in m.block_product(table).to_pylist()}
    for i, j in itertools.combinations(range(3), 2):
        for a, b in itertools.product(range(4), range(4)):
            times = int(((counts[:, i] == a) & (counts[:, j] == b) & present).sum())
            assert found.get((f"s{i}", a, f"s{j}", b), 0) == times


def test_large_counts_do_not_overflow(spark):
    row = spark.range(1).select(m.price(F.lit(10**17), F.lit(2 * 10**17), F.lit(5)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**17 + 2) // (2 * 10**17 + 10)
