"""Edit-aware counts against encoding the whole text."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from keyfold.llm import token_counts as t

CODE = t.coder(t.VOCABULARY)


def total(text):
    return len(CODE(text))


@settings(max_examples=120, deadline=None)
@given(
    st.text("ab'st \n1é.", max_size=300),
    st.lists(st.tuples(st.integers(0, 320), st.integers(0, 80), st.text("a's  \n2.", max_size=50)), max_size=6),
)
def test_edits_keep_the_count(text, edits):
    tree = t.build(text, CODE, size=3)
    assert tree.total == [len(text), total(text)]
    for start, removed, inserted in edits:
        s = min(start, len(text))
        expected = text[:s] + inserted + text[min(s + removed, len(text)) :]
        text, _ = t.edit(text, tree, start, removed, inserted, CODE, size=3)
        assert text == expected and tree.total == [len(text), total(text)]
        assert tree.levels == t.Tree(tree.leaves).levels


def test_small_edits_read_little():
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "beta", "gamma,", "x1"]) for _ in range(30_000))
    tree = t.build(text, CODE)
    for _ in range(40):
        text, read = t.edit(text, tree, rng.randrange(len(text)), rng.randrange(30), " new words" * rng.randrange(3), CODE)
        assert read < 1500
    assert tree.total == [len(text), total(text)]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 300])
def test_find(n):
    leaves = [(1 + i % 3, 1) for i in range(n)]
    tree, begin = t.Tree(leaves), 0
    for i, (size, _) in enumerate(leaves):
        assert all(tree.find(begin + k) == (i, begin) for k in range(size))
        begin += size


def test_hostile_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Hello there, world"), (2, None), (3, ""), (None, "no id"), (1, "other row"), (1, "other row"), (4, "long " * 40_000), (5, "no edits")],
        "doc_id long, text string",
    ).selectExpr("*", "1 as seq", "'x' as leaves", "2 as hash")
    edits = spark.createDataFrame(
        [(1, 2, 0, 5, "Bye"), (1, 1, 100, 9, "!"), (2, 1, 0, 3, "abc"), (3, None, None, None, None), (4, 1, 7, 2, "?"), (99, 1, 0, 0, "x"), (None, 1, 0, 1, "y")],
        "doc_id long, seq long, start long, removed long, inserted string",
    )
    planted = t.trees(docs)
    got = sorted(((r.doc_id, r.text, r.n_edits, r.tokens_before) for r in t.counted_after(docs, edits, planted).collect()), key=repr)
    other = (1, "Bye row!", 2, total("other row"))
    expected = [
        (1, "Bye there, world!", 2, total("Hello there, world")), other, other, (2, "abc", 1, 0), (3, "", 1, 0), (None, "no id", 0, total("no id")),
        (4, ("long " * 40_000)[:7] + "?" + ("long " * 40_000)[9:], 1, total("long " * 40_000)), (5, "no edits", 0, total("no edits")),
    ]
    assert got == sorted(expected, key=repr)
    assert all(r.tokens_after == total(r.text) for r in t.counted_after(docs, edits, planted).collect())
    assert t.counted_after(docs.limit(0), edits, planted).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    edits = sorted((r.doc_id, r.seq, r.start, r.removed, r.inserted) for r in t.revisions(docs).collect())
    before = {i: total(x) for i, x in text.items()}
    for i, _, start, removed, inserted in edits:
        text[i] = text[i][:start] + inserted + text[i][start + removed :] if start <= len(text[i]) else text[i] + inserted
    found = {r.doc_id: (r.tokens_before, r.tokens_after, r.n_edits, r.n_chars) for r in t.op4_token_counts(spark, sf_dir).collect()}
    assert found == {i: (before[i], total(x), t.EDITS, len(x)) for i, x in text.items()}


def test_edits_with_one_seq_have_an_order(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    schema = "doc_id long, seq long, start long, removed long, inserted string"
    edits = [(1, 1, 4, 3, "2"), (1, 1, 4, 3, "zwei"), (1, 1, 0, 3, "uno"), (1, None, 0, 1, ""), (1, 1, 0, 0, "a ")]
    planted = t.trees(docs)
    found = {t.counted_after(docs, spark.createDataFrame(x, schema).coalesce(1), planted).first().text for x in (edits, edits[::-1])}
    text = "one two three"
    for start, removed, inserted in [(0, 0, "a "), (0, 3, "uno"), (4, 3, "2"), (4, 3, "zwei"), (0, 1, "")]:
        text = text[:start] + inserted + text[start + removed :]
    assert found == {text}
