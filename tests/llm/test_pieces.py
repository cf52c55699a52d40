"""Ids and decoded texts against the library's own, text by text."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from keyfold.llm import pieces as m

MODEL = public_tokenizers.path(m.MODEL)
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(spark, library, rows, **more):
    encoded = m.encode(spark.createDataFrame(rows, SCHEMA).repartition(3), MODEL, **more)
    found = sorted(((r.doc_id, list(r.ids), r.decoded) for r in encoded.collect()), key=repr)
    ids = [library.encode(t or "") for _, t in rows]
    assert found == sorted(((d, i, library.decode(i) if i else "") for (d, _), i in zip(rows, ids)), key=repr)


ODD = [
    "", " ", "  ", "   ", "a", " a", "a ", "  a  b   ", "▁", "▁▁a", "a▁ b", "\n", "a\nb\r\n\tc", "\x00", "a\x00 b", "　x  y",
    "日本語 テキスト", "🙂 🙂🙂‍ x", "�", "<s> </s> <unk> <0x41>", "é é", "x" * 5000, " " * 100, "don't  stop", "\U0010ffff ퟿", "ﬁ Ⅳ １２",
]


def test_odd_texts(spark, library):
    check(spark, library, [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "a b"), (7, "again"), (7, "again"), (8, None)])


def test_random_texts(spark, library):
    rng = random.Random(5)
    signs = " " * 6 + "▁\n\tabcdefghij.,'-éß日本🙂\x00\x7f" + "the and ing"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(60)))) for i in range(500)]
    check(spark, library, rows)


def test_slices_and_long_texts(spark, library, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(30))) for i in range(200)] + [(900, text(60_000)), (901, "ab" * 200_000)]
    check(spark, library, rows, most=500, size=40)
    check(spark, library, rows, size=0)
    check(spark, library, rows)


def test_the_table_holds_each_frequent_chunk_once(spark):
    rows = [(i, "a b " * (i % 3) + f"only{i} twice twice" + " c" * 5000) for i in range(9)]
    counts = m.chunk_counts(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert {r.chunk: r.n for r in counts.collect()} == {" a": 9, " b": 9, " twice": 18, " c": 45000}
    assert [sorted(r.chunk for r in m.frequent(counts, n).collect()) for n in (0, 1, 2, 3, 9)] == [[], [" c"], [" c", " twice"], [" c", " twice"], [" a", " b", " c", " twice"]]
    table = m.chunk_table(counts.union(counts), MODEL).collect()
    assert sorted(r.chunk for r in table) == [" a", " b", " c", " twice"] and all(" " + r.decoded == r.chunk for r in table)


def test_decode_is_the_librarys(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)]
    found = m.encode(spark.createDataFrame(rows, SCHEMA), MODEL)
    both = found.join(m.decode(found, MODEL), "doc_id").where("decoded <> text")
    assert both.count() == 0


def test_empty_table_and_other_columns(spark, library):
    assert m.encode(spark.createDataFrame([], SCHEMA), MODEL).collect() == []
    clash = spark.createDataFrame([(1, "a b")], SCHEMA).withColumns({c: F.lit(1) for c in ("slice", "at", "chunk", "ids", "decoded", "kind", "docs")})
    (row,) = m.encode(clash, MODEL).collect()
    assert list(row.ids) == library.encode("a b")


def test_a_model_that_crosses_words_is_refused(monkeypatch):
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, i):
            return "a▁b"

    monkeypatch.setattr(m.sentencepiece, "SentencePieceProcessor", lambda model_file: Crossing())
    with pytest.raises(ValueError, match="crosses"):
        m.load("other.model")


def test_query(spark, library, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = m.op13_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else ""))
