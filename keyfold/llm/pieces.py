"""SentencePiece encoding and decoding over a table of distinct chunks.

White space is a marker to a SentencePiece model, and a byte-pair model whose pieces have
markers at their beginning only can never join what stands on both sides of a word's end.
A text is therefore a row of *chunks*, each one or more markers and the word after them,
which are segmented by themselves.

1. Chunks are counted over all documents, those that a slice of documents holds once aside.
   The most frequent make the distinct-chunk table, as many as ``TABLE`` at most: the least
   count is found in a histogram of all counts. Each of them is segmented once, and its ids
   decoded once; the table has a proven bound (``TABLE`` chunks of ``LONGEST`` characters) and
   goes to every worker.
2. Documents are cut again in slices. A slice takes the ids of its distinct chunks from
   the table, segments each that is not there once, and joins the ids back to its documents by
   position. What is not in the table is rare, and as a rule in one slice only.

Moving every slice's chunks to a table of all of them, and every position back, was built
first: with a vocabulary that grows with the texts it moves more than the texts themselves.
A task holds one slice; a longer text is a slice of its own.

Defined results: a null text is an empty one, without ids, and decodes to an empty text.
Marker characters in a text are white space. Rows with the same or no id each have their
result. An empty table gives an empty result. Other columns are not read. A model with a
piece that has a marker behind another character, or with pieces of the user's own, is refused.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from .frames import materialize, per_worker, table

SLICE_CHARS = 6 << 20
#: The distinct-chunk table: chunks at most, and characters of one.
TABLE, LONGEST = 1 << 17, 32
MARK = "▁"
MODEL = "piece_bpe_32k.model"
_CHUNK = re.compile(" +[^ ]*")


def load(model: str) -> sentencepiece.SentencePieceProcessor:
    """The model of a file, whose pieces must not cross the end of a word."""

    def read() -> sentencepiece.SentencePieceProcessor:
        held = sentencepiece.SentencePieceProcessor(model_file=model)
        for i in range(held.get_piece_size()):
            piece = held.id_to_piece(i)
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} of {model} crosses a white-space marker: {piece!r}")
        if held.encode(" a  b ", out_type=str) != [p for c in ("  a", "  b", " ") for p in _chunk_pieces(held, c)]:
            raise ValueError(f"{model} does not keep white space as it is")
        return held

    return per_worker(("pieces", model), read)


def _chunk_pieces(held: sentencepiece.SentencePieceProcessor, chunk: str) -> list[str]:
    return [MARK] if chunk == " " else held.encode(chunk[1:], out_type=str)


def chunks(text: str | None) -> list[str]:
    """The chunks of a text, the model's own marker before it included, with spaces as markers."""
    return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []


def segment(held: sentencepiece.SentencePieceProcessor, cut: list[str]) -> tuple[list[list[int]], list[str]]:
    """The ids of each chunk, and what they decode to behind the first marker."""
    ids = held.encode([c[1:] for c in cut], num_threads=1)  # the library puts a marker before each
    alone = held.piece_to_id(MARK)
    ids = [i if c != " " else [alone] for i, c in zip(ids, cut)]
    return ids, held.decode(ids, num_threads=1)


def read_slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[list[str]]]]:
    """Ids and chunks of the documents of each slice."""
    docs: list = []
    cut: list[list[str]] = []
    held = 0
    for batch in batches:
        for doc, scalar in zip(batch["doc_id"], batch["text"]):
            text = scalar.as_py() or ""
            if docs and held + len(text) > most:
                yield docs, cut
                docs, cut, held = [], [], 0
            docs.append(doc.as_py())
            cut.append(chunks(text))
            held += len(text)
    if docs:
        yield docs, cut


def chunk_counts(documents: DataFrame, most: int = SLICE_CHARS) -> DataFrame:
    """(chunk, n): how often chunks stand in all documents, those aside that a slice holds once."""
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cut in read_slices(batches, most):
            held: Counter = Counter()
            for one in cut:
                held.update(one)
            often = {c: n for c, n in held.items() if n > 1 and len(c) <= LONGEST}
            yield pa.RecordBatch.from_arrays([pa.array(list(often), pa.string()), pa.array(list(often.values()), pa.int64())], schema=schema)

    return own_texts(documents).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def own_texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent(counts: DataFrame, most: int = TABLE) -> DataFrame:
    """The most frequent chunks, ``most`` at most: all from a size of counts on, in steps of some 4 %."""
    counts = materialize(counts.withColumn("size", F.floor(16 * F.log2("n"))), "chunks")
    taken, least = 0, None
    for row in counts.groupBy("size").count().orderBy(F.col("size").desc()).collect():  # 1,008 rows at most
        taken += row["count"]
        if taken > most:
            break
        least = row["size"]
    return counts.where(F.col("size") >= F.lit(least)).select("chunk")  # none if there is no least


def chunk_table(words: DataFrame, model: str) -> DataFrame:
    """(chunk, ids, decoded) of each chunk; ``decoded`` is what stands behind the first marker."""
    schema = pa.schema([("chunk", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = load(model)
        for batch in batches:
            ids, back = segment(held, batch["chunk"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array(ids, schema.field("ids").type), pa.array(back, pa.string())], schema=schema)

    return words.select("chunk").distinct().mapInArrow(write, "chunk string, ids array<int>, decoded string")


def encode(documents: DataFrame, model: str, most: int = SLICE_CHARS, size: int = TABLE) -> DataFrame:
    """(doc_id, ids, decoded) of every row (doc_id, text): its ids, and the text that they decode to."""
    load(model)  # refused here, not in a task
    rows = chunk_table(frequent(chunk_counts(documents, most), size), model).collect()  # ``size`` rows at most
    table = {r["chunk"]: (array("i", r["ids"]).tobytes(), r["decoded"]) for r in rows}
    shared = documents.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = load(model), shared.value
        for docs, cut in read_slices(batches, most):
            distinct = set().union(*cut)
            rare = list(distinct.difference(known))
            ids, back = segment(held, rare)
            ids_of = {c: known[c][0] for c in distinct if c in known}
            ids_of.update(zip(rare, (array("i", i).tobytes() for i in ids)))
            # Most chunks decode to themselves; documents of such chunks decode to their texts.
            text_of = {c: known[c][1] for c in distinct if c in known and known[c][1] != c[1:]}
            text_of.update((c, b) for c, b in zip(rare, back) if b != c[1:])
            del ids, back, rare, distinct
            for begin in range(0, len(docs), 512):
                some = cut[begin : begin + 512]
                held_ids = [np.frombuffer(b"".join(map(ids_of.__getitem__, one)), np.int32) for one in some]
                texts = [" ".join([text_of.get(c, c[1:]) for c in one]) if text_of else "".join(one)[1:] for one in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[begin : begin + 512], pa.int64()), pa.array(held_ids, schema.field("ids").type), pa.array(texts, pa.string())], schema=schema
                )

    return own_texts(documents).mapInArrow(write, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): whole rows of ids through the library, null as none."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = load(model)
        for batch in batches:
            texts = [held.decode(ids) if ids else "" for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of ids of every document, and digests of them and of the text they decode to."""
    found = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
