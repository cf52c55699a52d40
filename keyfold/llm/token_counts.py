"""Token counts that follow edits.

A text falls into pre-tokens, and no token goes over their bounds, so counts add up. Where
a space or newline follows a letter, digit or ASCII sign, a pre-token ends whatever stands around: these
bounds depend on two characters. The count of a document is a tree: leaves of some tens of
such stretches with their characters and tokens, and above them sums of ``FAN`` nodes each.
An edit finds its leaves by walking down the sums of characters, takes in the leaf before if it
touches the bound between them, encodes these anew, and updates the sums above them. All
other bounds stand as they did, so everything else keeps its counts.

Trees are a table of their own (doc_id, hash, leaves), written once and met by edits later: the
counts after an edit cost what it touches, not what the text holds.

Defined results: a null text is an empty one. Edits of a document are made in the order of
``seq``, nulls last, and those of one ``seq`` by place, characters removed and insertion; places are code points of the text as it then is, and those past an end are moved
to the end; null places are 0, a null insertion is nothing. Rows with the same id are edited
each for themselves, by all edits of that id. Edits of ids that no document has are not
used. Other columns are not read.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import flat_bytes, materialize, per_worker, slices, table

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 32  # stretches
FAN = 16
EDITS = 3  # of the registered query, for a document


_BOUND = re.compile(r"[^\W_](?=[ \n])|[!-/:-@\[-`{-~](?=[ \n])")
Coder = Callable[[str], list[int]]


def coder(name: str) -> Coder:
    return per_worker(("coder", name), lambda: _made_coder(name))


def _made_coder(name: str) -> Coder:
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Tree:
    """Characters and tokens of a text's leaves, with sums over ``FAN`` of them, and so on."""

    def __init__(self, leaves: list[tuple[int, int]], fan: int = FAN):
        self.fan = fan
        self.levels = [[list(x) for x in leaves]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([_sum(below[i : i + fan]) for i in range(0, len(below), fan)])

    @property
    def leaves(self) -> list[list[int]]:
        return self.levels[0]

    @property
    def total(self) -> list[int]:
        return self.levels[-1][0] if self.leaves else [0, 0]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a place, or the last one, and where that leaf begins."""
        at, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= self.fan
            last = min(at + self.fan, len(level)) - 1
            while at < last and begin + level[at][0] <= place:
                begin += level[at][0]
                at += 1
        return at, begin

    def replace(self, low: int, high: int, leaves: list[tuple[int, int]]) -> None:
        """Puts other leaves in place of ``low`` to ``high``. If their number stays, only the
        sums above them change; else also those of the leaves that move."""
        same = len(leaves) == high - low
        self.levels[0][low:high] = [list(x) for x in leaves]
        level = 0
        while len(self.levels[level]) > 1:
            below = self.levels[level]
            n = -(-len(below) // self.fan)
            if level + 1 == len(self.levels):
                self.levels.append([])
            first = low // self.fan
            end = -(-max(high, low + 1) // self.fan) if same else n
            above = self.levels[level + 1]
            del above[n:]
            above[first:end] = [_sum(below[i * self.fan : (i + 1) * self.fan]) for i in range(first, min(end, n))]
            low, high, level = first, end, level + 1
        del self.levels[level + 1 :]


def _sum(nodes: list[list[int]]) -> list[int]:
    return [sum(x[0] for x in nodes), sum(x[1] for x in nodes)]


def leaves_of(text: str, code: Coder, size: int) -> list[tuple[int, int]]:
    """Characters and tokens of a text's leaves, of ``size`` stretches each."""
    bounds = [m.end() for m in _BOUND.finditer(text)][size - 1 :: size]
    at = sorted({0, *bounds, len(text)})
    return [(b - a, len(code(text[a:b]))) for a, b in itertools.pairwise(at)]


def build(text: str, code: Coder, size: int = LEAF) -> Tree:
    return Tree(leaves_of(text, code, size))


def edit(text: str, tree: Tree, start: int, removed: int, inserted: str, code: Coder, size: int = LEAF) -> tuple[str, int]:
    """Makes one edit and changes ``tree``: the new text, and how many characters were encoded again."""
    start = min(max(start, 0), len(text))
    end = min(start + max(removed, 0), len(text))
    new = text[:start] + inserted + text[end:]
    if new == text or not tree.leaves:
        tree.replace(0, len(tree.leaves) if new != text else 0, leaves_of(new, code, size) if new != text else [])
        return new, len(new) * (new != text)
    low, begin = tree.find(start)
    if low > 0 and start == begin:
        low -= 1
        begin -= tree.leaves[low][0]
    high, stop = tree.find(end)
    stop += tree.leaves[high][0]
    again = new[begin : stop + len(new) - len(text)]
    tree.replace(low, high + 1, leaves_of(again, code, size))
    return new, len(again)


def trees(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, hash, leaves) of every text: characters and tokens of its leaves, packed as
    little-endian 32-bit pairs."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("leaves", pa.binary())])

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [np.array(build(t or "", code).leaves, "<u4").tobytes() for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["hash"], pa.array(raw, pa.binary())], schema=schema)

    return _keyed(documents).mapInArrow(plant, "doc_id long, hash long, leaves binary")


def _small(keyed: DataFrame) -> DataFrame:
    """(doc_id, hash, z): texts made small for the way to their trees and edits."""
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("z", pa.binary())])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat_bytes(part["text"])
                z = [press.compress(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["hash"], pa.array(z, pa.binary())], schema=schema)

    return keyed.mapInArrow(shrink, "doc_id long, hash long, z binary")


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text, F.length(text)).alias("hash"), text.alias("text"))


def counted_after(documents: DataFrame, edits: DataFrame, planted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row after its edits (doc_id, seq, start, removed, inserted): tokens before and
    after, edits made, characters after, characters encoded again, the new text, and its tree."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("tokens_before", pa.int64()), ("tokens_after", pa.int64()), ("n_edits", pa.int64()), ("n_chars", pa.int64()),
        ("recoded_chars", pa.int64()), ("text", pa.string()), ("leaves", pa.binary()),
    ])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, press = coder(vocabulary), zstandard.ZstdDecompressor()
        for batch in batches:
            for part in slices(batch, "z", 1 << 20):
                out: list[list] = [[] for _ in schema]
                for doc, z, leaves, own in zip(*(part[k].to_pylist() for k in ("doc_id", "z", "leaves", "edits"))):
                    text, own = press.decompress(z).decode(), sorted(own or (), key=_turn)
                    tree = Tree(np.frombuffer(leaves, "<u4").astype(int).reshape(-1, 2).tolist())
                    before, recoded = tree.total[1], 0
                    for e in own:
                        text, n = edit(text, tree, e["start"] or 0, e["removed"] or 0, e["inserted"] or "", code)
                        recoded += n
                    row = (doc, before, tree.total[1], len(own), len(text), recoded, text, np.array(tree.leaves, "<u4").tobytes())
                    for column, value in zip(out, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    each = edits.where("doc_id is not null").groupBy("doc_id").agg(F.collect_list(F.struct("seq", "start", "removed", "inserted")).alias("edits"))
    tree = planted.dropDuplicates(["doc_id", "hash"]).withColumnsRenamed({"doc_id": "__doc", "hash": "__hash"})
    # Trees and edits meet first, so that the texts are moved once.
    ready = tree.join(each.withColumnRenamed("doc_id", "__of"), F.col("__doc") == F.col("__of"), "left")
    keyed = _small(_keyed(documents))
    same = keyed["doc_id"].eqNullSafe(ready["__doc"]) & (keyed["hash"] == ready["__hash"])
    rows = keyed.join(ready, same).select("doc_id", "z", "leaves", "edits")
    return rows.mapInArrow(follow, "doc_id long, tokens_before long, tokens_after long, n_edits long, n_chars long, recoded_chars long, text string, leaves binary")


def _turn(e: dict) -> tuple:
    """The place of an edit among those of its document, whatever order they come in."""
    return e["seq"] is None, e["seq"] or 0, e["start"] or 0, e["removed"] or 0, e["inserted"] or ""


def revisions(documents: DataFrame, each: int = EDITS) -> DataFrame:
    """An edit history made of the documents themselves: at ``each`` places that a hash
    names, some characters give way to a stretch of the same text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seq = F.explode(F.sequence(F.lit(1), F.lit(each))).alias("seq")
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("n"), seq)
    at = lambda salt, most: F.pmod(F.xxhash64("doc_id", "seq", F.lit(salt)), most).cast("int")
    return rows.select(
        "doc_id", "seq", at(1, F.col("n") + 1).alias("start"), at(2, F.lit(40)).alias("removed"),
        F.substring("text", at(3, F.col("n") + 1) + 1, at(4, F.lit(60))).alias("inserted"),
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after three edits each: their counts, kept up to date by their trees."""
    documents = table(spark, sf_dir, "documents")
    planted = materialize(trees(documents), "trees")
    found = counted_after(documents, revisions(documents), planted)
    return found.select("doc_id", "tokens_before", "tokens_after", "n_edits", "n_chars", "recoded_chars")
