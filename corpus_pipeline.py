"""From raw documents to packed training sequences.

Each stage calls one operator of ``keyfold.llm`` on all that the stage before it kept, and
what it decides is done: rejected documents go, one of each group of near duplicates stays,
repeated strings are cut out of the texts, contaminated documents go, the rest is packed.

Defined results: all stages but the last keep every column under its name, those named as a
stage's helpers too. Null texts count as empty ones; empty documents link with nothing, are
never contaminated, and are packed as their closing id alone. Rows with one id and different
texts are documents each for itself; of rows equal in both, one stays. Equal texts under other
ids, or none, are near duplicates of each other, and the least id stays. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm.decontamination import clean_documents
from keyfold.llm.frames import materialize, table
from keyfold.llm.near_duplicates import without_near_duplicates
from keyfold.llm.packing import pack
from keyfold.llm.quality import good_documents
from keyfold.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: A trained classifier, hashed signatures and a tokenizer have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, each with its sequence and place."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
