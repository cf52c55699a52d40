"""How the sources of a language differ in their words: exact joint tables of count levels.

1. Words are counted by (lang, source, term) within slices, then over all documents. A
   language keeps the terms of at least ``LEAST_DOCUMENTS`` of its documents.
2. A source's counts have few different values, its *levels*. For a block of terms, the
   columns (source, level) are indicators: 1 where the source counts the term that often, level
   0 included. The product of that matrix with its own transpose tells, for each two sources
   and each two of their levels, how many terms of the block have both.
3. Blocks are summed up. A joint table holds all that a divergence summed over the terms
   can ask of two sources, so that each pair of levels is priced once, in integers.

Terms are dealt into blocks by a hash. Where a language has more than ``SOURCES`` sources, their
columns are dealt into blocks too, and each two column blocks make a product of their own.
Within a block the terms are taken in order of their counts, as many at a time as have
``COLUMNS`` columns at most; rare terms, which are most, have few levels. A product counts ones,
which single floats do exactly up to 2**24 terms.

All prices are integers: p = 1 + floor(UNIT * (count + 2) / (N + 2 V)) for a source with N words in
V kept terms, and f = floor((p - q)**2 / (p + q)).

Defined results: null lang, source or text are empty ones. A document without terms makes its
source appear all the same. In a language without kept terms all values are 0. Rows count each,
whatever their doc_id, so repeated rows count twice. A term of one document counts in its own
language only. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .frames import byte_set, flat_bytes, flat_words, materialize, slices, table

LEAST_DOCUMENTS = 10
UNIT = 1_000_000_000
TOP = 10
#: Rows of a block of terms, sources of a block of columns, columns of one product.
ENTRIES, SOURCES, COLUMNS, TERMS = 50_000, 64, 1024, 4096
_BETWEEN = byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words, cut = flat_words(*flat_bytes(part["text"]), _BETWEEN)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                width = len(coded.dictionary)
                groups = pa.StructArray.from_arrays([part["lang"], part["source"]], ["lang", "source"])
                group = _codes(groups)
                doc = np.repeat(np.arange(part.num_rows), np.diff(cut))
                pair, times = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
                key, place = np.unique(group[pair // width] * width + pair % width, return_inverse=True)
                n = np.bincount(place, times, len(key)).astype(np.int64)
                _, first = np.unique(group, return_index=True)
                of = first[key // width]
                term = coded.dictionary.take(pa.array(key % width)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part["lang"].take(pa.array(of)), part["source"].take(pa.array(of)), term, pa.array(n), pa.array(np.bincount(place))], schema=schema
                )

    rows = documents.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _codes(groups: pa.StructArray) -> np.ndarray:
    """A number for each different (lang, source), ascending from 0."""
    one, two = (groups.field(i).dictionary_encode() for i in range(2))
    both = one.indices.to_numpy().astype(np.int64) * max(1, len(two.dictionary)) + two.indices.to_numpy()
    return np.unique(both, return_inverse=True)[1]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def price(count: Column, total: Column, terms: Column) -> Column:
    """p of a term with this count in a group of so many words in kept terms; null without kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    part = _div(F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(total) + 2 * wide(terms))
    return F.when(terms > 0, 1 + part)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The counts (lang, source, term, n, total) of kept terms; and of each language its kept
    ``terms``, their ``lang_words`` and the number of its counts."""
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("rows"))
    vocabulary = materialize(vocabulary.where(F.col("docs") >= least).drop("docs"), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_words"), F.sum("rows").alias("rows"))
    rows = counts.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total")
    return materialize(rows, "kept"), langs


def sized_groups(own: DataFrame, kept: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source) of every group with its ``words`` and its language's sizes and numbers of blocks."""
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    groups = materialize(own.select("lang", "source").distinct().join(words, ["lang", "source"], "left"), "groups")
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(langs, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    blocks = lambda c, size: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / size)).cast("long")
    sizes = sources.select("lang", zero("terms"), zero("lang_words"), blocks("rows", ENTRIES).alias("blocks"), blocks("sources", SOURCES).alias("column_blocks"))
    return materialize(groups.join(sizes, "lang").withColumn("words", F.coalesce("words", F.lit(0))), "groups")


_JOINT = "lang string, one string, level_one long, p long, two string, level_two long, q long, terms long"


def joint_tables(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, one, level_one, p, two, level_two, q, terms): how many of a language's kept terms
    have one count in one source and another in another, each with its price. ``one`` is the
    source that comes first; levels without a term are left out, but for level 0 of both."""
    names = ["lang", "source", "term", "n", "p", "terms", "block", "column_block", "column_blocks"]
    of_source = F.pmod(F.xxhash64("source"), F.col("column_blocks")).alias("column_block")
    p = price(F.col("n"), F.col("words"), F.col("terms")).alias("p")
    rows = kept.join(groups, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    none = groups.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    both = [t.select("lang", "source", "term", "n", p, "terms", "block", of_source, "column_blocks").select(*names) for t in (rows, none)]
    dealt = both[0].unionByName(both[1]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("column_blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("column_block", "other"), "high": F.greatest("column_block", "other")})
    found = dealt.groupBy("lang", "block", "low", "high").applyInArrow(block_product, _JOINT)
    return found.groupBy("lang", "one", "level_one", "p", "two", "level_two", "q").agg(F.sum("terms").alias("terms"))


def block_product(rows: pa.Table) -> pa.Table:
    """The joint tables of one block of terms and one or two blocks of sources."""
    rows = rows.combine_chunks()
    term = rows["term"].combine_chunks()
    given = term.is_valid().to_numpy(zero_copy_only=False)
    names, source = np.unique(np.array([s.encode() for s in rows["source"].to_pylist()], object), return_inverse=True)
    n = rows["n"].to_numpy()
    p = rows["p"].combine_chunks()
    side = np.zeros(len(names), np.int64)
    side[source] = rows["column_block"].to_numpy()
    # A column for each level of each source in this block: its level 0 first, then ascending.
    order = np.lexsort((n, source))
    new = np.ones(len(order), bool)
    new[1:] = (n[order][1:] != n[order][:-1]) | (source[order][1:] != source[order][:-1])
    column = np.empty(len(order), np.int64)
    column[order] = np.cumsum(new) - 1
    firsts = order[new]
    of, level = source[firsts], n[firsts]
    zeros = np.flatnonzero(level == 0)  # one for each source, in their order
    code = term.filter(pa.array(given)).dictionary_encode()
    place, column, count = code.indices.to_numpy().astype(np.int64), column[given], n[given]
    # Terms in neither block of sources are not here: level 0 of both is counted from all terms.
    unseen = (rows["terms"][0].as_py() if rows["block"][0].as_py() == 0 else 0) - len(code.dictionary)
    pairs, times = _products(place, column, count, len(code.dictionary), of, zeros, unseen)
    one, two = pairs // len(of), pairs % len(of)
    alone = rows["low"][0] == rows["high"][0]  # two blocks of sources: only pairs across them
    apart = (of[one] < of[two]) & (alone | (side[of[one]] != side[of[two]]))
    one, two, times = one[apart], two[apart], times[apart]
    text = pa.array([b.decode() for b in names], pa.string())
    prices = p.take(pa.array(firsts))
    return pa.Table.from_arrays(
        [
            pa.repeat(rows["lang"][0], len(one)),
            *(a for i in (one, two) for a in (text.take(pa.array(of[i])), pa.array(level[i]), prices.take(pa.array(i)))),
            pa.array(times),
        ],
        names=["lang", "one", "level_one", "p", "two", "level_two", "q", "terms"],
    )


def _products(place: np.ndarray, column: np.ndarray, count: np.ndarray, terms: int, of: np.ndarray, zeros: np.ndarray, unseen: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of columns, as one number each, and how many terms are in both; ``unseen`` more in each two sources' levels 0."""
    size = np.bincount(place, count, terms)
    rank = np.empty(terms, np.int64)
    rank[np.argsort(size, kind="stable")] = np.arange(terms)
    order = np.argsort(rank[place], kind="stable")
    place, column = rank[place][order], column[order]
    bounds = np.searchsorted(place, np.arange(terms + 1))
    empty = (zeros[:, None] * len(of) + zeros).ravel()
    pairs, times = [empty], [np.full(len(empty), unseen, np.int64)]
    begin = 0
    while begin < terms:
        here, end = set(column[bounds[begin] : bounds[begin + 1]].tolist()), begin + 1
        while end < terms and end - begin < TERMS:
            wider = here.union(column[bounds[end] : bounds[end + 1]].tolist())
            if len(wider) > COLUMNS:
                break
            here, end = wider, end + 1
        used = np.union1d(np.fromiter(here, np.int64, len(here)), zeros)
        entry = slice(bounds[begin], bounds[end])
        hot = np.zeros((end - begin, len(used)), np.float32)
        at = np.searchsorted(used, column[entry])
        hot[:, np.searchsorted(used, zeros)] = 1
        hot[place[entry] - begin, np.searchsorted(used, zeros[of[column[entry]]])] = 0
        hot[place[entry] - begin, at] = 1
        product = hot.T @ hot
        i, j = np.nonzero(product)
        pairs.append(used[i] * len(of) + used[j])
        times.append(product[i, j].astype(np.int64))
        begin = end
    found, where = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: each other source of the language
    with the sum of f over all kept terms. Part ``term``: the terms that the source uses more than
    its language does, the ``top`` with the greatest f."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = documents.select(empty("lang"), empty("source"), empty("text"))
    kept, langs = kept_terms(materialize(term_counts(own), "counts"), least)
    groups = sized_groups(own, kept, langs)
    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    columns = ["lang", "source", "part", "item", "value"]

    f = F.coalesce(F.col("terms") * divergence(F.col("p"), F.col("q")), F.lit(0))
    sums = joint_tables(kept, groups).groupBy("lang", "one", "two").agg(F.sum(f).alias("value"))
    ways = F.explode(F.array(*(F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("one", "two"), ("two", "one")))))
    pairs = sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by))

    here = price(F.col("n"), F.col("words"), F.col("terms"))
    there = price(F.col("total"), F.col("lang_words"), F.col("terms"))
    priced = kept.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), here.alias("p"), there.alias("q"))
    terms = priced.where("p > q").withColumn("value", divergence(F.col("p"), F.col("q"))).select(*columns)
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages against each other, and their words against the language's."""
    return audit(table(spark, sf_dir, "documents"))


#: The same with a row for each source and kept term.
OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d)
), v AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCUMENTS}
), l AS (
  SELECT lang, count(*) AS v, sum(total) AS n FROM v GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term
), f AS (
  SELECT g.lang, g.source, v.term, coalesce(n.n, 0) AS n, v.total
  FROM g JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = v.term
), p AS (
  SELECT f.lang, source, term, f.n,
    CAST(1 + {UNIT} * CAST(f.n + 2 AS HUGEINT) // (sum(f.n) OVER (PARTITION BY f.lang, source) + 2 * l.v) AS HUGEINT) AS p,
    CAST(1 + {UNIT} * CAST(total + 2 AS HUGEINT) // (l.n + 2 * l.v) AS HUGEINT) AS q
  FROM f JOIN l ON l.lang = f.lang
), pair AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value,
  CAST(row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source) AS INTEGER) AS rank
FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
UNION ALL
SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value,
  CAST(row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term) AS INTEGER) AS rank
FROM p WHERE n > 0 AND p > q QUALIFY rank <= {TOP}
"""
