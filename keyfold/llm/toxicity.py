"""Toxicity by weak supervision.

1. *Lexicons.* In a bounded sample of labelled rows, words and word beginnings of
   3 to 8 letters are counted in toxic and other documents. Those that are toxic nearly
   always are the lexicons, one for each length.
2. *Voters.* Each lexicon votes on every document, and so do patterns of writing. No
   voter has to be right.
3. *Label model.* A generative model of two classes is fitted to the counts of all vote patterns over
   all rows outside the held-out fold, by expectation maximisation: it estimates how each voter votes in
   each class. Labelled rows of the sample keep their class. Voters that still agree more than the classes explain are joined and modelled
   together, and the fit is repeated. It gives each pattern the posterior of being toxic.
4. *Classifier.* A linear model over word beginnings, trained on posteriors of a bounded
   sample, scores every document.

Texts are read twice: the sample, then all rows, which leave a row of features each.

Defined results: a null text is an empty one and is scored by the intercept alone. A row
without an id is never held out and has no label. Rows with the same id are scored each for
themselves. If there is no labelled row, or only one class, no lexicon is found and every
score is the same. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import SIGNS, byte_set, flat_bytes, flat_words, materialize, slices, table
from .linear import fit_sparse, sigmoid

BINS = 4096
FIT_ROWS = 20_000  # labelled rows for the lexicons, and rows for the classifier, at most
FEATURES = 4096  # of the classifier
LENGTHS = range(3, 9)
FOLDS = 5
_UPPER, _BANG, _SIGN = byte_set((65, 90)), byte_set((33, 33)), byte_set((35, 38), (42, 42), (60, 60), (62, 62), (124, 124))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


LEVELS = 4


def levels(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which of the levels a gram found ``n`` times in a text of ``words`` words reaches: once,
    twice, four times, and twice and at least once in 150 words."""
    return np.stack([n >= 1, n >= 2, n >= 4, (n >= 2) & (150 * n >= words)], 1)


def grams(word: str) -> list[str]:
    """A word's beginnings, and the word itself. A feature is a gram and the level it reaches."""
    return [*(word[:k] for k in LENGTHS if len(word) > k), word + "$"]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different lower-case words, the number of each word in a row, and texts' bounds."""
    words, cut = flat_words(*flat_bytes(texts), SIGNS)
    coded = words.cast(pa.string()).dictionary_encode()
    return pc.utf8_lower(coded.dictionary).to_pylist(), coded.indices.to_numpy(), cut


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, n): documents of the sample (text, label) that have each gram."""
    schema = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                words, codes, cut = words_of(part["text"])
                labels = part["label"].to_numpy()
                found: dict[str, list[int]] = {}
                for label, a, b in zip(labels.tolist(), cut, cut[1:]):
                    own: dict[str, int] = {}
                    for i, n in zip(*(x.tolist() for x in np.unique(codes[a:b], return_counts=True))):
                        for g in grams(words[i]):
                            own[g] = own.get(g, 0) + n
                    reached = levels(np.fromiter(own.values(), np.int64, len(own)), b - a)
                    for g, r in zip(own, reached.tolist()):
                        for level in range(LEVELS):
                            if r[level]:
                                c = found.setdefault(f"{level}{g}", [0, 0])
                                c[0] += label
                                c[1] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(found), pa.string()), *(pa.array([c[k] for c in found.values()], pa.int64()) for k in (0, 1))], schema=schema
                )

    sums = labelled.mapInArrow(count, "gram string, toxic long, n long")
    return sums.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


class Features(NamedTuple):
    """The classifier's grams; ``lexicon`` has of each the voter it belongs to, or -1."""

    grams: list[str]
    lexicon: np.ndarray


def chosen_features(labelled: DataFrame, most: int = FEATURES) -> Features:
    """The grams that tell most about the label, by their log-likelihood ratio."""
    total = labelled.agg(F.count("label").alias("n"), F.sum("label").alias("t")).collect()[0]
    if not total.t or total.t == total.n:
        return Features([], np.empty(0, np.int64))
    counts = gram_counts(labelled).where("n >= 3")
    t, n, rate = F.col("toxic"), F.col("n"), total.t / total.n
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    score = part(t, rate) + part(n - t, 1 - rate)
    rows = counts.select("gram", "toxic", "n", score.alias("score")).orderBy(F.desc("score"), "gram").limit(most).collect()
    sure = lambda r: r.toxic >= 3 and (r.toxic + 0.5) / (r.n + 1) >= 0.8
    kind = lambda g: len(LENGTHS) if g.endswith("$") else len(g) - 1 - LENGTHS.start
    return Features([r.gram for r in rows], np.array([kind(r.gram) if sure(r) else -1 for r in rows], np.int64))


PATTERNS = 4  # shouting, exclamation marks, signs, one word over and over
VOTERS = len(LENGTHS) + 1 + PATTERNS


def featured(documents: DataFrame, features: Features) -> DataFrame:
    """(doc_id, held_out, features, votes) of every row. A lexicon votes 1 if any of its grams is
    there, else 0; a pattern votes 2 where it is strong, 1 where there is some, else 0."""
    sent = documents.sparkSession.sparkContext.broadcast(features)  # at most FEATURES grams
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("features", pa.list_(pa.int32())), ("votes", pa.string())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lexicon = sent.value
        number = {g: i for i, g in enumerate(sorted({x[1:] for x in names}))}
        feature = np.full((len(number) + 1, LEVELS), -1, np.int64)
        for i, x in enumerate(names):
            feature[number[x[1:]], int(x[0])] = i
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, cut = words_of(part["text"])
                has = [[number[g] for g in grams(w) if g in number] for w in words]
                sizes = np.fromiter(map(len, has), np.int64, len(has))
                flat = np.array([i for h in has for i in h], np.int64)
                heads = np.cumsum(sizes) - sizes
                doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                used = np.flatnonzero(sizes[codes])
                d, c = doc[used], codes[used].astype(np.int64)
                n = sizes[c]
                own = flat[np.repeat(heads[c] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                pairs, times = np.unique(np.repeat(d, n) << 32 | own, return_counts=True)
                d, own = pairs >> 32, pairs & 0xFFFFFFFF
                at, level = np.nonzero(levels(times, np.diff(cut)[d]) & (feature[own] >= 0))
                d, ids = d[at], feature[own[at], level]
                votes = np.zeros((len(cut) - 1, VOTERS), np.int64)
                voter = lexicon[ids] if len(ids) else ids
                votes[d[voter >= 0], voter[voter >= 0]] = 1
                votes[:, -PATTERNS:] = patterns(*flat_bytes(part["text"]), codes, cut)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(len(cut))), pa.int32()), pa.array(ids, pa.int32()))
                text = pa.array(["".join(map(str, v)) for v in votes.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], lists, text], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(look, "doc_id long, held_out boolean, features array<int>, votes string")


def patterns(data: np.ndarray, bounds: np.ndarray, codes: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Votes of the patterns on each text."""
    size = np.maximum(np.diff(bounds), 1)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[bounds])
    share = np.stack([sums(chosen[data]) / size for chosen in (_UPPER, _BANG, _SIGN)], 1)
    again = np.append(False, codes[1:] == codes[:-1]) if len(codes) else np.zeros(0, bool)
    same = np.diff(np.append(0, np.cumsum(again))[cut]) / np.maximum(np.diff(cut), 1)
    share = np.column_stack([share, same])
    return (share > [0.1, 0.002, 0.002, 0.02]).astype(np.int64) + (share > [0.4, 0.02, 0.05, 0.3])


class LabelModel:
    """Two classes and groups of voters that are independent given the class.

    ``patterns`` are rows of votes 0 to 2, ``counts`` how many documents have each, ``known``
    how many of these are labelled clean and toxic: they keep their class.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, lexicons: int, known: np.ndarray | None = None, rounds: int = 60):
        self.patterns, self.counts = patterns, counts.astype(float)
        self.known = np.zeros((2, len(counts))) if known is None else known.astype(float)
        copies = [(r, i, j) for r, i, j in self._agreement() if r >= 0.9]
        self.groups = self._grouped(copies)
        hits = (patterns[:, [g[0] for g in self.groups if g[0] < lexicons]] == 1).sum(1)
        guess = np.where(hits > 1, 0.95, np.where(hits == 1, 0.6, 0.02))
        self.posterior = (self.known[1] + 2 * guess) / (self.known.sum(0) + 2)
        self._fit(rounds)
        self.groups = self._grouped(copies + [x for x in self._dependence() if x[0] >= 0.02])
        self._fit(rounds)

    def _weight(self) -> np.ndarray:
        """Documents of each pattern by class."""
        free = np.maximum(self.counts - self.known.sum(0), 0)
        return np.stack([1 - self.posterior, self.posterior]) * free + self.known

    def _cells(self, group: list[int]) -> np.ndarray:
        code = np.zeros(len(self.patterns), np.int64)
        for j in group:
            code = code * 3 + self.patterns[:, j]
        return code

    def _fit(self, rounds: int) -> None:
        for _ in range(rounds):
            weight = self._weight()
            self.prior = np.clip(weight[1].sum() / max(weight.sum(), 1e-9), 1e-4, 0.5)
            logit = np.full(len(self.patterns), np.log(self.prior / (1 - self.prior)))
            self.tables = []
            for group in self.groups:
                cells = self._cells(group)
                n = 3 ** len(group)
                shares = np.stack([np.bincount(cells, w, n) + 0.5 / n for w in weight])
                shares /= shares.sum(1, keepdims=True)
                self.tables.append(shares)
                logit += np.log(shares[1] / shares[0])[cells]
            self.posterior = sigmoid(logit)

    def _agreement(self) -> list[tuple[float, int, int]]:
        """Correlation of two voters, classes aside; voters that are nearly one are joined at once."""
        x = (self.patterns > 0).astype(float)
        total = max(self.counts.sum(), 1e-9)
        mean = self.counts @ x / total
        cov = (x * self.counts[:, None]).T @ x / total - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        return [(cov[i, j] / spread[i] / spread[j], i, j) for i in range(x.shape[1]) for j in range(i)]

    def _dependence(self) -> list[tuple[float, int, int]]:
        """Of two voters, the information that they share within the classes."""
        weight = self._weight()
        found = []
        for i in range(self.patterns.shape[1]):
            for j in range(i):
                bits = 0.0
                for w in weight:
                    both = np.bincount(self._cells([i, j]), w, 9).reshape(3, 3) / max(weight.sum(), 1e-9)
                    apart = np.outer(both.sum(1), both.sum(0)) / max(both.sum(), 1e-12)
                    used = both > 0
                    bits += float((both[used] * np.log(both[used] / apart[used])).sum())
                found.append((bits, i, j))
        return found

    def _grouped(self, pairs: list[tuple[float, int, int]], most: int = 3) -> list[list[int]]:
        """Voters joined along the strongest pairs, ``most`` in a group at most."""
        group = {j: [j] for j in range(self.patterns.shape[1])}
        for _, i, j in sorted(pairs, reverse=True):
            if group[i] is not group[j] and len(group[i]) + len(group[j]) <= most:
                joined = sorted(group[i] + group[j])
                for k in joined:
                    group[k] = joined
        return list({id(g): g for g in group.values()}.values())

    def accuracies(self) -> np.ndarray:
        """Of each voter, the chance that it votes (not 0) in either class: clean, toxic."""
        weight = self._weight()
        return np.array([[w @ (self.patterns[:, j] > 0) / max(w.sum(), 1e-9) for w in weight] for j in range(self.patterns.shape[1])])


class Scorer(NamedTuple):
    features: Features
    weights: np.ndarray


def bounded(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """All rows, or ``most`` of them, never more, with ``draw``, a hash of the whole row by which
    they are chosen. Whole bins of the hash are taken, and the rest from the next bin in order, so
    that the draw does not depend on how the rows lie; rows of one draw are equal."""
    drawn = rows.withColumn("draw", F.xxhash64(*rows.columns, F.lit(seed)))
    bin_of = F.pmod(F.col("draw"), F.lit(BINS))
    counts = drawn.groupBy(bin_of.alias("bin")).count().orderBy("bin").collect()  # BINS rows at most
    taken = 0
    for row in counts:
        if taken + row["count"] > most:
            rest = drawn.where(bin_of == row["bin"]).orderBy("draw").limit(most - taken)
            return drawn.where(bin_of < row["bin"]).unionByName(rest)
        taken += row["count"]
    return drawn


def in_order(rows: DataFrame) -> pd.DataFrame:
    """Drawn rows on the driver, in an order of their own: a fit sums floats, and the same sums each time."""
    return rows.toPandas().sort_values("draw", kind="stable", ignore_index=True).drop(columns="draw")


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) outside the held-out fold, one row for an id; the higher label counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))


def scored(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, LabelModel]:
    """Every row with doc_id, held_out and score, and the label model."""
    spark = documents.sparkSession
    # At most about fit_rows pairs of numbers.
    some = F.broadcast(materialize(bounded(labels_of(labels, "toxic"), fit_rows, 1).drop("draw"), "labels"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = chosen_features(texts.join(some, "doc_id").select("text", F.col("label").cast("long").alias("label")))
    rows = materialize(featured(documents, features), "features")
    learning = rows.where("not held_out")
    counts = sorted(map(tuple, learning.groupBy("votes").count().collect()))  # patterns of VOTERS votes
    votes = np.array([[int(v) for v in p] for p, _ in counts], np.int64).reshape(-1, VOTERS)
    sure = {}
    for pattern, label, n in learning.join(some, "doc_id").groupBy("votes", "label").count().collect():
        sure[pattern, label] = n
    known = np.array([[sure.get((p, y), 0) for p, _ in counts] for y in (0, 1)], float).reshape(2, -1)
    model = LabelModel(votes, np.array([n for _, n in counts], np.int64), len(LENGTHS) + 1, known)
    posterior = {p: q for (p, _), q in zip(counts, model.posterior.tolist())}
    fit = in_order(bounded(learning.select("doc_id", "features", "votes"), fit_rows, 2).select("features", "votes", "draw"))
    sizes = fit["features"].map(len).to_numpy(np.int64) if len(fit) else np.empty(0, np.int64)
    columns = np.concatenate([*fit["features"], np.empty(0, np.int64)]).astype(np.int64) if len(fit) else np.empty(0, np.int64)
    y = fit["votes"].map(posterior).to_numpy(float) if len(fit) else np.empty(0)
    weights = fit_sparse(np.repeat(np.arange(len(fit)), sizes), columns, len(features.grams), y)
    sent = spark.sparkContext.broadcast(weights)  # one number a feature

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            lists = batch["features"]
            bounds = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            values = lists.values.to_numpy()[bounds[0] : bounds[-1]] if len(lists) else lists.values.to_numpy()
            z = np.bincount(row, w[:-1][values], len(lists)) + w[-1]  # a row's sum does not depend on its batch
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(sigmoid(z))], ["doc_id", "held_out", "score"])

    return rows.select("doc_id", "held_out", "features").mapInArrow(score, "doc_id long, held_out boolean, score double"), model


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by what labels outside the held-out fold teach."""
    found, _ = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
