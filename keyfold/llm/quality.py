"""Quality by co-training of two views.

The *content* view sees how a text is written: kinds of characters, repeated words and lines, word
lengths. The *metadata* view sees what the page says of itself: source, language, recorded
length, number and length of lines. Each is a linear model. In every round each model labels the rows it is
surest of in a bounded pool of unlabelled rows, and hands them to the other as training
rows. Afterwards both are calibrated on labelled rows that neither was trained on, and a
last small model weighs the calibrated views.

Every text is read once, into a row of numbers. Means and deviations of the numbers are taken
over all rows; the fit uses at most ``FIT_ROWS`` labelled and as many unlabelled rows.

Defined results: a null text is an empty one; a null source, language or length is a value
of its own. Rows with the same id are scored each for themselves. Without labels of both
classes every score is 0.5 and nothing is rejected. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import SPACES, byte_set, flat_bytes, flat_words, materialize, own_names, slices, small_batches, table
from .linear import fit_dense, platt, sigmoid
from .toxicity import bounded, held_out, in_order, labels_of

FIT_ROWS = 20_000
ROUNDS = 5
SURE = 200  # rows that a view hands over in a round, of either class by its share
REJECT = 0.2  # a document scored below is rejected
_HASHED = 32  # columns for the source, and as many for the language

_KINDS = {
    "upper": byte_set((65, 90)),
    "digit": byte_set((48, 57)),
    "space": SPACES,
    "stop": byte_set((33, 33), (46, 46), (63, 63)),
    "comma": byte_set((44, 44), (58, 59)),
    "sign": byte_set((35, 38), (42, 43), (47, 47), (60, 62), (92, 92), (94, 94), (124, 124), (126, 126)),
    "bracket": byte_set((34, 34), (39, 41), (91, 91), (93, 93), (123, 123), (125, 125)),
    "high": byte_set((128, 255)),
}
CONTENT = [*_KINDS, "letters_a_word", "different_words", "same_as_last", "repeated_lines", "long_words"]
PAGE = ["n_chars", "n_lines", "line_length", "longest_line"]


def content_numbers(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``CONTENT`` for each text, shares of the whole text."""
    n = len(bounds) - 1
    sums = lambda mask, at: np.diff(np.append(0, np.cumsum(mask))[at])
    size = np.maximum(np.diff(bounds), 1)
    out = [sums(k[data], bounds) / size for k in _KINDS.values()]
    words, cut = flat_words(data, bounds, SPACES)
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    lengths = np.diff(np.frombuffer(words.buffers()[1], np.int32)) if len(words) else np.empty(0, np.int64)
    count = np.maximum(np.diff(cut), 1)
    doc = np.repeat(np.arange(n), np.diff(cut))
    out.append(np.log1p(sums(lengths, cut) / count))
    different = np.bincount(np.unique(doc << 32 | codes) >> 32, minlength=n) / count
    out.append(np.where(np.diff(cut) > 0, different, 1.0))
    again = np.append(False, (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])) if len(codes) else np.zeros(0, bool)
    out.append(sums(again, cut) / count)
    lines, at = flat_words(data, bounds, byte_set((10, 10)))
    marks = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    own = np.repeat(np.arange(n), np.diff(at))
    unlike = np.bincount(np.unique(own << 32 | marks) >> 32, minlength=n)
    out.append(1 - unlike / np.maximum(np.diff(at), 1) * (np.diff(at) > 0) - (np.diff(at) == 0))
    out.append(sums(lengths > 20, cut) / count)
    return np.stack(out, 1)


def page_numbers(data: np.ndarray, bounds: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """A row of ``PAGE`` for each document."""
    lines, at = flat_words(data, bounds, byte_set((10, 10)))
    lengths = np.diff(np.frombuffer(lines.buffers()[1], np.int32)) if len(lines) else np.empty(0, np.int64)
    total = np.append(0, np.cumsum(lengths))
    mean = (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
    longest = np.zeros(len(n_chars))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        longest[full] = np.maximum.reduceat(lengths, at[full])
    return np.log1p(np.stack([np.nan_to_num(n_chars), np.diff(at), mean, longest], 1))


def _hashed(column: str) -> Column:
    return F.pmod(F.xxhash64(F.lower(F.col(column).cast("string"))), F.lit(_HASHED)).cast("int")


def described(documents: DataFrame) -> DataFrame:
    """(doc_id, content, page, source, lang) of every row: its numbers, and hashed names."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("content", pa.list_(pa.float32())), ("page", pa.list_(pa.float32())), ("source", pa.int32()), ("lang", pa.int32()),
    ])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = flat_bytes(part["text"])
                chars = part["n_chars"].to_numpy(zero_copy_only=False).astype(float)
                both = [content_numbers(data, bounds), page_numbers(data, bounds, np.maximum(np.nan_to_num(chars), 0))]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32())) for x in both]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *lists, part["source"], part["lang"]], schema=schema)

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("double").alias("n_chars"),
        _hashed("source").alias("source"), _hashed("lang").alias("lang"),
    )
    return small_batches(rows).mapInArrow(measure, "doc_id long, content array<float>, page array<float>, source int, lang int")


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


class Views:
    """Both models, their calibration, and the model over both."""

    def __init__(self, content_scale: np.ndarray, page_scale: np.ndarray):
        self.scales = content_scale, page_scale
        self.ready = False

    def numbers(self, content: np.ndarray, page: np.ndarray, source: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = [np.clip((x - m[0]) / np.maximum(m[1], 1e-6), -8, 8) for x, m in zip((content, page), self.scales)]
        names = np.zeros((len(source), 2 * _HASHED))
        names[np.arange(len(source)), source] = 1
        names[np.arange(len(lang)), _HASHED + lang] = 1
        return np.column_stack([scaled[0], np.abs(scaled[0])]), np.column_stack([scaled[1], scaled[1] ** 2, names])

    def fit(self, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS, sure: int = SURE) -> None:
        """A fifth of the labelled rows is left for the calibration."""
        apart = np.arange(len(y)) % 5 == 0
        if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
            return
        train = [x[~apart] for x in labelled]
        truth = y[~apart].astype(float)
        given: list[dict[int, float]] = [{}, {}]  # rows of the pool that each view was handed
        models = []
        for turn in range(rounds + 1):
            models = []
            for view in (0, 1):
                extra = np.array(sorted(given[view]), np.int64)
                x = np.concatenate([train[view], pool[view][extra]])
                z = np.concatenate([truth, [given[view][i] for i in extra.tolist()]])
                models.append(fit_dense(x, z, np.concatenate([np.ones(len(truth)), np.full(len(extra), 0.5)])))
            if turn == rounds or not len(pool[0]):
                break
            for view in (0, 1):
                a, b = platt(train[view] @ models[view][:-1] + models[view][-1], truth)
                p = sigmoid(a * (pool[view] @ models[view][:-1] + models[view][-1]) + b)
                order = np.argsort(p, kind="stable")
                high = [i for i in order[::-1][: int(sure * truth.mean())].tolist() if p[i] > 0.9]
                low = [i for i in order[: int(sure * (1 - truth.mean())) + 1].tolist() if p[i] < 0.1]
                given[1 - view] |= {i: 1.0 for i in high} | {i: 0.0 for i in low}
        self.models = models
        raw = [x[apart] @ w[:-1] + w[-1] for x, w in zip(labelled, models)]
        self.calibration = [platt(r, y[apart].astype(float)) for r in raw]
        both = np.stack([a * r + b for (a, b), r in zip(self.calibration, raw)], 1)
        self.both = fit_dense(np.clip(both, -12, 12), y[apart].astype(float), l2=0.1)
        self.ready = True

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(content, page, both): calibrated chances of good quality, a row each."""
        if not self.ready:
            return np.full((len(views[0]), 3), 0.5)
        logits = np.stack([a * (x @ w[:-1] + w[-1]) + b for (a, b), x, w in zip(self.calibration, views, self.models)], 1)
        # Nine places: what lies behind them depends on the other rows of a batch.
        return np.round(sigmoid(np.column_stack([logits, np.clip(logits, -12, 12) @ self.both[:-1] + self.both[-1]])), 9)


def _scale(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Mean and deviation of each number over all rows, to nine digits, whatever order they are added in."""
    parts = [f(F.col(column)[i].cast("double")) for f in (F.avg, F.stddev_pop) for i in range(n)]
    return np.array([float(f"{x or 0.0:.9g}") for x in rows.agg(*(p.alias(f"c{i}") for i, p in enumerate(parts))).collect()[0]]).reshape(2, n)


def fitted(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, Views]:
    """The numbers of every row, and the models. Labels of the held-out fold (as in
    ``toxicity``) are not used."""
    rows = materialize(described(documents), "described")
    known = F.broadcast(materialize(bounded(labels_of(labels, "quality"), fit_rows, 3).drop("draw"), "labels"))  # bounded by fit_rows
    views = Views(_scale(rows, "content", len(CONTENT)), _scale(rows, "page", len(PAGE)))
    # An id may have any number of rows, so these are bounded as well.
    fit = in_order(bounded(rows.join(known, "doc_id"), fit_rows, 5))
    pool = in_order(bounded(rows.where(~held_out()).join(known, "doc_id", "left_anti"), fit_rows, 4))
    if len(fit):
        numbers = [views.numbers(_matrix(x["content"]), _matrix(x["page"]), x["source"].to_numpy(), x["lang"].to_numpy()) if len(x) else None for x in (fit, pool)]
        none = tuple(x[:0] for x in numbers[0])
        views.fit(numbers[0], fit["label"].to_numpy(), numbers[1] or none)
    return rows, views


def scored(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every row with doc_id, the chance of good quality by content, by page and by both, and
    ``rejected``."""
    rows, views = fitted(documents, labels, fit_rows)
    sent = documents.sparkSession.sparkContext.broadcast(views)  # some hundred numbers
    names = ["doc_id", "content_score", "page_score", "score", "rejected"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                content, page = (batch[c].flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) for c in ("content", "page"))
                found = sent.value.score(sent.value.numbers(content, page, batch["source"].to_numpy(), batch["lang"].to_numpy()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(found[:, i]) for i in range(3)), pa.array(found[:, 2] < REJECT)], names)

    return rows.mapInArrow(score, "doc_id long, content_score double, page_score double, score double, rejected boolean")


@own_names
def good_documents(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows that are not rejected, with all their columns. They are scored where they
    are read, so no text is shuffled and equal ids do not matter."""
    _, views = fitted(documents, labels, fit_rows)
    sent = documents.sparkSession.sparkContext.broadcast(views)
    own = documents.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                data, bounds = flat_bytes(part["__text"])
                chars = np.maximum(np.nan_to_num(part["__chars"].to_numpy(zero_copy_only=False).astype(float)), 0)
                # Rounded as the numbers that the models were fitted on.
                content, page = (x.astype(np.float32).astype(float) for x in (content_numbers(data, bounds), page_numbers(data, bounds, chars)))
                numbers = sent.value.numbers(content, page, part["__source"].to_numpy(), part["__lang"].to_numpy())
                yield part.filter(pa.array(sent.value.score(numbers)[:, 2] >= REJECT)).select(own)

    rows = documents.withColumns({
        "__text": F.col("text").cast("string"), "__chars": F.col("n_chars").cast("double"), "__source": _hashed("source"), "__lang": _hashed("lang"),
    })
    return small_batches(rows).mapInArrow(keep, documents.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with both views' scores and the verdict."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
