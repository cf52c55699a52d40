"""Quality: held-out accuracy, co-training, hostile rows."""

import numpy as np

from keyfold.llm import quality as q
from keyfold.llm.toxicity import held_out


def test_held_out_accuracy_and_clean_documents_stay(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = q.op2_quality(spark, at).withColumn("h", held_out()).join(labels, "doc_id").toPandas()
    found = rows[rows.h]
    y = found.quality.to_numpy() == 1
    rank = found.score.rank().to_numpy()
    assert (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.95
    assert rows[rows.quality == 1].rejected.mean() < 0.02


def test_pseudo_labels_help_the_other_view():
    rng = np.random.default_rng(2)
    n = 4000
    y = (rng.random(n) < 0.5).astype(int)
    content = (y * 2 - 1)[:, None] * 1.5 + rng.normal(size=(n, 3))
    page = (y * 2 - 1)[:, None] * 0.25 + rng.normal(size=(n, 30))
    views = q.Views(np.zeros((2, 3)), np.zeros((2, 30)))
    few, pool = slice(0, 60), slice(60, 3000)
    accuracy = []
    for rounds in (0, 5):
        views.fit((content[few], page[few]), y[few], (content[pool], page[pool]), rounds=rounds)
        accuracy.append(((views.score((content[3000:], page[3000:]))[:, 1] > 0.5) == y[3000:]).mean())
    assert accuracy[1] > accuracy[0]


def test_hostile_rows(spark):
    good, bad = "A plain line of words. ", "%%% ### $$$ && "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5), "s", "en", i) for i in range(120)]
    rows += [(None, good, None, None, None), (300, None, "s", "en", 5), (301, "", "s", None, -1), (302, "\n\n" + "y" * 300_000, "S", "xx", 10**12), (1, good, "s", "en", 1)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, lang string, n_chars long, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    found = q.scored(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.rejected == (r.score < q.REJECT) for r in found)
    late = {r.doc_id: r.score for r in found if r.doc_id and 100 <= r.doc_id < 120}
    assert all((s > 0.5) == bool(i % 2) for i, s in late.items())
    none = q.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and not any(r.rejected for r in none)
    assert q.scored(docs.limit(0), labels).count() == 0


def test_fits_are_bounded_and_the_same_each_time(spark):
    text = lambda i: ("A plain line of words. " if i % 2 else "%%% ### $$$ && ") * (1 + i % 5)
    rows = [(5, text(i), "s", "en", i) for i in range(900)] + [(None, text(i), "s", "en", i) for i in range(300)] + [(i, text(i), "s", "en", i) for i in range(10, 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 70)] + [(5, 1)], "doc_id long, quality int")
    runs = [sorted(((r.doc_id, r.score) for r in q.scored(docs.repartition(n), labels, 200).collect()), key=repr) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
