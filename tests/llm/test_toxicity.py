"""Toxicity: held-out accuracy, the label model, hostile rows."""

import numpy as np
from pyspark.sql import functions as F

from keyfold.llm import toxicity as t


def test_label_model_finds_classes_and_dependent_voters():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.15
    vote = lambda hit, false: np.where(y, rng.random(len(y)) < hit, rng.random(len(y)) < false).astype(int)
    a, b, c, noise = vote(0.8, 0.02), vote(0.7, 0.03), vote(0.6, 0.01), (rng.random(len(y)) < 0.3).astype(int)
    votes = np.stack([a, b, c, c, noise], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = t.LabelModel(patterns, counts, 4)
    assert [2, 3] in model.groups
    assert abs(model.prior - 0.15) < 0.02
    assert np.allclose(model.accuracies()[:2, 1], [0.8, 0.7], atol=0.06) and abs(model.accuracies()[4, 1] - 0.3) < 0.06


def test_held_out_accuracy(spark, sf_dir):
    rows = t.op1_toxicity(spark, sf_dir.replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    found = rows.where("held_out").join(labels, "doc_id").select("toxic", "score").toPandas()
    rank = found.score.rank().to_numpy()
    y = found.toxic.to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.9


def test_hostile_rows(spark):
    toxic = "you vequx vequy " * 3
    rows = [(i, toxic + f"w{i}" if i % 3 == 0 else f"calm words here n{i}") for i in range(90)]
    rows += [(None, toxic), (200, None), (201, ""), (202, "x" * 200_000), (1, "calm"), (1, "calm")]
    docs = spark.createDataFrame([(i, x, 1, 0.5) for i, x in rows], "doc_id long, text string, toxic int, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    found = t.scored(docs, labels)[0].collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[None] > 0.5 > score[200] == score[201] and min(score[i] for i in range(0, 90, 3)) > 0.5 > score[2]
    none, _ = t.scored(docs, labels.limit(0))
    assert len({r.score for r in none.collect()}) == 1
    assert t.scored(docs.limit(0), labels)[0].count() == 0


def test_the_draw_is_bounded_whatever_the_ids(spark):
    one_id = spark.createDataFrame([(7, f"text {i}") for i in range(3000)] + [(i, "x") for i in range(50)], "doc_id long, text string")
    no_id = one_id.withColumn("doc_id", F.lit(None).cast("long"))
    equal = spark.createDataFrame([(7, "same")] * 3000, "doc_id long, text string")
    for rows in (one_id, no_id, equal):
        drawn = t.bounded(rows.repartition(3), 100, 2)
        assert drawn.count() == 100
        again = t.bounded(rows.repartition(7, "text"), 100, 2)
        assert t.in_order(drawn).equals(t.in_order(again))
    assert t.bounded(one_id, 5000, 2).count() == 3050


def test_equal_scores_over_runs_and_partitions(spark):
    rows = [(7 if i % 2 else None, f"{'vequx vequy' if i % 3 == 0 else 'calm words'} n{i % 40} m{i % 7}") for i in range(600)]
    rows += [(i, f"{'vequx vequy' if i % 3 == 0 else 'calm words'} k{i}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(100, 160)] + [(7, 1)], "doc_id long, toxic int")
    runs = [sorted(((r.doc_id, r.score) for r in t.scored(docs.repartition(n), labels, 120)[0].collect()), key=repr) for n in (2, 5)]
    assert runs[0] == runs[1]
