"""Clusters against a plain computation with Python's integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import centroids as m

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, dims, k, rounds, scale=1024, seed=3):
    own = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    grid = [[math.floor(Fraction(x) * scale) for x in v] for _, v in own]
    order = sorted(range(len(own)), key=lambda j: (own[j][0] is None, hashlib.sha256(f"{seed}:{own[j][0]}".encode()).hexdigest(), own[j][1]))
    points = [grid[j] for j in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(points))

    for _ in range(rounds):
        found = [nearest(q)[1] for q in grid]
        for i in range(len(points)):
            members = [q for q, f in zip(grid, found) if f == i]
            if members:
                points[i] = [sum(c) // len(members) for c in zip(*members)]
    fit = lambda d: d if d < 1 << 63 else None
    return sorted(((i, c, fit(d)) for (i, _), (d, c) in zip(own, map(nearest, grid))), key=repr), points


def check(spark, rows, dims, k, rounds, **more):
    found = m.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=rounds, dims=dims, **more)
    ours = sorted(map(tuple, found.vectors.collect()), key=repr)
    assert (ours, found.centroids) == brute(rows, dims, k, rounds)
    return found


@pytest.mark.parametrize("leading", [0, 1, 5])
def test_equals_plain_rounds(spark, leading):
    rng = np.random.default_rng(leading)
    middle = rng.normal(size=(6, 5))
    rows = [(i, (middle[i % 6] + rng.normal(scale=0.2, size=5)).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, middle[0].tolist(), 0) for i in range(200)]  # a third are equal
    check(spark, rows, 5, 8, 4, leading=leading)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), 0.0], 0) for i in range(40)]
    check(spark, rows, 2, 4, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (1, [0.75, -0.25], 0), (None, [1.0, 2.0], 0), (None, None, 0), (2, None, 0),
        (3, [], 0), (4, [1.0], 0), (5, [1.0, None], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, 2.0, 3.0], 0), (9, [-0.0, -1e-9], None),
    ]
    found = check(spark, rows, 2, 3, 2)
    assert found.vectors.count() == 5
    check(spark, rows, 2, 8, 2)  # more centroids than vectors


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i), 2.0**i], 0) for i in range(0, 60, 3)] + [(100, [1e300, -1e300], 0), (101, [1e300, -1e300], 0), (102, [3e8, 2.0**70], 0)]
    found = check(spark, rows, 2, 4, 3)
    assert m.inertias(found)[1] is None


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = m.cluster(empty, dims=2)
    assert found.vectors.columns == ["vec_id", "cluster", "distance"] and found.vectors.count() == 0 and found.centroids == []
    rows = [(i, [float(i), 1.0], i) for i in range(9)]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("cluster", "distance", "grid", "near", "rest", "large")})
    assert sorted(map(tuple, m.cluster(clash, 2, 2, 2).vectors.collect())) == brute(rows, 2, 2, 2)[0]


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert m.op11_centroids(spark, str(tmp_path)).collect() == []


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(1)
    grid = np.rint(rng.normal(size=(2000, 64)) * 30 + rng.integers(0, 8, 2000)[:, None] * 100).astype(np.int64)
    extended = grid - grid.mean(0)
    turn = m.Rotation(grid.mean(0), np.linalg.eigh(extended.T @ extended)[1][:, ::-1], 8)
    centroids = m.Centroids([grid[grid[:, 0] // 100 == c][0].tolist() if (grid[:, 0] // 100 == c).any() else grid[c].tolist() for c in range(8)], turn)
    cluster, distance, measured = centroids.nearest(grid, *turn(grid))
    every = ((grid[:, None] - centroids.grid) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured < 2 * len(grid)
