"""Centroid clustering of vectors on an integer grid, filtered by rotated coordinates.

1. A vector's component x becomes the integer floor(scale * x). All assignments and all
   new centroids are computed from these integers, exactly.
2. The principal axes of all vectors give a rotation. Each vector is written once with its
   ``leading`` first rotated coordinates and the norm of the others.
3. In a round, the squared distance of the leading coordinates plus the squared difference
   of the two residual norms is a lower bound of the squared distance to a centroid: what
   the residuals add is least where they point the same way. The centroid with the least
   bound is measured first, in integers; the others only where their bound does not exceed
   that distance. The bounds are floats, so they are lowered by ``SLACK`` of the vectors'
   own squares, some thousand times their rounding error.
4. A task sums up its vectors by cluster; what meets in the shuffle is a few rows a task.
   Sums travel as base-2**40 digits, so that they are exact at every size.

On the driver are the centroids and one matrix of the size of a vector squared.

Defined results: a vector that is null, has another number of components, or a null or
non-finite one, is left out. Centroids start as the ``k`` vectors with the smallest hash of
their id; a vector without an id comes after all others, and vectors of one id by their
components. With fewer vectors than ``k`` there are as many centroids as vectors. Repeated
rows count each. A component beyond 2**24 in size is worked with in Python's integers, and a
distance or inertia that does not fit 64 bits is null. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import materialize, table

DIMS, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LEADING = 24  # rotated coordinates kept
SLACK = 1e-9
SMALL = 1 << 24  # components below it are worked with in 64 bits
_DIGIT = 40


@dataclass(frozen=True)
class Rotation:
    """The mean of all vectors and their principal axes, one a column, the longest first."""

    mean: np.ndarray
    axes: np.ndarray
    leading: int

    def __call__(self, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and residual norm of each row."""
        turned = (grid - self.mean) @ self.axes
        return turned[:, : self.leading], np.sqrt((turned[:, self.leading :] ** 2).sum(1))


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """(vec_id, embedding) of the vectors that count."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return own.where((F.size("embedding") == dims) & F.forall("embedding", good))


def on_grid(embeddings: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, list[list[int] | None]]:
    """Integer components of each vector; those of a large one stand in the list, as zeros in the matrix."""
    x = embeddings.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    large = (np.abs(x) >= SMALL / scale).any(1)
    grid = np.floor(np.where(large[:, None], 0.0, x) * scale).astype(np.int64)
    whole = lambda v: int(v) * scale if abs(v) >= 1 << 53 else int(np.floor(v * scale))
    return grid, [[whole(float(v)) for v in x[i]] if large[i] else None for i in range(len(x))]


def rotation(vectors: DataFrame, dims: int, scale: int, leading: int) -> Rotation:
    """Principal axes of all vectors but the large ones, from sums over each task's vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            grid, _ = on_grid(batch["embedding"], dims, scale)
            extended = np.hstack([np.ones((len(grid), 1)), grid])
            total += extended.T @ extended
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])

    parts = vectors.mapInArrow(moments, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
    total = np.zeros((dims + 1) ** 2)
    for row in parts.groupBy("at").agg(F.sum("v").alias("v")).toLocalIterator():
        total[row["at"]] = row["v"]
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[0, 0], 1.0)
    mean = total[0, 1:] / n
    _, axes = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), min(leading, dims))


def rotated(vectors: DataFrame, turn: Rotation, dims: int, scale: int) -> DataFrame:
    """(vec_id, grid, near, rest, large): integers, leading coordinates, residual norm; or the integers as text."""
    schema = pa.schema([("vec_id", pa.int64()), ("grid", pa.binary()), ("near", pa.binary()), ("rest", pa.float64()), ("large", pa.string())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid, large = on_grid(batch["embedding"], dims, scale)
            near, rest = turn(grid)
            texts = [None if v is None else ",".join(map(str, v)) for v in large]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], _rows(grid.astype("<i4")), _rows(near.astype("<f8")), pa.array(rest), pa.array(texts, pa.string())], schema=schema
            )

    return vectors.mapInArrow(write, "vec_id long, grid binary, near binary, rest double, large string")


def _rows(matrix: np.ndarray) -> pa.Array:
    """The bytes of each row of a matrix."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Centroids:
    """Integer centroids with their rotated coordinates."""

    def __init__(self, points: list[list[int]], turn: Rotation):
        self.points = points
        self.small = all(abs(v) < SMALL for p in points for v in p)
        if self.small:
            self.grid = np.array(points, np.int64).reshape(len(points), len(turn.mean))
            self.near, self.rest = turn(self.grid)

    def nearest(self, grid: np.ndarray, near: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each vector's nearest centroid, the squared distance, and how many distances were measured."""
        parts = near[:, None, :] - self.near[None, :, :]
        bound = np.einsum("nkl,nkl->nk", parts, parts) + (rest[:, None] - self.rest) ** 2
        squares = ((near**2).sum(1) + rest**2)[:, None] + (self.near**2).sum(1) + self.rest**2
        bound -= SLACK * squares
        cluster = bound.argmin(1)
        distance = ((grid - self.grid[cluster]) ** 2).sum(1)
        open_ = bound <= distance[:, None]
        open_[np.arange(len(grid)), cluster] = False
        measured = len(grid)
        for k in range(len(self.points)):
            rows = np.flatnonzero(open_[:, k])
            measured += len(rows)
            there = ((grid[rows] - self.grid[k]) ** 2).sum(1)
            better = (there < distance[rows]) | ((there == distance[rows]) & (k < cluster[rows]))
            cluster[rows[better]], distance[rows[better]] = k, there[better]
        return cluster, distance, measured

    def nearest_large(self, point: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(point, c)), k) for k, c in enumerate(self.points))[::-1]


def _assigned(batch: pa.RecordBatch, centroids: Centroids, dims: int, leading: int) -> tuple[np.ndarray, list[int] | np.ndarray, np.ndarray, list]:
    """Cluster and distance of each row, the rows' integers, and those of the rows to be added one by one."""
    grid = _matrix(batch["grid"], "<i4", dims).astype(np.int64)
    texts = batch["large"]
    if centroids.small:
        cluster, distance, _ = centroids.nearest(grid, _matrix(batch["near"], "<f8", leading), batch["rest"].to_numpy())
        odd = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False)) if texts.null_count < len(texts) else []
    else:
        cluster, distance, odd = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64), range(len(grid))
    alone = []
    if len(odd):
        distance = distance.tolist()
    for i in odd:
        point = grid[i].tolist() if texts[i].as_py() is None else list(map(int, texts[i].as_py().split(",")))
        cluster[i], distance[i] = centroids.nearest_large(point)
        if texts[i].is_valid:
            alone.append((int(cluster[i]), point))
    return cluster, distance, grid, alone


def moved(written: DataFrame, centroids: Centroids, dims: int, leading: int) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors; empty ones stay."""
    k = len(centroids.points)
    schema = pa.schema([("cluster", pa.int32()), ("digit", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (dims + 1) for _ in range(k)]
        for batch in batches:
            cluster, _, grid, alone = _assigned(batch, centroids, dims, leading)
            counts = np.bincount(cluster, minlength=k)
            for c in np.flatnonzero(counts):
                here = [int(counts[c]), *grid[cluster == c].sum(0).tolist()]
                sums[c] = [a + b for a, b in zip(sums[c], here)]
            for c, point in alone:  # zeros in the matrix
                sums[c] = [sums[c][0], *(a + b for a, b in zip(sums[c][1:], point))]
        out = []
        for c in range(k):
            digit, left = 0, sums[c]
            while any(v not in (0, -1) for v in left):
                out.append((c, digit, [v & ((1 << _DIGIT) - 1) for v in left]))
                left, digit = [v >> _DIGIT for v in left], digit + 1
            if any(left):
                out.append((c, digit, left))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    parts = written.mapInArrow(add, "cluster int, digit int, sums array<long>").select("cluster", "digit", F.posexplode("sums").alias("at", "v"))
    sums = [[0] * (dims + 1) for _ in range(k)]
    for row in parts.groupBy("cluster", "digit", "at").agg(F.sum("v").alias("v")).collect():  # k * (dims + 1) numbers, digit by digit
        sums[row["cluster"]][row["at"]] += row["v"] << (_DIGIT * row["digit"])
    return [[v // s[0] for v in s[1:]] if s[0] else p for s, p in zip(sums, centroids.points)]


def assigned(written: DataFrame, centroids: Centroids, dims: int, leading: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance, _, _ = _assigned(batch, centroids, dims, leading)
                fits = distance if isinstance(distance, np.ndarray) else [d if d < 1 << 63 else None for d in distance]
                yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], schema=schema)

    return written.mapInArrow(assign, "vec_id long, cluster int, distance long")


@dataclass(frozen=True)
class Clustering:
    """``vectors`` (vec_id, cluster, distance) and the integer centroids that they are nearest to."""

    vectors: DataFrame
    centroids: list[list[int]]


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, leading: int = LEADING
) -> Clustering:
    """Lloyd's rounds over all vectors (vec_id, embedding), and one more assignment."""
    own = kept(vectors, dims)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = own.orderBy(order.asc_nulls_last(), "embedding").limit(k).select("embedding").collect()
    turn = rotation(own, dims, scale, leading)
    written = materialize(rotated(own, turn, dims, scale), "rotated")
    starts = pa.array([r["embedding"] for r in chosen], pa.list_(pa.float64()))
    grid, large = on_grid(starts, dims, scale)
    points = [g if v is None else v for g, v in zip(grid.tolist(), large)]
    for _ in range(rounds if points else 0):
        after = moved(written, Centroids(points, turn), dims, turn.leading)
        if after == points:
            break  # the next rounds would find the same
        points = after
    last = Centroids(points, turn)
    return Clustering(materialize(assigned(written, last, dims, turn.leading), "assigned"), points)


def inertias(found: Clustering) -> tuple[list[int | None], int | None]:
    """The distances summed over each cluster and over all; None where one is, or beyond 64 bits."""
    whole = F.count("distance") == F.count(F.lit(1))
    rows = found.vectors.groupBy("cluster").agg(F.when(whole, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()  # k rows
    sums: dict[int, int | None] = {r["cluster"]: None if r["s"] is None else int(r["s"]) for r in rows}
    fit = lambda v: v if v is not None and v < 1 << 63 else None
    total = None if None in sums.values() else sum(v for v in sums.values() if v is not None)
    return [fit(sums.get(c, 0)) for c in range(len(found.centroids))], fit(total)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in eight clusters after ten rounds."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    by_cluster, total = inertias(found)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]

    def of_cluster(values: list, kind: str) -> Column:
        held = F.array(*(F.lit(v).cast(kind) for v in values)) if values else F.array().cast(f"array<{kind}>")
        return F.get(held, F.col("cluster"))

    return found.vectors.select(
        "vec_id",
        "cluster",
        "distance",
        of_cluster(by_cluster, "long").alias("cluster_inertia"),
        F.lit(total).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"),
    )


def _rounds_sql() -> str:
    distance = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.q) AS q, arg_min(c.c, {distance} * {K} + c.c) AS c, "
            f"min({distance}) AS d FROM v, c{r} c GROUP BY v.r)"
        )
        if r < ROUNDS:
            steps.append(
                f"m{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY c, i), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(any_value(w.q), any_value(c.q)) AS q FROM c{r} c LEFT JOIN "
                f"(SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS HUGEINT) ORDER BY i) AS q FROM m{r} GROUP BY c) w ON w.c = c.c GROUP BY c.c)"
            )
    return ", ".join(steps)


#: The same rounds with every distance measured.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q, embedding
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, embedding) - 1 AS c, q FROM v
  QUALIFY c < {K}
), {_rounds_sql()}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.c
"""
