"""k-means on integer vectors with ns-bounds: exact, though most distances are never computed.

Each vector keeps an upper bound of the distance to its centroid and lower bounds of the distances to the others,
each with the round in which it was last evaluated. All earlier centroids are kept. A bound is loosened by the norm of
the centroid's total displacement since the bound's own round, which is never more than the sum of the drifts round by
round. Where the loosened bounds cannot tell, the distances in question are evaluated exactly, in integers.

Vectors are never shuffled: a round is one pass of Arrow batches over the table of vectors and bounds, which is written
to the shared folder, and exact sums by centroid, combined within tasks. The driver sees centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.integer_vectors import component_sums, is_scalable, lists, matrix, scaled_down
from ticklane.llm.shared import stored

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
# beyond it a squared distance of 64 components may not fit a long
MOST = 1 << 27
# floating-point bounds are widened by this share
SLACK = 1e-6
STATE = "id long, x array<int>, cluster int, upper double, upper_round int, lower array<float>, lower_round array<int>, evaluated int"


def squared_distances(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = x.astype("int64") - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """Vectors with their centroids and bounds."""

    def __init__(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, upper_round: np.ndarray, lower: np.ndarray, lower_round: np.ndarray):
        self.x, self.cluster, self.upper, self.upper_round, self.lower, self.lower_round = x, cluster, upper, upper_round, lower, lower_round
        self.evaluated = np.zeros(len(x), dtype="int32")

    @classmethod
    def first(cls, x: np.ndarray, centroids: np.ndarray) -> Bounds:
        """All distances are evaluated."""
        squares = np.stack([squared_distances(x, c) for c in centroids], axis=1)
        cluster = squares.argmin(axis=1).astype("int32")  # the first of equal ones
        roots = np.sqrt(squares.astype("float64"))
        own = roots[np.arange(len(x)), cluster]
        new = cls(x, cluster, own * (1 + SLACK), np.zeros(len(x), dtype="int32"), (roots * (1 - SLACK)).astype("float32"),
                  np.zeros(squares.shape, dtype="int32"))
        new.evaluated += len(centroids)
        return new

    def reassign(self, history: np.ndarray) -> None:
        """Move every vector to the nearest of the last centroids; ties go to the smaller number."""
        now = len(history) - 1
        centroids = history[now]
        gap = (centroids[None] - history).astype("float64")
        moved = np.sqrt((gap * gap).sum(axis=2)) * (1 + SLACK)
        k = len(centroids)
        upper = self.upper + moved[self.upper_round, self.cluster]
        lower = self.lower.astype("float64") - moved[self.lower_round, np.arange(k)]
        lower[np.arange(len(self.x)), self.cluster] = np.inf
        rows = np.nonzero(lower.min(axis=1, initial=np.inf) <= upper)[0]
        if not len(rows):
            return
        x, old = self.x[rows], self.cluster[rows]
        own = squared_distances(x, centroids[old])
        root = np.sqrt(own.astype("float64"))
        self.evaluated[rows] += 1
        failed = lower[rows] <= (root * (1 + SLACK))[:, None]
        best, name = own.copy(), old.copy()
        for j in range(k):
            at = np.nonzero(failed[:, j])[0]
            if not len(at):
                continue
            squares = squared_distances(x[at], centroids[j])
            self.lower[rows[at], j] = np.sqrt(squares.astype("float64")) * (1 - SLACK)
            self.lower_round[rows[at], j] = now
            self.evaluated[rows[at]] += 1
            nearer = (squares < best[at]) | ((squares == best[at]) & (j < name[at]))
            best[at[nearer]], name[at[nearer]] = squares[nearer], j
        left = np.nonzero(name != old)[0]
        self.lower[rows[left], old[left]] = root[left] * (1 - SLACK)
        self.lower_round[rows[left], old[left]] = now
        self.cluster[rows], self.upper[rows], self.upper_round[rows] = name, np.sqrt(best.astype("float64")) * (1 + SLACK), now

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, lists(self.x.astype("int32")), pa.array(self.cluster.astype("int32")), pa.array(self.upper), pa.array(self.upper_round.astype("int32")),
             lists(self.lower.astype("float32")), lists(self.lower_round.astype("int32")), pa.array(self.evaluated)],
            names=["id", "x", "cluster", "upper", "upper_round", "lower", "lower_round", "evaluated"])


def _begin(vectors: DataFrame, history: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield Bounds.first(matrix(batch.column("x")), history[0]).batch(batch.column("id"))

    return vectors.mapInArrow(assign, STATE)


def _go_on(state: DataFrame, history: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = [batch.column(name).to_numpy(zero_copy_only=False).copy() for name in ("cluster", "upper", "upper_round")]
                bounds = Bounds(matrix(batch.column("x")), *plain, matrix(batch.column("lower")).copy(), matrix(batch.column("lower_round")).copy())
                bounds.reassign(history)
                yield bounds.batch(batch.column("id"))

    return state.mapInArrow(assign, STATE)


def k_means(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1,
            id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """Vectors with ``id``, ``x``, ``cluster``, ``distance`` (squared) and ``evaluated`` (distances of the last round); the centroids.

    Only vectors of ``dims`` components take part, none of them null, non-finite or, times ``scale``, beyond 2**27 either
    way (squared distances would leave a long). Centroids start as the vectors whose ids have the smallest sha256 with
    the seed; null ids come last, rows of one id by their components. Equal rows are rows like others. Fewer vectors
    than ``centroids`` give fewer centroids, no vectors an empty result. Other columns are left out.
    """
    source = F.col(vector_column)
    good = (F.size(source) == dims) & is_scalable(source, scale, MOST)
    kept = stored(vectors.where(good).select(F.col(id_column).cast("long").alias("id"),
                                             scaled_down(source, scale).cast("array<int>").alias("x")))
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(start.asc_nulls_last(), "x").limit(centroids).select("x").collect()
    history = np.array([row.x for row in first], dtype="int64").reshape(1, -1, dims)
    if not first:
        empty = kept.select("id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("evaluated"))
        return empty, []
    state = stored(_begin(kept, history))
    for _ in range(rounds):
        found = component_sums(state, "cluster", "x", dims)
        new = history[-1].copy()
        for cluster, (rows, sums) in found.items():
            new[cluster] = [total // rows for total in sums]
        history = np.concatenate([history, new[None]])
        state = stored(_go_on(state, history))
    last = history[-1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = matrix(batch.column("x")), batch.column("cluster").to_numpy(zero_copy_only=False)
            distance = squared_distances(x, last[cluster]) if len(cluster) else np.zeros(0, dtype="int64")
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), batch.column("cluster"), pa.array(distance), batch.column("evaluated")],
                                             names=["id", "x", "cluster", "distance", "evaluated"])

    found = state.select("id", "x", "cluster", "evaluated").mapInArrow(measure, "id long, x array<int>, cluster int, distance long, evaluated int")
    return found, [[int(c) for c in row] for row in last]


def clustered(vectors: DataFrame, id_column: str = "vec_id", **options) -> DataFrame:
    """One row per vector of :func:`k_means`: its id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` (sums of
    squared distances over the cluster and over all) and ``centroid_sha256`` (of the components, comma-joined)."""
    found, centroids = k_means(vectors, id_column=id_column, **options)
    found = stored(found.select("id", "cluster", "distance"))
    sums = {row.cluster: int(row.total) for row in
            found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    table = [(j, sums.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    names = found.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.join(F.broadcast(names), "cluster").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
