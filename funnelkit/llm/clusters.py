"""Operator 11: centroid clustering by equal-average equal-variance search.

Lloyd's rounds on whole numbers. The nearest centroid of a vector is found without
measuring all of them: centroids are sorted by the mean of their components, and the
search goes outward from the vector's own mean, the nearer side first. With ``d``
components, sums ``S`` and deviations ``V`` (``V`` squared is ``d`` times the sum of
squares less the square of ``S``), the squared distance of a vector and a centroid is
at least ``(S - S')^2 / d``, and at least ``((S - S')^2 + (V - V')^2) / d``. Once the
first bound is above the best distance so far, so it is for every centroid further out
and the search ends; a centroid whose second bound is above it is passed over.
What is left is measured in whole numbers, so distances, ties (the smaller number wins)
and means (floor of sum by count) are exact and the same in any order of rows.

Vectors are worked through in Arrow batches, all rows of a batch a step further out at
a time. A round's sums are added up in each task, then by (cluster, component): a task
sends one row a centroid, so a cluster that holds a third of all vectors is no hot key.
Centroids alone reach the driver (``k`` times ``d`` numbers, whatever the input), and
go to the workers in the function. Every pass reads the input again; assignments with
their distances are written once to the checkpoint folder, before their sums are taken.

Vectors that are null, do not have ``d`` components, or hold a null, non-finite or (in
whole numbers) larger than ``vectors.LARGEST`` component take no part. Centroids start
as the vectors with the ``k`` smallest hashes of their id, null ids last and equal
hashes by components; with fewer vectors there are fewer centroids. Repeated rows count
as often as they come. Columns besides id and vector are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.batches import columns_kept
from funnelkit.llm.tables import written
from funnelkit.llm.vectors import integer_rows

CENTROIDS, ROUNDS, DIM, SCALE = 16, 3, 64, 64
BLOCK = 4096  # vectors searched at a time


class Centroids:
    """Centroids in order of their means, with what the inequalities need."""

    def __init__(self, points: np.ndarray):
        sums = points.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.points, self.sums = points[self.order], sums[self.order]
        self.spread = _spread(self.points, self.sums)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of every row's nearest centroid, and how many
        distances were measured."""
        n, d = x.shape
        k = len(self.order)
        total = x.sum(axis=1)
        spread = _spread(x, total)
        best = np.full(n, np.iinfo(np.int64).max)
        which = np.full(n, k)
        high = np.searchsorted(self.sums, total)
        low = high - 1
        active, measured = np.arange(n), 0
        while len(active):
            lo, hi, s = low[active], high[active], total[active]
            down = np.where(lo >= 0, s - self.sums[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            up = np.where(hi < k, self.sums[np.minimum(hi, k - 1)] - s, np.iinfo(np.int64).max)
            below = down <= up
            gap = np.where(below, down, up)
            # neither side is left, or the nearer one is too far by its mean
            known = best[active] < np.iinfo(np.int64).max
            done = (lo < 0) & (hi >= k)
            far = np.zeros(len(active), dtype=bool)
            far[known & ~done] = gap[known & ~done] ** 2 > d * best[active[known & ~done]]
            stay = ~(done | far)
            active, below, gap = active[stay], below[stay], gap[stay]
            at = np.where(below, low[active], high[active])
            low[active[below]] -= 1
            high[active[~below]] += 1
            # the deviations' inequality, with room for rounding
            a, b = spread[active], self.spread[at]
            apart = np.maximum(np.abs(a - b) - 1e-9 * (a + b), 0)
            limit = best[active].astype(np.float64) * d
            close = gap.astype(np.float64) ** 2 + apart ** 2 <= limit * (1 + 1e-9)
            rows, at = active[close], at[close]
            measured += len(rows)
            distance = ((x[rows] - self.points[at]) ** 2).sum(axis=1)
            number = self.order[at]
            better = (distance < best[rows]) | ((distance == best[rows]) & (number < which[rows]))
            best[rows[better]] = distance[better]
            which[rows[better]] = number[better]
        return which, best, measured


def _spread(x: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``d`` times the standard deviation of each row, from whole numbers."""
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - total * total).astype(np.float64))


def _blocks(batches, vector: str, dim: int, scale: int):
    """Blocks of ``(batch, rows, vectors)`` of the vectors that take part."""
    for batch in batches:
        rows, lengths, values = integer_rows(batch, vector, scale)
        fits = lengths == dim
        rows, x = rows[fits], values[np.repeat(fits, lengths)].reshape(-1, dim)
        for at in range(0, len(rows), BLOCK):
            yield batch, rows[at:at + BLOCK], x[at:at + BLOCK]


def _summed(points: np.ndarray, scale: int):
    """A task's row for each of its clusters: vectors and sums of components."""
    k, dim = points.shape

    def work(batches):
        search = Centroids(points)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for _, _, x in _blocks(batches, "v", dim, scale):
            which, _, _ = search.nearest(x)
            np.add.at(sums, which, x)
            counts += np.bincount(which, minlength=k)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found], pa.int64()),
                                          pa.array(sums[found].tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])
    return work


def _assigned(points: np.ndarray, scale: int):
    def work(batches):
        search = Centroids(points)
        for batch, rows, x in _blocks(batches, "v", points.shape[1], scale):
            which, best, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(which, pa.int32()),
                                              pa.array(best, pa.int64())], names=["k", "cluster", "distance"])
    return work


def _kept(dim: int, scale: int):
    def work(batches):
        for batch, rows, x in _blocks(batches, "v", dim, scale):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)),
                                              pa.array(list(x), pa.list_(pa.int64()))], names=["k", "v"])
    return work


def first_centroids(own: DataFrame, k: int, dim: int, scale: int) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes of their ids, smallest first."""
    kept = own.mapInArrow(_kept(dim, scale), columns_kept(own.schema, ["k"]) + ", v array<bigint>")
    hashed = kept.select(F.sha2(F.concat(F.lit("1:"), F.col("k").cast("string")), 256).alias("h"), "v")
    rows = hashed.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64).reshape(-1, dim)


def centroid_clusters(df: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = CENTROIDS,
                      rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Key, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of every vector that takes part, after ``rounds`` rounds."""
    own = df.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    points = first_centroids(own, k, dim, scale)
    for _ in range(rounds if len(points) else 0):
        sums = own.mapInArrow(_summed(points, scale), "cluster int, n bigint, sums array<bigint>")
        rows = sums.select("cluster", "n", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at") \
            .agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()  # k * dim rows
        points = points.copy()
        for r in rows:
            points[r.cluster, r["at"]] = r.s // r.n
    found = written(own.mapInArrow(_assigned(points, scale), columns_kept(own.schema, ["k"])
                                   + ", cluster int, distance bigint"), "clusters")
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # at most k rows
    whole = sum(inertia.values())
    facts = [(c, n, whole, hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest())
             for c, n in inertia.items()]
    table = df.sparkSession.createDataFrame(facts, "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(table), F.col("cluster") == F.col("c")) \
        .select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
