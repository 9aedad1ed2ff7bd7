"""Centroid clustering with geometric drift tightening (after Rysavy and Hamerly 2016).

A vector keeps one lower bound: no centroid but its own is nearer than that. When centroids move, a bound must
be loosened. The full drift of the moved centroid is always enough, but the vectors of a cluster lie within a
sphere around their centroid, and in the plane through the sphere's centre and both places of the moved
centroid one sees how much nearer the latter can have come to any point of the sphere: see ``tightened``.
Vectors whose exact distance to their own centroid stays below the bound keep it; the others are ambiguous and
are measured against all centroids. All decisions rest on integer distances; bounds only skip work.

Spark holds vectors and bounds in a written table, one per round; the driver sees centroids and counts alone.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage

#: Components are held within this bound, so that squared distances of 64 components fit 63 bits.
LARGEST = 1 << 26
#: Up to this size floating-point products of up to 256 components are exact.
_EXACT = 1 << 21
STATE = "vec_id long, point array<int>, cluster int, distance long, bound double, scans int"


def tightened(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """An upper bound on |x - old| - |x - new| over all x within ``radius`` of ``centre``; at most |old - new|.

    Let m be the midpoint of old and new, and a the angle at m between the direction to ``new`` and that to the
    centre. Points with |x - old| - |x - new| > s * |old - new|, s >= 0, lie inside a branch of a hyperbola
    around ``new``, hence inside the cone at m of half angle acos(s) about the axis. The sphere is seen from m
    under asin(radius / distance), so it stays outside of the cone of half angle a - asin(radius / distance).
    """
    axis = new - old
    drift = float(np.sqrt(axis @ axis))
    if drift == 0.0:
        return 0.0
    to_centre = centre - (old + new) / 2.0
    far = float(np.sqrt(to_centre @ to_centre))
    if far <= radius:
        return drift  # the sphere reaches the midpoint
    along = float(to_centre @ axis) / (far * drift)
    angle = np.arccos(min(1.0, max(-1.0, along))) - np.arcsin(radius / far)
    if angle <= 0.0:
        return drift
    return drift * max(0.0, float(np.cos(angle)))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the bounds of its vectors must be lowered: the largest tightened drift of any other."""
    k = len(old)
    a, b = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(k)
    for i in range(k):
        for j in range(k):
            if i != j and radius[i] >= 0:
                out[i] = max(out[i], tightened(a[i], radius[i], a[j], b[j]))
    # room for rounding
    return out * (1.0 + 1e-9) + 1e-6 * (out > 0)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids."""
    top = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if top <= _EXACT and points.shape[1] <= 256 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def own_squared(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    gap = points - centroids[cluster]
    return np.einsum("ij,ij->i", gap, gap)


def assign(points: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, distance, bound, whether scanned) of each vector; ``bound`` is already loosened."""
    cluster, bound = cluster.copy(), bound.copy()
    distance = own_squared(points, centroids, cluster)
    unclear = np.sqrt(distance) * (1.0 + 1e-9) + 1e-6 >= bound
    rows = np.flatnonzero(unclear)
    if len(rows):
        d = squared(points[rows], centroids)
        best = d.argmin(axis=1)  # the first of equals: the smaller number
        at = np.arange(len(rows))
        cluster[rows], distance[rows] = best, d[at, best]
        if d.shape[1] > 1:
            d[at, best] = np.iinfo(np.int64).max
            bound[rows] = np.sqrt(d.min(axis=1))
        else:
            bound[rows] = np.inf
    return cluster, distance, bound, unclear


def usable(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """(vec_id, point) of the vectors that take part: floor(scale * x) of each component."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    step = lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), scale * v.cast("double"))))
    return (
        vectors.select("vec_id", "embedding").filter((F.size(x) == width) & whole & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: step(v).cast("int")).alias("point"))
    )


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans), one row per vector that takes part.

    ``vectors``: vec_id, embedding. Those of exactly ``width`` components, none null or non-finite, and with an id take
    part, each row for itself; components become floor(scale * x), held within ``LARGEST``. Centroids start as the ``k``
    vectors with the smallest sha256 of "seed:vec_id" (all, if fewer; of repeated ids the smaller vector first), and
    are replaced ``rounds`` times by their vectors' floor(mean); empty ones stay. Ties go to the smaller number.
    A sum of distances beyond 63 bits is null.
    ``scans`` counts the assignments (of rounds + 1) that had to measure all centroids. No vectors give no rows.
    Extra columns are ignored. The driver holds k centroids and k counts and sums, never vectors.
    """
    spark = vectors.sparkSession
    points = usable(vectors, width, scale)
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = points.orderBy(name, "point").limit(k).toArrow()  # k rows
    centroids = np.array(first.column("point").to_pylist(), np.int64).reshape(-1, width)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
        )
    loosen = np.zeros(len(centroids))
    state = points.select(
        "vec_id", "point", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
        F.lit(float("-inf")).alias("bound"), F.lit(0).alias("scans"),
    )
    sums = [F.sum(F.get("point", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(width)]
    for turn in range(rounds + 1):

        def step(batches: Iterator[pa.RecordBatch], centroids=centroids, loosen=loosen) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = b.column(1).flatten().to_numpy()
                rows = flat.reshape(-1, width).astype(np.int64)
                was = b.column(2).to_numpy().astype(np.int64)
                cluster, distance, bound, scanned = assign(rows, centroids, was, b.column(4).to_numpy() - loosen[was])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()),
                     pa.array(bound, pa.float64()), pa.array(b.column(5).to_numpy() + scanned, pa.int32())],
                    ["vec_id", "point", "cluster", "distance", "bound", "scans"],
                )

        state = cut_lineage(state.mapInArrow(step, STATE), f"centroids-{turn}")
        if turn == rounds:
            break
        # at most k rows, summed before the shuffle
        found = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *sums).collect()
        moved, radius = centroids.copy(), np.full(len(centroids), -1.0)
        for r in found:
            moved[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
            radius[r["cluster"]] = np.sqrt(r["far"]) * (1.0 + 1e-9)
        loosen, centroids = loosening(centroids, moved, radius), moved
    inertia = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    each = [r["cluster_inertia"] for r in inertia]
    total = None if None in each or sum(each) >> 63 else sum(each)
    facts = spark.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], total, centroid_digest(centroids[r["cluster"]])) for r in inertia],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    # at most k rows
    return state.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )
