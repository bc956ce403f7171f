"""Centroid clustering in whole numbers, with a table of distances to fixed pivots.

Every vector's distances to a few pivots are measured once and stored beside it. In a round, the
centroids' distances to the same pivots bound each distance from below (the difference of two sides
of a triangle is no longer than the third), so only centroids that the bounds leave over get an exact
distance. Vectors never move: a round reads them where they lie and puts out one row of sums for each
task and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm.vectors import blocks, lists, matrix, totals, whole
from shopfront.staging import release, stage

PIVOTS = 8
#: Pivots are chosen from this many vectors, taken by a hash of the id; all vectors are measured.
PIVOT_SAMPLE = 1024
#: Components up to here, so that a squared distance of 64 of them fits a long.
LARGEST = 1 << 27
SLACK = 1e-14  # more than what roots and differences lose to rounding


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, in longs."""
    apart = left - right
    return np.einsum("nd,nd->n", apart, apart)


def spans(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances [vectors, pivots] as doubles."""
    return np.sqrt(np.stack([squared(vectors, p) for p in pivots], axis=1).astype(np.float64))


def choose_pivots(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Vectors far apart: each next one has the largest sum of distances to those chosen."""
    chosen = [0]
    far = np.zeros(len(sample))
    while len(chosen) < min(wanted, len(sample)):
        far += np.sqrt(squared(sample, sample[chosen[-1]]).astype(np.float64))
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    return sample[chosen]


def nearest(
    vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, reach: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid (ties: the smaller number) of each vector,
    and how many exact distances that took. ``table`` and ``reach`` hold distances to the pivots."""
    low = np.zeros((len(vectors), len(centroids)))
    for pivot in range(table.shape[1]):
        own, other = table[:, pivot, None], reach[None, :, pivot]
        np.maximum(low, np.abs(own - other) - SLACK * (own + other), out=low)
    low *= low
    cluster = low.argmin(axis=1)
    best = squared(vectors, centroids[cluster])
    measured = len(vectors)
    first = cluster.copy()
    for number in range(len(centroids)):
        left = np.flatnonzero((low[:, number] * (1 - SLACK) <= best) & (first != number))
        if not len(left):
            continue
        measured += len(left)
        there = squared(vectors[left], centroids[number])
        nearer = (there < best[left]) | ((there == best[left]) & (number < cluster[left]))
        best[left[nearer]] = there[nearer]
        cluster[left[nearer]] = number
    return cluster, best, measured


ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
SUMS = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])


def cluster(
    table: DataFrame, k: int = 16, rounds: int = 3, dimensions: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector.

    Components become ``floor(scale * x)``. The ``k`` vectors with the smallest SHA-256 of
    ``seed:vec_id`` are the first centroids; each round assigns all vectors and moves every centroid that has
    some to the floor of their mean; then all are assigned once more. Vectors that are null, of another
    length, or hold null or non-finite components take no part, nor do those with a component beyond
    2^27 once rounded, whose distances no long holds. Repeated rows count and come out as often as they
    stand; of rows with one id the smaller vector comes first as a centroid. Rows without ``vec_id`` are
    assigned, but never a first centroid. With fewer than ``k`` vectors there are fewer clusters, with none no
    rows. An inertia beyond a long is null. Other columns are not read.
    """
    spark = table.sparkSession
    kept = whole(table, scale, LARGEST).where(F.size("x") == dimensions)
    sampled = kept.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(PIVOT_SAMPLE).select("x").collect()
    pivots = choose_pivots(np.array([r.x for r in sampled], np.int64).reshape(-1, dimensions), PIVOTS) if sampled else None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, dimensions):
            vectors = matrix(batch.column("x"))
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), lists(spans(vectors, pivots))], ["vec_id", "x", "apart"])

    columns = "vec_id bigint, x array<bigint>, apart array<double>"
    measured = stage(kept.mapInArrow(measure, columns), "cluster-vectors")
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = measured.where("vec_id IS NOT NULL").orderBy(code, "x").limit(k).select("x").collect()
    centroids = np.array([r.x for r in first], np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )

    for _ in range(rounds):
        reach = spans(centroids, pivots)

        def add(batches: Iterator[pa.RecordBatch], centroids=centroids, reach=reach) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(centroids), dimensions + 1), np.int64)  # the last place counts
            for batch in blocks(batches, dimensions):
                vectors = matrix(batch.column("x"))
                numbers, _, _ = nearest(vectors, matrix(batch.column("apart")), centroids, reach)
                for number in np.unique(numbers):
                    members = vectors[numbers == number]
                    sums[number, :-1] += members.sum(axis=0)
                    sums[number, -1] += len(members)
            found = np.flatnonzero(sums[:, -1]).astype(np.int32)
            yield pa.record_batch([pa.array(found), lists(sums[found])], schema=SUMS)

        moved = totals(measured.mapInArrow(add, "cluster int, sums array<bigint>"))
        for number, (*total, count) in moved.items():
            centroids[number] = [value // count for value in total]

    reach = spans(centroids, pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, dimensions):
            numbers, apart, _ = nearest(matrix(batch.column("x")), matrix(batch.column("apart")), centroids, reach)
            yield pa.record_batch([batch.column("vec_id"), pa.array(numbers.astype(np.int32)), pa.array(apart)], schema=ASSIGNED)

    assigned = stage(measured.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"), "cluster-assigned")
    release(measured)
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    everything = sum(int(r.total) for r in inertia)
    rows = [
        (r.cluster, _long(int(r.total)), _long(everything),
         hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest())
        for r in inertia
    ]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # at most k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None
