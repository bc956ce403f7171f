"""Whitening of embeddings along the directions of largest variance.

The fit list holds every distinct vector once. Its centred rows are reduced to one triangle by blockwise QR: each
task folds its rows into a triangle of its own, triangles are folded together a few at a time, and
only the last one reaches the driver, whose size depends on the dimensions alone. ``bidiagonal`` takes the
variances and directions from it. All rows are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm import bidiagonal
from shopfront.llm.vectors import blocks, lists, matrix, totals, whole
from shopfront.staging import release, stage

LARGEST = 1 << 61  # components that differ by a long at most
FAN = 16  # triangles that are folded together

RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)
SUMS = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])


class Mean:
    """The mean ``total / n`` of whole numbers, in two parts, so that centring loses no digits."""

    def __init__(self, total: list[int], n: int):
        self.n = n
        self.floor = np.array([t // n for t in total], np.int64)
        self.rest = np.array([t % n for t in total], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n * x - total) ** 2`` of each row, exactly; ``None`` beyond a long."""
        apart = x - self.floor
        widest = float(np.abs(apart.astype(np.float64)).max(initial=0.0))
        if max(widest, 1.0) * max(widest, float(self.n)) * x.shape[1] >= 2.0**62:
            apart = apart.astype(object)
        squares = (apart * apart).sum(axis=1).tolist()
        crossed = (apart * self.rest).sum(axis=1).tolist()
        own = sum(r * r for r in self.rest.tolist())
        exact = (self.n * (self.n * s - 2 * c) + own for s, c in zip(squares, crossed))
        return [d if d < 1 << 63 else None for d in exact]


def fold(rows: np.ndarray) -> np.ndarray:
    """Upper triangle with as many rows as columns whose product is that of ``rows``."""
    triangle = np.linalg.qr(rows, mode="r")
    return np.vstack([triangle, np.zeros((max(0, rows.shape[1] - len(triangle)), rows.shape[1]))])


def triangle(fit: DataFrame, mean: Mean) -> np.ndarray:
    """One triangle for all centred rows."""
    width = len(mean.floor)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in blocks(batches, width):
            rows = mean.centred(matrix(batch.column("x")))
            own = fold(rows if own is None else np.vstack([own, rows]))
        if own is not None:
            yield pa.record_batch(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([own.tobytes()])], ["part", "r"]
            )

    def join(parts: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(-1, width) for r in parts["r"]])
        return pd.DataFrame({"part": [int(parts["part"].min()) // FAN], "r": [fold(stacked).tobytes()]})

    folded = stage(fit.mapInArrow(reduce, "part bigint, r binary"), "whitening-triangles")
    while folded.count() > 1:
        joined = folded.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(join, "part bigint, r binary")
        folded = stage(joined, "whitening-triangles")
    return np.frombuffer(folded.first()["r"]).reshape(-1, width)


def whiten(table: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row and component.

    Components ``c`` of a vector become ``floor(scale * c)``. Vectors that are null, empty, or hold null or
    non-finite components take no part; nor do those of another length than most (ties: the shorter) or
    with a component beyond 2^61 once rounded. Repeated rows and rows without ``vec_id`` come out as often
    as they stand, while the fit list has each vector once. Directions without variance cannot
    be whitened and do not come out, so equal vectors, a single one, or none give no row. A
    deviation beyond a long is null. Other columns are not read.
    """
    spark = table.sparkSession
    kept = stage(whole(table, scale, LARGEST).where(F.size("x") > 0), "whitening-vectors")
    widths = kept.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], RESULT)
    width = widths[0]["width"]
    kept = kept.where(F.size("x") == width)
    fit = stage(kept.select("x").distinct(), "whitening-fit")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, width):
            x = matrix(batch.column("x"))
            # halves of the bits, so that no sum of a block leaves a long
            sums = np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), [len(x)]])
            yield pa.record_batch([pa.array([0], pa.int32()), lists(sums[None, :])], schema=SUMS)

    *sums, n = totals(fit.mapInArrow(add, "cluster int, sums array<bigint>"))[0]
    mean = Mean([(high << 32) + low for high, low in zip(sums[:width], sums[width:])], n)

    reduced = triangle(fit, mean)
    squares, directions = bidiagonal.right_vectors(reduced, components)
    if not len(squares):
        return spark.createDataFrame([], RESULT)
    spread = np.sqrt(squares / n)
    explained = (squares / (reduced**2).sum()).tolist()
    turn = directions.T / spread

    def square(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(spread) + 1, len(spread)))
        for batch in blocks(batches, width):
            white = mean.centred(matrix(batch.column("x"))) @ turn
            sums[:-1] += white.T @ white
            sums[-1] += white.sum(axis=0)
        yield pa.record_batch([lists(sums.reshape(1, -1))], ["sums"])

    each = fit.mapInArrow(square, "sums array<double>").select(F.posexplode("sums").alias("place", "part"))
    added = each.groupBy("place").agg(F.sum("part").alias("total")).orderBy("place").collect()
    sums = np.array([r["total"] for r in added]).reshape(-1, len(spread)) / n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(spread))).max())
    release(fit)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(spread)
        for batch in blocks(batches, width):
            x = matrix(batch.column("x"))
            each = np.repeat(np.arange(len(x)), m)
            yield pa.record_batch(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(each), n)), pa.array(mean.deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array((mean.centred(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(project, RESULT)
