"""What the operators on whole-number vectors share: rounding down in the JVM, matrices in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm.common import pick

BLOCK_VALUES = 1 << 20  # components that are held as one matrix


def whole(table: DataFrame, scale: int, largest: int) -> DataFrame:
    """``vec_id, x``: every component ``c`` as ``floor(scale * c)``, for vectors without null or
    non-finite components. A vector with a component beyond ``largest`` once rounded is left out."""
    numbers = pick(table, vec_id="bigint", embedding="array<double>").where(
        "embedding IS NOT NULL AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c)"
        f" AND abs(c) <= {largest // scale}D)"
    )
    return numbers.select("vec_id", F.expr(f"transform(embedding, c -> floor(c * {scale}))").alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel()))


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that vectors of ``width`` components stay small as a matrix."""
    step = max(1, BLOCK_VALUES // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def totals(partial: DataFrame) -> dict[int, list[int]]:
    """Sums by place of the ``sums`` of each ``cluster``: whole numbers of any size, one row a place."""
    each = partial.select("cluster", F.posexplode("sums").alias("place", "part"))
    added = each.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, list[int]] = {}
    for row in added.orderBy("cluster", "place").collect():
        out.setdefault(row["cluster"], []).append(int(row["total"]))
    return out
