"""What the operators of this subpackage share: choosing columns and walking Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(table: DataFrame, **wanted: str) -> DataFrame:
    """The columns named by the keywords, cast to the keywords' types, and no others.

    A name is looked up exactly first and without regard to case second, and read by position,
    so further columns whose names clash (``Text`` beside ``text``, or two of one name) do no harm.
    """
    flat = table.toDF(*(f"_{at}" for at in range(len(table.columns))))
    return flat.select(
        *(F.col(f"_{position(table, name)}").cast(kind).alias(name) for name, kind in wanted.items())
    )


def documents(table: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, a null text as an empty one."""
    return pick(table, doc_id="bigint", text="string").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Has Spark pass rows to Python in batches of at most ``BATCH_BYTES``, unless the session says otherwise.
    By default a batch grows to 64 MB, which the executor and the worker both hold, for each core."""
    spark.conf.set(_BATCH_BYTES, spark.conf.get(_BATCH_BYTES, str(BATCH_BYTES)))


def by_row(table: DataFrame, walk: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``walk`` over batches of whole rows; all columns stay, under names of their own meanwhile, as a
    table may have names that clash."""
    bounded(table.sparkSession)
    flat = table.toDF(*(f"_{at}" for at in range(len(table.columns))))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walk(batches)
        give_back()

    return flat.mapInArrow(whole, flat.schema).toDF(*table.columns)


def position(table: DataFrame, name: str) -> int:
    """Place of the column ``name``, or else of one that differs by case alone."""
    names = table.columns
    return names.index(name) if name in names else [n.lower() for n in names].index(name.lower())


#: Ids up to here, some 100 MB as a hash table, are broadcast; more of them meet their rows by a shuffle.
MOST_IDS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """A staged table of ids and little else, marked for broadcast if it has at most ``MOST_IDS`` rows, so that
    whole texts need not be shuffled to meet a few of them."""
    return F.broadcast(ids) if ids.limit(MOST_IDS + 1).count() <= MOST_IDS else ids


SLICE_ROWS, SLICE_BYTES = 1000, 2 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut into parts of at most so many rows, and so many bytes of texts unless one row has more:
    what a part becomes in Python does not grow with the length of texts."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


_held: list[Any] = [None, None]


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by this Python worker for as long as it is asked for the same key.

    A worker serves one operator after another. It keeps the helper of one at a time, with all that it
    has learned; the one before is given up, and its memory given back.
    """
    if _held[0] != key:
        let_go()
        _held[:] = [key, make()]
    return _held[1]


def let_go() -> None:
    """Gives up the helper that this worker keeps. A step that needs none calls it, or else its workers
    would carry the helper of the step before all the while."""
    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that is free in this worker goes back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def by_batch(
    table: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list]]
) -> DataFrame:
    """``work`` turns the columns of a batch, as lists, into the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    bounded(table.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_pydict(work(part.to_pydict()), schema=arrow)
        give_back()

    return table.mapInArrow(walk, schema)
