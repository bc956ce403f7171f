"""Text files of any size, read by many tasks as chunks that end at a chosen byte.

Spark splits the files and each task reads its range piece by piece, every piece up to and with the
byte; a few megabytes of pieces make a chunk. What a chunk does to a reader (inside a quoted text or
not, how deep in brackets) is summed up for every state that the reader may be in, so the state at
the start of each chunk follows from the chunks before it without reading them in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfront.staging import stage

CHUNK_BYTES = 4 << 20
#: What a chunk carries of the one before it, for a name that the border cuts.
TAIL_BYTES = 1000

_KEYS = "file string, size bigint, block bigint, part int, text binary"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of a batch that come from one range of one file."""
    names = batch.column("file").dictionary_encode().indices.to_numpy()
    starts = batch.column("block").to_numpy()
    cuts = np.flatnonzero((np.diff(names) != 0) | (np.diff(starts) != 0)) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    yield from zip(edges, edges[1:])


def _texts(column: pa.Array, most: int) -> Iterator[bytes]:
    """The column's texts one after another, cut between rows into chunks of at most so many bytes."""
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        to = min(to, len(column))
        yield data[int(ends[at]) : int(ends[to])].to_pybytes()
        at = to


def chunks(
    spark: SparkSession, path: str, end: str, columns: str, summary: Callable[[bytes], tuple]
) -> DataFrame:
    """``file, size, block, part, text`` and the ``columns`` that ``summary`` gives of the text, staged.

    Chunks of a file are ordered by ``block, part``. Each piece ends with ``end``, so the file's last
    chunk may end with one that the file does not have.
    """
    pieces = spark.read.option("lineSep", end).text(path).select(
        F.concat(F.col("value").cast("binary"), F.lit(end).cast("binary")).alias("text"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"),
    )
    schema, most = f"{_KEYS}, {columns}", CHUNK_BYTES
    names = [c.split()[0] for c in schema.split(", ")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = None, 0
        for batch in batches:
            for first, last in _runs(batch) if batch.num_rows else ():
                file, size, block = (batch.column(n)[first].as_py() for n in ("file", "size", "block"))
                if (file, block) != before:
                    before, part = (file, block), 0
                for text in _texts(batch.column("text").slice(first, last - first), most):
                    row = (file, size, block, part, text, *summary(text))
                    part += 1
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)}, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return stage(pieces.mapInArrow(gather, schema), "chunks")


def in_file() -> Window:
    """Chunks of a file in order. A row stands for megabytes of text and must not carry them."""
    return Window.partitionBy("file").orderBy("block", "part")


def before(value: Column | str) -> Column:
    """Sum of a whole-number column over the chunks before this one."""
    rows = in_file().rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


#: What cuts chunks: ``kind`` says what a row holds; ``ats`` and ``texts`` are a chunk's whole records, in one row.
CUTS = "file string, kind string, block bigint, part int, at int, run bigint, text binary, ats array<int>, texts array<binary>"


def apply(
    chunked: DataFrame, states: DataFrame, columns: str, cut: Callable[[dict], list[tuple]]
) -> DataFrame:
    """Rows that ``cut`` makes of each chunk, given its row with the columns of ``states``; staged."""
    joined = chunked.select("file", "block", "part", "text").join(states, ["file", "block", "part"])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(columns))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                made = cut(batch.slice(at, 1).to_pylist()[0])
                if made:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), f.type) for c, f in zip(zip(*made), arrow)], schema=arrow
                    )

    return stage(joined.mapInArrow(work, columns), "cuts")


def put_together(cuts: DataFrame, closed: bool) -> DataFrame:
    """``file, place, text`` of all records: those inside chunks, and those of which the parts ``first``, ``middle`` and ``last``
    lie in several. With ``closed`` only those that have an end."""
    inside = cuts.where("kind = 'records'").selectExpr("file", "block", "part", "inline(arrays_zip(ats, texts)) AS (at, text)")
    place = F.struct("block", "part", "at")
    parts = cuts.where("kind IN ('first', 'middle', 'last')").groupBy("file", "run").agg(
        F.min(F.when(F.col("kind") == "first", place)).alias("place"), F.bool_or(F.col("kind") == "last").alias("ended"),
        F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("parts"),
    ).where(F.col("place").isNotNull() & (F.col("ended") | F.lit(not closed)))
    joined = F.expr("aggregate(parts, cast('' AS binary), (all, p) -> concat(all, p.text))").alias("text")
    return inside.select("file", place.alias("place"), "text").unionByName(parts.select("file", "place", joined))
