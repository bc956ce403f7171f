"""Nearest neighbours by inner product along shifted Hilbert curves.

Every curve has its own random projection and shift. Vectors lie on it in the order of their Hilbert
keys; Spark range-partitions them into blocks, and a query looks into the blocks around its place on
every curve. What the windows hold is scored, merged and ranked exactly.

How wide windows must be depends on the vectors. A bounded sample of queries is answered by a full
scan, and the width is the least at which the windows hold the wanted share of the true neighbours.
Blocks are sized from the row count, so that curves of small tables have many blocks too. Only where
the windows measured on all curves together hold as many blocks as one whole curve, as for vectors that
fill all their dimensions evenly, a single curve is read from end to end, block by block.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, pick
from shopfront.staging import stage

CURVES, AXES, BITS = 4, 6, 10  # curves; axes of a projection; bits an axis
BLOCK_ROWS, BLOCKS = 8192, 64  # rows a block at most, and blocks a curve at least where rows allow
SAMPLE_QUERIES, SAMPLE_VECTORS, RECALL = 64, 4096, 0.95
QUERIES_A_TASK = 2048


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points given by integer cells: [points, axes], ``bits`` each.

    Bit by bit from the top: where an axis has the bit, the lower bits of the first axis are turned
    round, elsewhere exchanged with that axis; then Gray decoding and interleaving.
    """
    x = cells.astype(np.int64).T.copy()
    axes, top = len(x), np.int64(1 << (bits - 1))
    step = top
    while step > 1:
        low = step - 1
        for axis in range(axes):
            has = (x[axis] & step) != 0
            exchange = np.where(has, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(has, low, exchange)
            x[axis] ^= exchange
        step >>= 1
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turned, step = np.zeros_like(x[0]), top
    while step > 1:
        turned ^= np.where((x[axes - 1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turned
    key = np.zeros(cells.shape[0], np.int64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = (key << 1) | ((x[axis] >> bit) & 1)
    return key


class Curves:
    """Projections and shifts. An extra coordinate brings all vectors to one length, so that the
    nearest point is the one of largest inner product; queries are scaled to that length."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.turns = rng.standard_normal((CURVES, sample.shape[1] + 1, AXES)) / np.sqrt(sample.shape[1])
        self.shifts = rng.random((CURVES, AXES)) * 0.5
        spread = self.extended(sample) @ self.turns
        self.middle, self.width = spread.mean(axis=1, keepdims=True), 4 * spread.std(axis=1, keepdims=True) + 1e-12

    def extended(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1, keepdims=True), 0))
        return np.hstack([vectors, rest])

    def keys(self, vectors: np.ndarray, queries: bool) -> np.ndarray:
        """[vectors, CURVES]"""
        if queries:
            scaled = vectors * (self.longest / np.sqrt((vectors**2).sum(axis=1, keepdims=True)))
            points = np.hstack([scaled, np.zeros((len(vectors), 1))])
        else:
            points = self.extended(vectors)
        placed = (points @ self.turns - self.middle) / self.width + 0.5
        cells = np.clip((placed * 0.5 + self.shifts[:, None, :]) * (1 << BITS), 0, (1 << BITS) - 1)
        return np.stack([hilbert_key(c, BITS) for c in cells.astype(np.int64)], axis=1)


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, vector`` (the components as bytes of doubles) of the vectors that take part."""
    fit = pick(table, vec_id="bigint", embedding="array<double>").where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    one = fit.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"vec_id": rows["vec_id"], "size": [len(v) for v in rows["embedding"]],
                "vector": [np.array(v, np.float64).tobytes() for v in rows["embedding"]]}

    return by_batch(one, "vec_id bigint, size int, vector binary", work)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best of ``vectors`` for each query, its own row left out: exact, ties to smaller ids.

    A product of matrices ranks first. Its rounding error is bounded by the lengths of the two vectors, so
    whatever may be among the best is scored again. Very large numbers are halved as often as keeps
    products finite; a score beyond a double is infinite.
    """
    out = []
    down = [max(0, math.frexp(float(np.abs(m).max(initial=0.0)))[1] - 400) for m in (queries, vectors)]
    queries, vectors = np.ldexp(queries, -down[0]), np.ldexp(vectors, -down[1])
    reach = vectors.shape[1] * 2.0**-51 * np.sqrt((vectors**2).sum(axis=1)) if len(vectors) else np.zeros(0)
    for first in range(0, len(queries), 256):
        part = queries[first : first + 256]
        scores = part @ vectors.T
        slack = np.sqrt((part**2).sum(axis=1))[:, None] * reach[None, :]
        scores[query_ids[first : first + 256, None] == ids[None, :]] = -np.inf
        for at, row in enumerate(scores):
            if len(row) > k:
                sure = np.partition(row - slack[at], len(row) - k)[len(row) - k]  # so much k of them have at least
                near = np.flatnonzero((row + slack[at] >= sure) & (row > -np.inf))
            else:
                near = np.flatnonzero(row > -np.inf)
            exact = np.array([math.fsum(p) for p in (vectors[near] * part[at]).tolist()])
            with np.errstate(over="ignore"):
                exact = np.ldexp(exact, sum(down))
            order = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(order), query_ids[first + at]), ids[near][order], exact[order]))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    return pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})


RESULT = "query_id bigint, vec_id bigint, score double"


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def full_scan(queries: tuple[np.ndarray, np.ndarray], vectors: DataFrame, k: int) -> DataFrame:
    """Answers a few queries, held by every task, against all vectors."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        if not rows["vec_id"]:
            return {"query_id": [], "vec_id": [], "score": []}
        return best(*queries, matrix(rows["vector"]), np.array(rows["vec_id"]), k).to_dict("list")

    return top(by_batch(vectors, RESULT, work), k)


def places(vectors: DataFrame, curves: Curves, queries: bool) -> DataFrame:
    """``vec_id, curve, key``: every vector's place on every curve."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        if not rows["vec_id"]:
            return {"vec_id": [], "curve": [], "key": []}
        keys = curves.keys(matrix(rows["vector"]), queries)
        return {"vec_id": np.repeat(rows["vec_id"], CURVES).tolist(),
                "curve": list(range(CURVES)) * len(keys), "key": keys.ravel().tolist()}

    return by_batch(vectors, "vec_id bigint, curve int, key bigint", work)


def block_rows(rows: int, k: int) -> int:
    """Rows a block: few enough for ``BLOCKS`` blocks a curve, but more than ``k``, so that a window
    of one block already holds ``k`` others."""
    return min(BLOCK_ROWS, max(k + 1, math.ceil(rows / BLOCKS)))


def search(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product for every vector
    whose id ``every`` divides, itself left out.

    Null or zero vectors, and vectors with null or non-finite components, take no part; nor do rows
    without ``vec_id`` or vectors of another length than most. Repeated rows count once; of several
    vectors under one id the smallest counts. With fewer than ``k`` candidates all come out, with none
    no row. Other columns are not read.
    """
    spark = table.sparkSession
    vectors = stage(usable(table), "ann-vectors")
    sizes = vectors.groupBy("size").count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    size, rows = sizes[0]
    vectors = vectors.where(F.col("size") == size).select("vec_id", "vector")
    queries = vectors.where(F.col("vec_id") % every == 0)
    mixed = F.xxhash64("vec_id")
    sample = matrix([r.vector for r in vectors.orderBy(mixed, "vec_id").limit(SAMPLE_VECTORS).collect()])

    def lengths(part: dict[str, list]) -> dict[str, list]:
        return {"length": np.sqrt((matrix(part["vector"]) ** 2).sum(axis=1)).tolist() if part["vector"] else []}

    longest = by_batch(vectors, "length double", lengths).agg(F.max("length")).first()[0]
    curves = Curves(sample, longest)
    block_size = block_rows(rows, k)
    blocks = max(1, math.ceil(rows / block_size))

    # every curve's vectors in order, cut into blocks by range partitioning
    keyed = places(vectors, curves, False)
    ordered = keyed.repartitionByRange(CURVES * blocks, "curve", "key", "vec_id")
    placed = stage(ordered.withColumn("part", F.spark_partition_id()), "ann-places")
    # a row for each part of a curve: its first key and its block. However finely Spark has cut the
    # range, parts make up blocks by the rows they hold, numbered from 0 on each curve
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    block = F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / block_size).cast("int")
    edges = placed.groupBy("curve", "part").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("rows"))
    edges = stage(edges.withColumn("block", block), "ann-edges")
    last = edges.groupBy().agg(F.max("block")).first()[0]
    placed = placed.join(edges.select("curve", "part", "block"), ["curve", "part"]).select("vec_id", "curve", "block")
    query_places = _query_blocks(places(queries, curves, True), edges)

    width = _width(vectors, queries, query_places, placed, k)
    used = CURVES
    if CURVES * (2 * width + 1) > last:  # windows read no less than a whole curve, which is exact
        joint = max(1, BLOCK_ROWS // block_size)  # blocks that are scored together, as all are
        placed, query_places = (t.withColumn("block", F.floor(F.col("block") / joint).cast("int"))
                                for t in (placed, query_places))
        last //= joint
        used, width = 1, last
    here = placed.where(F.col("curve") < used).join(vectors, "vec_id")
    reach = F.sequence(F.greatest(F.col("block") - width, F.lit(0)), F.least(F.col("block") + width, F.lit(last)))
    asked = query_places.where(F.col("curve") < used).withColumn("block", F.explode(reach)).join(
        queries.withColumnRenamed("vec_id", "query_id"), "query_id"
    )
    per_block = rows / every * (2 * width + 1) / (last + 1)
    chunks = max(1, math.ceil(min(per_block, rows / every) / QUERIES_A_TASK))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    here = here.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return best(matrix(list(left["vector"])), left["query_id"].to_numpy(),
                    matrix(list(right["vector"])), right["vec_id"].to_numpy(), k)

    group = ("curve", "block", "chunk")
    found = asked.groupBy(*group).cogroup(here.groupBy(*group)).applyInPandas(compare, RESULT)
    return top(found, k)


def _query_blocks(keyed: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, curve, block``: the last block that starts at or before the query's key.

    Starts and queries of a slice of the curve, one of 256 by the key's top bits, are sorted together;
    a slice without an earlier start takes the last block of the slices before it.
    """
    slice_of = F.shiftright("key", AXES * BITS - 8).cast("int").alias("slice")
    starts = edges.select("curve", F.col("first").alias("key"), "block", F.lit(None).cast("bigint").alias("query_id"))
    both = starts.unionByName(keyed.select(
        "curve", "key", F.lit(None).cast("int").alias("block"), F.col("vec_id").alias("query_id")
    )).withColumn("slice", slice_of)
    ends = both.groupBy("curve", "slice").agg(F.max("block").alias("end"))
    earlier = Window.partitionBy("curve").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    opens = ends.select("curve", "slice", F.max("end").over(earlier).alias("open"))
    inside = Window.partitionBy("curve", "slice").orderBy("key", F.col("query_id").asc_nulls_first())
    at = F.max("block").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("at", at).where("query_id IS NOT NULL").join(opens, ["curve", "slice"])
    return found.select("query_id", "curve", F.coalesce("at", "open", F.lit(0)).alias("block"))


def _width(vectors: DataFrame, queries: DataFrame, query_places: DataFrame, placed: DataFrame, k: int) -> int:
    """Blocks to look into on either side, from a sample of queries answered in full."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).collect()
    if not few:
        return 0
    held = (matrix([r.vector for r in few]), np.array([r.vec_id for r in few]))
    truth = full_scan(held, vectors, k).select("query_id", "vec_id")  # at most SAMPLE_QUERIES * k rows
    near = truth.join(query_places.withColumnRenamed("block", "at"), "query_id").join(placed, ["vec_id", "curve"])
    apart = near.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("at") - F.col("block"))).alias("apart"))
    found = np.sort([row["apart"] for row in apart.collect()])
    return int(found[min(len(found) - 1, math.ceil(RECALL * len(found)))]) if len(found) else 0
