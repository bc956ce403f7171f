"""Left lookup joins that stay even however many keys own much of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are told apart; one that comes after has less than a hundred-thousandth of all rows.
MAX_HOT_KEYS = 100_000
_NULL_SALTS = 4096  # rows without a key match nothing, so they go anywhere


def frequent(table: DataFrame, key: str, min_rows: int) -> list[tuple[str, int]]:
    """Keys with at least ``min_rows`` rows, which would burden one task, and their rows: the most frequent first.

    Counts are summed up where the rows lie and only then shuffled.
    """
    counts = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") >= min_rows).orderBy(F.desc("n"), key).limit(MAX_HOT_KEYS)
    return [(row[key], row["n"]) for row in heavy.collect()]


def hot_keys(table: DataFrame, key: str, min_rows: int) -> list[str]:
    return [name for name, _ in frequent(table, key, min_rows)]


def lookup(
    left: DataFrame,
    right: DataFrame,
    key: str,
    min_hot_rows: int = 1_000_000,
    some_keys_null: bool = False,
) -> DataFrame:
    """``left`` left-joined to ``right``, which has one row per key, of any width.

    Rows of a hot key are dealt out over as many salts as leave ``min_hot_rows`` to each, and the key's row
    of ``right`` is there once a salt, so no task gets more of it than of any other. Only key names
    and counts are broadcast, at most ``MAX_HOT_KEYS`` of them. With ``some_keys_null``, rows without a key are
    dealt out too, as they match nothing. Call it on a staged ``left``: its keys are counted first.
    """
    hot = frequent(left, key, min_hot_rows)
    if not hot and not some_keys_null:
        return left.join(right, key, "left")
    copies = [(name, -(-rows // min_hot_rows)) for name, rows in hot]
    kind = left.schema[key].dataType.simpleString()
    salts = F.broadcast(left.sparkSession.createDataFrame(copies, f"`{key}` {kind}, _copies bigint"))
    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_copies", F.lit(1)))
    none = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_NULL_SALTS))
    salt = F.when(F.col(key).isNull(), none).otherwise(drawn)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_copies", F.lit(1)) - 1))
    # key and salt as one value: a side that already lies by the key alone must not decide how rows are dealt
    dealt = left.join(salts, key, "left").withColumn("_salted", F.struct(F.col(key).alias("k"), salt.alias("s"))).drop("_copies")
    copied = right.where(F.col(key).isNotNull()).join(salts, key, "left").withColumn("_s", every).select(
        F.struct(F.col(key).alias("k"), F.col("_s").alias("s")).alias("_salted"), *(f"`{c}`" for c in right.columns if c != key)
    )
    return dealt.join(copied, "_salted", "left").drop("_salted")
