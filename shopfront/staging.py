"""Results that later steps read more than once are written to the cluster's shared folder.

The folder is the one named in ``spark.checkpoint.dir``, so a lost executor costs nothing that
is already staged. Parquet keeps column pruning and gives the planner real sizes.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@functools.cache
def _local_folder(application: str) -> str:
    """One machine and nothing configured: a test or a bench run."""
    return tempfile.mkdtemp(prefix=f"shopfront-{application}-")


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write ``table`` once and return it read back."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/shopfront/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def lay_out(table: DataFrame, name: str, key: str, dealt: bool = False) -> DataFrame:
    """Write ``table`` once in buckets by ``key`` and return it read back.

    Joins and groupings on the key, whatever columns they take, then find it laid out as they need it: the
    table is dealt out once and never again, only what meets it is. With ``dealt`` it is known to lie by the key
    already, as the result of a grouping by it does.
    """
    spark = table.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/shopfront/{named}"
    rows = table if dealt else table.repartition(buckets, key)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(named)
    return spark.table(named)


def release(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more; other tables are left alone."""
    spark = table.sparkSession
    root = f"{shared_folder(spark)}/shopfront/"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = files.makeQualified(path).toString().rstrip("/") + "/"
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(whole.split(":", 1)[-1].lstrip("/")):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def spread(table: DataFrame) -> DataFrame:
    """Rows of a small scan dealt out over all cores, before work that is heavy per row.

    A table read in at least as many tasks as there are cores, as any large one is, stays as
    it is: nothing is shuffled then.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores)
