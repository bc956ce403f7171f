"""What the queries write for themselves: documents in one file each, and rows dealt out over all cores."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shopfront.queries import registry


@pytest.fixture
def small_partitions(spark):
    """Shuffles are coalesced to a few kilobytes a task, as large ones are to many megabytes."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for name in names:
        spark.conf.set(name, "4k")
    yield spark
    for name in names:
        spark.conf.unset(name)


def test_a_document_with_its_ends_is_one_file(small_partitions, tmp_path):
    lines = small_partitions.range(4000).selectExpr("id % 10 AS doc", "id AS ord", "concat(id, ' ', sha2(string(id), 256)) AS line")
    path = str(tmp_path / "documents")
    registry._write_documents(registry._enclosed(lines, "'['", "']'"), path)
    files = list(Path(path).glob("doc=*/*.txt"))
    assert len(files) == 10
    for file in files:
        first, *records, last = file.read_text().splitlines()
        numbers = [int(r.removeprefix(", ").split()[0]) for r in records]
        assert (first, last) == ("[", "]") and numbers == list(range(numbers[0], 4000, 10)) and len(numbers) == 400


def test_customers_of_one_small_file_are_dealt_out(spark, sf_dir):
    rows = registry._customer_records(spark, sf_dir)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).count()
    assert tasks.count() == spark.sparkContext.defaultParallelism
    assert tasks.agg(F.sum("count")).first()[0] == registry.table(spark, sf_dir, "customer").count()
