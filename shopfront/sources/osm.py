"""OpenStreetMap elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfront.sources import json_scan

_POINT = [T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]
_LINE = T.ArrayType(T.StructType(_POINT))
ELEMENT_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        *_POINT,
        T.StructField("center", T.StructType(_POINT)),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
#: What elements have beside that if their shape was asked for: the nodes of a way, the members of a relation,
#: and the positions of either, in the element itself.
SHAPE_SCHEMA = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("geometry", _LINE),
        T.StructField(
            "members",
            T.ArrayType(
                T.StructType(
                    [T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), *_POINT, T.StructField("geometry", _LINE)]
                )
            ),
        ),
    ]
)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of ``{"elements": [...]}`` documents of any size; a document without any gives none."""
    return _parsed(json_scan.records(spark, path, member="elements"), "text")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Elements of such documents with the columns of ``SHAPE_SCHEMA``."""
    return _parsed(json_scan.records(spark, path, member="elements"), "text", SHAPE_SCHEMA)


def read_element_lines(spark: SparkSession, path: str) -> DataFrame:
    """Elements written one per line, which Spark can split: the form for large extracts."""
    return _parsed(spark.read.text(path).where("value RLIKE r'\\S'"), "value")


def _parsed(texts: DataFrame, column: str, more: T.StructType | None = None) -> DataFrame:
    """Elements from their texts. Of repeated keys the last counts, of repeated tags too."""
    schema = T.StructType([*ELEMENT_SCHEMA.fields, *(more.fields if more else ())])
    elements = texts.select(F.from_json(column, schema).alias("element")).select("element.*")
    last = """if(size(map_keys(tags)) = size(array_distinct(map_keys(tags))), tags,
        map_from_entries(transform(array_distinct(map_keys(tags)),
          k -> named_struct('key', k, 'value', element_at(filter(map_entries(tags), e -> e.key = k), -1).value))))"""
    return elements.withColumn("tags", F.expr(last))
