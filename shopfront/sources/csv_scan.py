"""Records of CSV files of any size whose quoted cells may hold line breaks, found by many tasks at once.

Files are read in chunks of whole lines (see ``ranges``). A line break may lie inside a quoted cell, so
each chunk is tried both ways: as if it began with a record, and as if inside a quoted cell. Put
together in order, these small tables of "began so, ends so" give every chunk its true beginning.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfront.sources import ranges
from shopfront.staging import release, stage

_QUOTED = rb'(?:[^"]++|"")*+"[^,\n]*+'  # from behind the opening quote; what follows the closing one stays
_CELL = rb'(?:"' + _QUOTED + rb'|[^",\n][^,\n]*+)?+'
_CELLS = rb"(?:" + _CELL + rb",)*+" + _CELL
_RECORD = re.compile(_CELLS + rb"\n")
_RECORDS = re.compile(rb"(?:" + _CELLS + rb"\n)*+")
_REST = re.compile(_QUOTED + rb"(?:," + _CELLS + rb")?+\n")  # of a record, from inside a quoted cell

SUMMARY = "plain int, quoted int, closes int"


def summary(text: bytes) -> tuple[int, int, int]:
    """Is the end inside a quoted cell: if the start is not, if it is; and does the cell at the start then end
    with its record?"""
    plain = int(_RECORDS.match(text).end() < len(text))
    rest = _REST.match(text)
    quoted = int(rest is None or _RECORDS.match(text, rest.end()).end() < len(text))
    return plain, quoted, int(rest is not None)


def states(chunked: DataFrame) -> DataFrame:
    """``file, block, part, inside, run``: whether a chunk begins in a quoted cell, and the number shared by all parts
    of a record that crosses borders."""
    narrow = chunked.select("file", "block", "part", "plain", "quoted", "closes")
    # a chunk whose two ends differ keeps or turns the state; one whose ends agree settles it
    turned = narrow.withColumn("turns", ranges.before((F.col("plain") > F.col("quoted")).cast("int")) % 2)
    settles = F.when(F.col("plain") == F.col("quoted"), F.col("plain").bitwiseXOR(F.col("turns").cast("int")))
    settled = turned.withColumn("settles", settles)
    earlier = ranges.in_file().rowsBetween(ranges.Window.unboundedPreceding, -1)
    base = F.coalesce(F.last("settles", ignorenulls=True).over(earlier), F.lit(0))
    inside = settled.withColumn("inside", base.bitwiseXOR(F.col("turns").cast("int")))
    cut = F.when(F.col("inside") == 0, 1).otherwise(F.col("closes"))
    return inside.select("file", "block", "part", "inside", ranges.before(cut).alias("run"))


def cut(row: dict) -> list[tuple]:
    """Whole records of a chunk, and the parts of records that cross its borders."""
    text, at = row["text"], 0
    file, block, part, run = row["file"], row["block"], row["part"], row["run"]
    out: list[tuple] = []
    ats: list[int] = []
    texts: list[bytes] = []

    def add(kind: str, at: int, run: int, text: bytes | None, ats: list[int] | None = None, texts: list[bytes] | None = None) -> None:
        out.append((file, kind, block, part, at, run, text, ats, texts))

    if row["inside"]:
        rest = _REST.match(text)
        if rest is None:
            add("middle", 0, run, text)
            return out
        at = rest.end()
        add("last", 0, run, text[:at])
    while at < len(text):
        whole = _RECORD.match(text, at)
        if whole is None:
            add("first", at, run + 1, text[at:])
            break
        record = whole[0]
        if record != b"\n" and record != b"\r\n":  # empty lines are none
            ats.append(at)
            texts.append(record)
        at = whole.end()
    if ats:
        add("records", 0, 0, None, ats, texts)
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, place, text``: one row for each record of each file, the header too; ``place`` orders them.

    Records end with a line feed, or a carriage return and one, outside quoted cells; a quote inside a cell is written
    twice. Empty lines are none. A quoted cell that is never closed ends with its file, a last line break not counted.
    """
    chunked = ranges.chunks(spark, path, "\n", SUMMARY, summary)
    known = stage(states(chunked), "chunk-states")
    cuts = ranges.apply(chunked, known, ranges.CUTS, cut)
    release(chunked)
    found = ranges.put_together(cuts, closed=False)
    text = "make_valid_utf8(cast(text AS string))"
    return found.select("file", "place", F.expr(f"regexp_replace({text}, r'\\r?\\n\\z', '')").alias("text"))


def cells(text: str, width: int) -> str:
    """The cells of a record as an array of ``width`` texts, null where empty or missing."""
    names = [f"c{at}" for at in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    options = "map('quote', '\"', 'escape', '\"', 'maxCharsPerColumn', '-1')"
    return f"transform(array(from_csv({text}, '{schema}', {options})), r -> array({', '.join(f'r.{n}' for n in names)}))[0]"


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``file, names`` of each file's header, and ``file, place, values`` of all further records."""
    found = records(spark, path)
    headers = found.groupBy("file").agg(F.min_by("text", "place").alias("header"), F.min("place").alias("first"))
    headers = stage(headers, "csv-headers")
    widest = headers.agg(F.max(F.expr("length(header) - length(replace(header, ',', '')) + 1"))).first()[0] or 1
    names = headers.select("file", "first", F.expr(cells("header", widest)).alias("names"))
    # one row a file, as in Spark's own file listing
    body = found.join(F.broadcast(names.select("file", "first")), "file").where("place > first")
    return names.select("file", "names"), body.select("file", "place", F.expr(cells("text", widest)).alias("values"))
