"""Records of JSON documents of any size, found by many tasks at once.

A document is a list of objects, or an object with lists of objects among its members. Files are read in
chunks that end with a closing brace (see ``ranges``). First each chunk is summed up: its quotes, and for
either state at its start how deep it goes and how shallow it gets. Sums over the chunks
before give each chunk its state; then records are cut out, and those that cross borders are put together.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shopfront.sources import ranges
from shopfront.staging import release, stage

PROBLEM = "expected JSON with records: a list of objects, or an object that holds such a list"

_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_SPACE = b" \t\r\n"
_ITEM = rb'(?:null|true|false|-?[0-9][0-9.eE+-]*|-?Infinity|NaN|"(?:[^"\\]|\\.)*+")'
#: What may stand between two objects of a list: a comma, or items that are no objects between commas.
_BETWEEN = re.compile(rb"\s*,\s*(?:" + _ITEM + rb"\s*,\s*)*+", re.S)
#: What may stand between two objects in an object: commas, further members, and the next one's name.
_NAMED = re.compile(rb"\s*,\s*(?:" + _ITEM + rb"\s*[:,]\s*)++", re.S)


def _quotes(text: bytes, values: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    found = np.flatnonzero(values == ord('"'))
    if b"\\" not in text:
        return found
    slashes = np.flatnonzero(values == ord("\\"))
    starts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    lengths = np.diff(starts, append=len(slashes))
    ends = slashes[starts] + lengths
    return np.setdiff1d(found, ends[lengths % 2 == 1], assume_unique=True)


def _brackets(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``quotes, places, steps, odd``: brackets with the parity of the quotes before them."""
    values = np.frombuffer(text, np.uint8)
    quotes = _quotes(text, values)
    steps = _STEP[values]
    places = np.flatnonzero(steps)
    return quotes, places, steps[places].astype(np.int64), np.searchsorted(quotes, places) & 1


SUMMARY = "quotes int, deep0 bigint, low0 bigint, deep1 bigint, low1 bigint, lead string, tail binary"


def summary(text: bytes) -> tuple:
    """Parity of quotes; depth gained and lowest depth, starting outside or inside a text; first letter."""
    quotes, _, steps, odd = _brackets(text)
    out = [len(quotes) & 1]
    for inside in (0, 1):
        depth = np.cumsum(steps[odd == inside])
        out += [int(depth[-1]), min(0, int(depth.min()))] if len(depth) else [0, 0]
    lead = text.lstrip(_SPACE)[:1].decode("latin-1") or None
    return (*out, lead, text[-ranges.TAIL_BYTES :])


def states(chunked: DataFrame) -> DataFrame:
    """``file, block, part, inside, depth, level, run, ahead``: a row for each chunk.

    ``level`` is the depth at which the file's records lie; ``run`` counts the chunks before this one that get
    down to it, so all parts of a record that crosses borders have one number.
    """
    order = ranges.in_file()
    narrow = chunked.select("file", "size", "block", "part", F.octet_length("text").alias("length"), *(c.split()[0] for c in SUMMARY.split(", ")))
    first = F.first("lead", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = narrow.withColumn("inside", ranges.before("quotes") % 2).withColumn("top", first)
    gained = inside.select(
        "*", F.when(F.col("inside") == 0, F.col("deep0")).otherwise(F.col("deep1")).alias("gain"),
        F.when(F.col("inside") == 0, F.col("low0")).otherwise(F.col("low1")).alias("low"),
        F.when(F.col("top") == "[", 1).otherwise(2).alias("level"),
    )
    depth = gained.withColumn("depth", ranges.before("gain"))
    cut = (F.col("depth") + F.col("low") <= F.col("level")).cast("int")
    return depth.select(
        "file", "size", "block", "part", "length", "inside", "depth", "gain", "quotes", "top", "level",
        ranges.before(cut).alias("run"), F.lag("tail").over(order).alias("ahead"),
    )


CUTS = f"{ranges.CUTS}, value string"


def _name(text: bytes, quotes: np.ndarray, colon: int, ahead: bytes | None) -> str:
    """The member name that ends before a colon; its start may lie in the chunk before."""
    last = int(np.searchsorted(quotes, colon)) - 1
    if last >= 1:
        raw = text[quotes[last - 1] + 1 : quotes[last]]
    else:
        earlier = ahead or b""
        own = _quotes(earlier, np.frombuffer(earlier, np.uint8))
        raw = (earlier[own[-1] + 1 :] if len(own) else earlier) + text[: quotes[0] if len(quotes) else 0]
    return json.loads(b'"' + raw + b'"', strict=False)


def _members(text: bytes, quotes: np.ndarray, row: dict, places: np.ndarray, depth: np.ndarray) -> list[tuple]:
    """``at, kind of value, name`` of the members of the document's own object."""
    colons = np.flatnonzero(np.frombuffer(text, np.uint8) == ord(":"))
    colons = colons[(np.searchsorted(quotes, colons) & 1) == row["inside"]]
    at = np.searchsorted(places, colons) - 1
    here = np.where(at >= 0, depth[at], row["depth"]) if len(depth) else np.full(len(colons), row["depth"])
    out = []
    for colon in colons[here == 1].tolist():
        value = text[colon + 1 : colon + 1 + ranges.TAIL_BYTES].lstrip(_SPACE) or text[colon + 1 :].lstrip(_SPACE)
        kind = "other"
        if value[:1] == b"[":
            item = value[1:].lstrip(_SPACE) or text[text.index(b"[", colon) + 1 :].lstrip(_SPACE)
            kind = "objects" if item[:1] == b"{" else "list"
        out.append((colon, kind, _name(text, quotes, colon, row["ahead"])))
    return out


def cut(row: dict) -> list[tuple]:
    """Rows of ``CUTS`` from one chunk: its whole records, parts of records that cross its borders, members of
    the document's object by the kind of their value, and ``bad`` where the text is no such document."""
    text, level = row["text"], row["level"]
    quotes, places, steps, odd = _brackets(text)
    real = odd == row["inside"]
    places, steps = places[real], steps[real]
    depth = row["depth"] + np.cumsum(steps)
    head = (row["file"], row["block"], row["part"], row["run"])
    out: list[tuple] = []

    ats: list[int] = []
    texts: list[bytes] = []

    def add(kind: str, at: int, run: int, part: bytes | None, value: str | None = None) -> None:
        whole = (ats, texts) if kind == "records" else (None, None)
        out.append((head[0], kind, head[1], head[2], at, run, part, *whole, value))

    values = np.frombuffer(text, np.uint8)[places]
    starts = np.flatnonzero((values == ord("{")) & (depth - steps == level))
    ends = np.flatnonzero((steps < 0) & (depth == level))
    open_before = row["depth"] > level
    if open_before and not len(ends):
        add("middle", 0, row["run"], text)
    elif open_before:
        add("last", 0, row["run"], text[: places[ends[0]] + 1])
    # an end belongs to the latest start; ends of lists among the records belong to none
    after = np.searchsorted(ends, starts)
    closed = after < len(ends)
    last_end = -1
    for start, place in zip(starts[closed].tolist(), ends[after[closed]].tolist()):
        here, to = int(places[start]), int(places[place])
        ats.append(here)
        texts.append(text[here : to + 1])
        if last_end >= 0 and start == last_end + 1:
            between = text[places[last_end] + 1 : here]
            if between.strip(_SPACE) != b"," and not _BETWEEN.fullmatch(between) and not (level == 2 and _NAMED.fullmatch(between)):
                add("bad", here, 0, None)
        last_end = place
    if ats:
        add("records", 0, 0, None)
    for start in starts[~closed].tolist():
        add("first", int(places[start]), row["run"] + 1, text[places[start] :])
    # nothing but space stands around the document, and it is one
    zero = np.flatnonzero(depth <= 0)
    edges = [(0, int(places[0]) if len(places) else len(text))] if row["depth"] <= 0 else []
    edges += [(int(places[at]) + 1, int(places[at + 1]) if at + 1 < len(places) else len(text)) for at in zero[:3].tolist()]
    tops = np.count_nonzero((depth == 1) & (steps > 0))
    if any(text[a:b].strip(_SPACE) for a, b in edges) or tops > (row["block"] == 0 and row["part"] == 0):
        add("bad", 0, 0, None)
    if level == 2:
        for at, kind, name in _members(text, quotes, row, places, depth):
            add(kind, at, 0, None, name)
    return out


def _place() -> F.Column:
    return F.struct("block", "part", "at")


def records(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """``file, place, text``: one row for each object of each document's list of objects; ``place`` orders those
    of a file.

    With ``member``, that member's list (no rows where there is none); else the whole document if it is a
    list, or the first member that is a list starting with an object. Of members with one name the
    last one's value counts, at the first one's place. Other items of a list are left out. A document
    that is blank, cut short, or neither is an error, which is raised as the rows are read; a file without
    a byte is skipped, as by all of Spark's readers. A record's own text is not checked and may be malformed.
    """
    chunked = ranges.chunks(spark, path, "}", SUMMARY, summary)
    known = stage(states(chunked), "chunk-states")
    cuts = ranges.apply(chunked, known.drop("size", "length", "gain", "quotes", "top"), CUTS, cut)
    release(chunked)

    found = ranges.put_together(cuts, closed=True)

    # of each file: its end, its list, and what is wrong with it; one row, as in Spark's own file listing
    named = cuts.where("kind IN ('objects', 'list', 'other')").select("file", "value", "kind", _place().alias("place"))
    following = F.lead("place").over(Window.partitionBy("file").orderBy("place"))
    latest = named.withColumn("to", following).groupBy("file", "value").agg(
        F.min("place").alias("seen"), F.max_by(F.struct("kind", "place", "to"), "place").alias("last")
    )
    wanted = F.col("value") == member if member is not None else F.col("last.kind") == "objects"
    chosen = latest.where(wanted).groupBy("file").agg(F.min_by("last", "seen").alias("list"))
    ended = known.groupBy("file").agg(
        F.max("top").alias("top"), F.max("size").alias("size"), F.sum("gain").alias("depth"),
        (F.sum("quotes") % 2).alias("quotes"), F.sum("length").alias("length"),
    )
    bad = cuts.where("kind = 'bad'").select("file").distinct().withColumn("bad", F.lit(True))
    # the last brace may be one that the file does not have; a leading byte order mark is not read
    extra = F.col("length") - F.col("size")
    closing = F.when(extra.isin(1, -2), -1).when(extra.isin(0, -3), 0)  # else packed: its size says nothing
    documents = ended.join(chosen, "file", "left").join(bad, "file", "left")
    whole = F.col("depth").isin(0, -1) & (F.coalesce(closing, F.col("depth")) == F.col("depth")) & (F.col("quotes") == 0)
    listed = (F.col("top") == "[") if member is None else F.lit(False)
    right = whole & F.col("bad").isNull() & (listed | ((F.col("top") == "{") & (F.lit(member is not None) | F.col("list").isNotNull())))
    documents = stage(documents.select("file", listed.alias("all"), "list", F.coalesce(right, F.lit(False)).alias("right")), "documents")

    mine = found.join(F.broadcast(documents.where("all OR list IS NOT NULL")), "file").where(
        "all OR (list.kind = 'objects' AND place > list.place AND (list.to IS NULL OR place < list.to))"
    )
    nowhere = F.lit(None).cast("struct<block:bigint,part:int,at:int>").alias("place")
    wrong = documents.where("NOT right").select("file", nowhere, F.expr(f"raise_error('{PROBLEM}')").cast("string").alias("text"))
    return mine.select("file", "place", F.expr("make_valid_utf8(cast(text AS string))").alias("text")).unionByName(wrong)
