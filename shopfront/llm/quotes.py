"""Conversations in reply order, linked by what their messages quote.

Lines that begin with ``>`` signs quote; their number is the level. Adjacent lines of one level are a
passage. Passages and their lines, normalised, are hashed and joined to the messages that wrote them
themselves: of several, the latest before the quoting message. A message replies to the author of its
first passage of the lowest level that has a link; replies form threads, and every message comes
out without its quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.llm.common import pick
from shopfront.staging import stage

TURNS_A_BLOCK = 1024  # turns that one window sorts of a conversation, whatever its length

_PREFIX = r"^\\s*((?:>\\s?)+)"
_LINES = "split(text, '\\\\r\\\\n|\\\\r|\\\\n')"
_NORMAL = "trim(lower(regexp_replace({}, '[\\\\s\\\\x{{00a0}}]+', ' ')))"


def with_lines(messages: DataFrame) -> DataFrame:
    """``lines``: ``level`` and ``body`` of every line of a message, in order."""
    quoted = f"regexp_extract(line, '{_PREFIX}', 1)"
    body = f"regexp_replace(line, '{_PREFIX}', '')"
    return messages.withColumn("lines", F.expr(
        f"transform({_LINES}, line -> struct(length(regexp_replace({quoted}, '[^>]', '')) AS level, {body} AS body))"
    ))


def with_passages(messages: DataFrame) -> DataFrame:
    """``passages``: runs of lines of one level with their normalised text, own writing at level 0;
    ``reply``: the text without quotes."""
    runs = (
        "aggregate(lines, cast(array() AS array<struct<level: int, rows: array<string>>>), (done, line) ->"
        " if(size(done) > 0 AND element_at(done, -1).level = line.level,"
        "  concat(slice(done, 1, size(done) - 1), array(struct(line.level AS level,"
        "   concat(element_at(done, -1).rows, array(line.body)) AS rows))),"
        "  concat(done, array(struct(line.level AS level, array(line.body) AS rows)))))"
    )
    return messages.withColumn("passages", F.expr(runs)).withColumn("reply", F.expr(
        "trim(BOTH '\\n' FROM array_join(transform(filter(lines, l -> l.level = 0), l -> l.body), '\\n'))"
    ))


def units(messages: DataFrame) -> DataFrame:
    """``message, conv_id, turn, level, place, hash``: every passage and every line of it. Blank ones
    say nothing and are left out."""
    passages = messages.select("message", "conv_id", "turn", F.posexplode("passages").alias("place", "passage"))
    texts = F.array_union(F.array(F.array_join("passage.rows", " ")), F.col("passage.rows"))
    each = passages.select("message", "conv_id", "turn", "passage.level", "place", F.explode(texts).alias("body"))
    normal = each.withColumn("normal", F.expr(_NORMAL.format("body"))).where("normal <> ''")
    return normal.select("message", "conv_id", "turn", "level", "place", F.md5("normal").alias("hash")).distinct()


def latest_before(quotes: DataFrame, written: DataFrame) -> DataFrame:
    """``quotes`` with ``source``: the message with the largest turn before theirs that wrote the hash.

    Turns are cut into blocks. Inside a block, rows of a conversation and hash are sorted; the latest
    before the block comes from one row a block. So a line that is repeated through a conversation
    of any length never meets in one task.
    """
    block = F.floor(F.col("turn") / TURNS_A_BLOCK).alias("block")
    own = written.groupBy("conv_id", "hash", "turn").agg(F.max("message").alias("writer"))
    own = own.select("conv_id", "hash", "turn", F.struct("turn", "writer").alias("wrote"))
    asked = quotes.select("conv_id", "hash", "turn", "message", "level", "place")
    rows = own.unionByName(asked, allowMissingColumns=True).select("*", block)
    inside = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "hash", "block").agg(F.max("wrote").alias("last"))
    before = blocks.select("conv_id", "hash", "block", F.max("last").over(earlier).alias("before"))
    found = rows.withColumn("here", F.max("wrote").over(inside)).where("message IS NOT NULL")
    return found.join(before, ["conv_id", "hash", "block"]).select(
        "message", "level", "place", F.coalesce("here", "before").alias("source")
    ).where("source IS NOT NULL")


def threads(parents: DataFrame) -> DataFrame:
    """``message, root, depth`` from ``message, parent``: pointers are doubled until all reach a root."""
    current = stage(parents.select(
        "message", F.coalesce("parent", "message").alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("depth")
    ), "quote-threads")
    while True:
        above = current.select(F.col("message").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        current = stage(current.join(above, "root").select(
            "message", F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("_depth") > 0).alias("moved")
        ), "quote-threads")
        if current.where("moved").isEmpty():
            return current.drop("moved")
        current = current.drop("moved")


def link(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, reply, n_passages, n_linked, parent_turn, root_turn, depth, position`` for
    every row of ``conversations`` (``conv_id, turn, role, text``).

    ``position`` orders a conversation, from 0: threads by their first turn, then turns, so every
    message stands after what it replies to. Messages without linked quotes begin threads. A null
    text is an empty message; rows without ``conv_id`` or ``turn`` link to nothing and have no
    position. Rows of one turn are told apart by role and text and do not quote each other;
    repeated rows come out repeated, at one position. Other columns are not read; an empty table
    gives no rows.
    """
    rows = pick(conversations, conv_id="bigint", turn="bigint", role="string", text="string")
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    placed = "conv_id IS NOT NULL AND turn IS NOT NULL"
    name = F.concat_ws(":", "conv_id", "turn", F.md5(F.concat_ws("\x01", F.coalesce("role", F.lit("")), "text")))
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    messages = stage(with_passages(with_lines(alike.withColumn("message", name))).select(
        "message", "conv_id", "turn", "role", "copies", "reply", "passages",
        F.expr("cast(size(filter(passages, p -> p.level > 0)) AS bigint)").alias("n_passages"),
    ), "quote-messages")
    found = units(messages.where(placed))
    sources = stage(latest_before(found.where("level > 0"), found.where("level = 0")), "quote-sources")
    first = sources.groupBy("message").agg(
        F.count_distinct("place").alias("n_linked"),
        F.min_by("source", F.struct("level", "place", -F.col("source.turn"))).alias("source"),
    ).select("message", "n_linked", F.col("source.writer").alias("parent"), F.col("source.turn").alias("parent_turn"))

    linked = messages.where(placed).select("message", "conv_id", "turn").join(first, "message", "left")
    linked = stage(linked, "quote-linked")
    begun = linked.where("parent IS NULL").select(F.col("message").alias("root"), F.col("turn").alias("root_turn"))
    rooted = threads(linked.select("message", "parent")).join(begun, "root")
    ordered = _positions(linked.join(rooted, "message"))
    final = messages.drop("passages", "conv_id", "turn").join(
        ordered.select("message", "conv_id", "turn", "n_linked", "parent_turn", "root_turn", "depth", "position"), "message"
    )
    astray = messages.where(f"NOT ({placed})").select(
        "conv_id", "turn", "role", "reply", "copies", "n_passages", F.lit(0).cast("bigint").alias("n_linked"),
        *(F.lit(None).cast("bigint").alias(c) for c in ("parent_turn", "root_turn", "depth", "position")),
    )
    out = ("conv_id", "turn", "role", "reply", "n_passages", "n_linked", "parent_turn", "root_turn", "depth", "position")
    whole = final.withColumn("n_linked", F.coalesce("n_linked", F.lit(0))).select(*out, "copies").unionByName(astray.select(*out, "copies"))
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*out)


def _positions(rows: DataFrame) -> DataFrame:
    """``position`` by root turn, turn and message: counted in blocks of root turns, so that a
    conversation of any length is sorted in parts."""
    block = rows.withColumn("block", F.floor(F.col("root_turn") / TURNS_A_BLOCK))
    counted = block.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "block").orderBy("root_turn", "root", "turn", "message")
    return block.withColumn("_at", F.row_number().over(inside)).join(bases, ["conv_id", "block"]).withColumn(
        "position", (F.col("base") + F.col("_at") - 1).cast("bigint")
    ).drop("block", "base", "_at")
