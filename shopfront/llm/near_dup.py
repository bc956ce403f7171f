"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A sketch has a fixed number of coordinates. In round after round every shingle falls into one
hashed bin with a value that grows with the round; a bin keeps its smallest value. After as many
rounds as there are bins, a round's shingles all go to one bin, so every coordinate fills, whatever
the set's size, and the share of equal coordinates concentrates around the Jaccard similarity.

Equal sets are one class from the start. Classes that share a band are candidates, and links are
confirmed on the full shingle sets. Members of a bucket are first compared with one of them, with
another one in the next turn; those that are in one component by then need no comparison among
each other. What is left between components is compared sketch by sketch in blocks, and every pair
that may reach the threshold is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, documents, held, let_go, position, small
from shopfront.llm.decontaminate import MOST_BITS, filter_bits, passing
from shopfront.llm.graph import components
from shopfront.staging import lay_out, release, stage

#: 64 bands of 8 rows: two sets of similarity 0.8 share no band in 1 of 130,000 cases, of 0.85 in
#: 1 of 10^8; two of similarity 0.3 are candidates in 1 of 240 cases.
BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
#: Candidates whose sketches agree in less are not verified: 0.08 below the threshold is 4.5
#: standard deviations of the estimate.
SLACK = 0.08
STAR_TURNS = 4
BLOCK = 1500  # members of a bucket that one task compares with as many others
KEPT_WORDS = 300_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8").lower().split()


def shingles(text: str, width: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[at:] for at in range(width))))


def similar(a: set, b: set, percent: int) -> bool:
    common = len(a & b)
    return bool(a) and 100 * common >= percent * (len(a) + len(b) - common)


class Hashes:
    """Sorted distinct 64-bit hashes of a text's shingles; words' hashes are kept between texts."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def text(self, text: str) -> np.ndarray:
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > KEPT_WORDS:
                known = self.known = {}
                new = set(words)
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        wide = min(self.width, len(words))
        found = np.full(len(words) - wide + 1, wide, np.uint64)
        for at in range(wide):
            found = _mix(found * _STEP + each[at : at + len(found)])
        return np.unique(found)


def hashes(width: int) -> Hashes:
    return held(("shingle hashes", width), lambda: Hashes(width))


def sketch(found: np.ndarray) -> np.ndarray:
    """16 bits of each coordinate of a set of hashes."""
    filled = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    start = 0
    while start < 2 * BINS:
        rounds = min(2 * BINS - start, max(1, 4000 // len(found)))
        if start < BINS:
            rounds = min(rounds, BINS - start)
        numbers = np.arange(start, start + rounds, dtype=np.uint64)[:, None]
        drawn = _mix(found[None, :] + numbers * _STEP)
        values = (numbers << np.uint64(50)) | (drawn >> np.uint64(14))
        bins = drawn & np.uint64(BINS - 1) if start < BINS else (numbers - np.uint64(BINS)) + 0 * drawn
        np.minimum.at(filled, bins.ravel().astype(np.int64), values.ravel())
        start += rounds
        if filled.max() != np.iinfo(np.uint64).max:
            break
    return (_mix(filled) >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_id, sketch``; set and sketch are null where there is no word."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = {"doc_id": rows["doc_id"], "n_shingles": [], "set_id": [], "sketch": []}
        for text in rows["text"]:
            found = hashes(width).text(text)
            out["n_shingles"].append(len(found))
            out["set_id"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            out["sketch"].append(sketch(found).tobytes() if len(found) else None)
        return out

    return by_batch(docs, "doc_id bigint, n_shingles bigint, set_id binary, sketch binary", work)


def buckets(classes: DataFrame) -> DataFrame:
    """``key, node, size, n_shingles`` for the bands that more than one class has."""
    width = 2 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda at: F.xxhash64(at, F.substr("sketch", at * width + 1, F.lit(width))),
    )
    keyed = classes.select("node", "n_shingles", F.explode(bands).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return keyed.join(shared, "key").select("key", "node", "size", "n_shingles")


def estimated(pairs: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (``a, b``) whose sketches agree in a share of at least ``least``."""
    marks = active.select("node", "sketch")
    left, right = (marks.select(F.col("node").alias(s), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")

    def work(rows: dict[str, list]) -> dict[str, list]:
        let_go()
        a, b = (np.frombuffer(b"".join(rows[f"sketch_{s}"]), "<u2").reshape(-1, BINS) for s in "ab")
        keep = np.flatnonzero((a == b).mean(axis=1) >= least).tolist()
        return {s: [rows[s][i] for i in keep] for s in "ab"}

    return by_batch(pairs.join(left, "a").join(right, "b"), "a bigint, b bigint", work)


def verified(pairs: DataFrame, active: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    texts = active.select("node", "text")
    left, right = (texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")

    def work(rows: dict[str, list]) -> dict[str, list]:
        let_go()
        out, last = {"a": [], "b": []}, (None, set())
        for a, b, text_a, text_b in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"]):
            if last[0] != a:
                last = (a, shingles(text_a, width))
            if similar(last[1], shingles(text_b, width), percent):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return by_batch(pairs.join(left, "a").join(right, "b"), "a bigint, b bigint", work)


def across(open_buckets: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each bucket, by the hashes of the full shingle sets.

    A bucket of any size is cut into blocks, and the rows of two blocks meet in one task: members are
    copied once a block, and put out is what joins components, not every link.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    marks = active.select("node", "n_shingles", "sketch", "hashes")
    placed = open_buckets.select("key", "node", "component", "size").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    ).select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "block", "node", "component",
    ).join(marks, "node")
    group = ("key", "low", "high")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[dict] = []  # the rows of the group at hand: at most those of two blocks
        for batch in batches:
            out = {"a": [], "b": []}
            for row in batch.to_pylist():
                if held and any(row[c] != held[0][c] for c in group):
                    _compare(held, percent, out)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pydict(out, schema=_PAIRS)
        out = {"a": [], "b": []}
        _compare(held, percent, out)
        yield pa.RecordBatch.from_pydict(out, schema=_PAIRS)

    sorted_rows = placed.repartition(*group).sortWithinPartitions(*group)
    return sorted_rows.mapInArrow(walk, "a bigint, b bigint").distinct()


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(rows: list[dict], percent: int, out: dict[str, list]) -> None:
    """Adds pairs to ``out`` until all that is linked is connected. Short hashes may collide. Inside a
    set, the missing ones are counted and granted, so no link is lost. Across two sets a common one
    may be chance: a pair that is similar without two of them is sure and joins its components here,
    any other is only put out for verification.
    """
    component = np.array([row["component"] for row in rows])
    if not len(rows) or (component == component[0]).all():
        return
    marks = np.frombuffer(b"".join(row["sketch"] for row in rows), "<u2").reshape(-1, BINS)
    node, size, block = (np.array([row[c] for row in rows]) for c in ("node", "n_shingles", "block"))
    one_block = rows[0]["low"] == rows[0]["high"]
    second = np.flatnonzero(block == rows[0]["high"])
    sets: dict[int, frozenset] = {}

    def hashed(at: int) -> frozenset:
        if at not in sets:
            sets[at] = frozenset(np.frombuffer(rows[at]["hashes"], "<u4").tolist())
        return sets[at]

    for i in np.flatnonzero(block == rows[0]["low"]).tolist():
        others = second[second > i] if one_block else second
        others = others[component[others] != component[i]]
        others = others[100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])]
        if len(others):
            others = others[(marks[others] == marks[i]).mean(axis=1) >= percent / 100 - SLACK]
        for j in others.tolist():
            if component[i] == component[j]:
                continue
            common, both = len(hashed(i) & hashed(j)), size[i] + size[j]
            most = common + both - len(hashed(i)) - len(hashed(j))
            if 100 * most >= percent * (both - most):
                out["a"].append(int(min(node[i], node[j])))
                out["b"].append(int(max(node[i], node[j])))
                if 100 * (common - 2) >= percent * (both - common + 2):
                    component[component == component[j]] = component[i]


def link(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``).

    Documents whose sets of ``width``-word shingles have ``percent`` hundredths of their union in
    common are linked; ``component_id`` is the smallest ``doc_id`` reachable. A text with fewer
    words is one shingle. A null, empty or blank text has no shingle and is linked with nothing; so
    is a row without ``doc_id`` (its ``component_id`` is null and it counts as kept). Repeated rows
    come out repeated, of one class; rows of one ``doc_id`` with different texts are linked only if
    their texts are. Other columns are not read; an empty table gives no rows.
    """
    least = percent / 100 - SLACK
    docs = documents(docs)
    wide = stage(sketches(docs, width), "near-sketches")
    grouped = wide.where("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"),
        F.any_value("sketch").alias("sketch"),
    )
    classes = stage(grouped.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    rows = stage(wide.drop("sketch"), "near-rows")
    release(wide)
    shared = stage(buckets(classes), "near-buckets")

    nodes = classes.join(shared.select("node").distinct(), "node")
    # sketches and texts are looked up by node turn after turn, and lie by node for that
    active = lay_out(_with_text(nodes, docs, width), "near_active", "node")
    named = stage(classes.select("set_id", "node", "first_id"), "near-named")
    release(classes)

    component = active.select("node", F.col("node").alias("component"))
    for turn in range(STAR_TURNS + 1):
        inside = _open_buckets(shared.join(component, "node"), turn)
        if turn < STAR_TURNS:
            pairs = stage(estimated(_stars(inside), active, least), "near-pairs")
        else:
            pairs = across(inside, active, percent)
        links = stage(verified(pairs, active, width, percent), "near-links")
        if links.isEmpty():
            continue
        left, right = (component.select(F.col("node").alias(s), F.col("component").alias(f"_{s}")) for s in "ab")
        drawn = links.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        merged = components(drawn).select(F.col("node").alias("component"), F.col("component").alias("_to"))
        component = stage(
            component.join(merged, "component", "left").select(
                "node", F.coalesce("_to", "component").alias("component")
            ), "near-components",
        )
    return _labelled(rows, named, component)


def _open_buckets(within: DataFrame, turn: int) -> DataFrame:
    """Members of buckets that hold several components, beside a member picked as the center."""
    picked = F.xxhash64("node", F.lit(turn))
    spread = within.groupBy("key").agg(
        F.min_by(F.struct("node", "component"), picked).alias("center"),
        (F.min("component") != F.max("component")).alias("open"),
    ).where("open").drop("open")
    return within.join(spread, "key")


def _stars(inside: DataFrame) -> DataFrame:
    """Each node with the two centers that it meets in most buckets."""
    met = inside.where("component <> center.component").groupBy("node", F.col("center.node").alias("center")).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("node").orderBy(F.desc("n"), "center")  # at most a row a band
    best = met.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return best.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()


def _with_text(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """For each class a text whose shingle set is the class's, and the set's short hashes.

    A filter of at most ``MOST_BITS`` tells which documents may be the first of such a class, so the texts of the others are
    not shuffled. Beyond that size it lets more of them through, and they find no class.
    """
    firsts = stage(nodes.select(F.xxhash64("first_id").alias("key")), "near-firsts")
    n = firsts.count()
    marks = filter_bits(firsts, min(1 << max(16, (16 * n).bit_length()), MOST_BITS))

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"set_id": [], "text": [], "hashes": []}
        keys = np.array(rows["key"], np.int64).astype(np.uint64)
        for at in passing(keys, np.frombuffer(marks, np.uint64)).tolist():
            found = hashes(width).text(rows["text"][at])
            out["set_id"].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
            out["text"].append(rows["text"][at])
            out["hashes"].append((found >> np.uint64(32)).astype("<u4").tobytes())
        return out

    keyed = docs.where("doc_id IS NOT NULL").select(F.xxhash64("doc_id").alias("key"), "text")
    found = by_batch(keyed, "set_id binary, text string, hashes binary", work).groupBy("set_id").agg(
        F.min("text").alias("text"), F.any_value("hashes").alias("hashes")
    )
    return nodes.join(found, "set_id").select("node", "n_shingles", "sketch", "text", "hashes")


def _labelled(rows: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    named = classes.select("set_id", "node", "first_id").join(component, "node", "left").select(
        "set_id", "first_id", F.coalesce("component", "node").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = named.join(smallest, "component").select("set_id", "component_id")
    has_set = F.col("doc_id").isNotNull() & F.col("set_id").isNotNull()
    sets = rows.select("doc_id", "n_shingles", "set_id")
    with_set = sets.where(has_set).join(linked, "set_id").drop("set_id")
    without = sets.where(~has_set).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_set.unionByName(without).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, without near duplicates: of each group the
    document with the smallest ``doc_id`` stays.

    Rows that repeat both id and text count as one. A ``doc_id`` with several texts goes only when all
    of them do. Rows without ``doc_id``, and texts without a word, stay.
    """
    names = docs.columns
    at, text_at = position(docs, "doc_id"), position(docs, "text")
    flat = docs.toDF(*(f"_{i}" for i in range(len(names)))).withColumn("_id", F.col(f"_{at}").cast("bigint"))
    labelled = stage(link(docs, width, percent), "near-labels").where("doc_id IS NOT NULL")
    judged = labelled.groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")
    ).where("NOT kept OR rows > 1")
    judged = small(stage(judged.select("_id", F.col("kept").alias("_kept")), "near-judged"))
    marked = flat.join(judged, "_id", "left")  # judged: documents that go, and the rare repeated ids
    once = marked.where("_kept").dropDuplicates(["_id", f"_{text_at}"])
    columns = [f"_{i}" for i in range(len(names))]
    return marked.where("_kept IS NULL").select(*columns).unionByName(once.select(*columns)).toDF(*names)
