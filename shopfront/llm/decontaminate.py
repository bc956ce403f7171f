"""Benchmark items in documents, found by templates, so that changed numbers and names do not hide them.

Canonical form: numbers, units after numbers and names become typed placeholders; other words are
case-folded without the punctuation around them. Names are told by a capital, so two views are kept:
``folded`` treats names as words (a text in other case still matches), ``named`` replaces them (a
text with other names still matches). Windows of templates meet by hash join. A filter of bounded
size keeps out of the shuffle the windows that no item has. Along one alignment of document and
item, slots must agree: the same item value always stands for the same document value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, documents, held, pick, position, small
from shopfront.staging import stage

WINDOW = 8  # words a window
LITERAL = 4  # of these at least so many are words, not placeholders
SHARE = 0.4  # an item is found when so much of its windows are, or
WINDOWS = 6  # this many: a run of 13 words
#: Places that a document may gain or lose against the item, by words put in or left out, within what counts as
#: one alignment.
DRIFT = 4
KEPT_CHUNKS = 300_000
#: Bits of the filter for each window of the benchmark, and its largest size, 8 MB. Beyond it the
#: filter lets more windows through to the join, and the result stays the same.
BITS_A_WINDOW, MOST_BITS = 128, 1 << 26
#: A key marks three places of the filter, read from its bits at these shifts: one in 70,000 keys
#: that no item has finds all three marked.
SHIFTS = (0, 21, 38)

#: Units of measure and currencies; fixed values.
UNITS = frozenset(
    "% ° °c °f € $ £ a ah amp amps bar bit bits byte bytes c cal cent cents cm day days deg degrees"
    " dollar dollars eur euro euros f feet foot ft g gal gallon gallons gb gram grams h ha hour hours"
    " hz in inch inches j k kb kcal kg khz kilogram kilograms kilometer kilometers km kmh kph kw kwh"
    " l lb lbs liter liters litre litres m mb meter meters metre metres mg mhz mi mile miles min"
    " minute minutes ml mm month months mph ms n oz ounce ounces pa percent pound pounds s sec second"
    " seconds t tb tesla ton tons usd v volt volts w watt watts week weeks yard yards yd year years".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*")
_DIGIT = re.compile(r"\d")
_NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d+(?:[.,:/]\d+)*)([^\W\d]+|%|°[cf]?)")
_CORE = re.compile(r"[\w$€£+%°-](?:.*[\w%°])?", re.S)
NUM, UNIT, NAME = "\x01num", "\x01unit", "\x01name"


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8"))


_NUM, _UNIT, _NAME = _hash(NUM), _hash(UNIT), _hash(NAME)
#: What a token is: a word, a number, a word that is a unit if a number stands before it.
PLAIN, NUMBER, UNIT_WORD = 0, 1, 2


def tokens(chunk: str) -> list[tuple[str, int, int, int]]:
    """``(text, hash in the folded view, hash in the named view, kind)`` of a chunk's tokens."""
    word = chunk
    if not chunk.isalpha():
        found = _CORE.search(chunk)
        if not found:
            return []
        word = found[0]
        if _DIGIT.search(word):
            if _NUMBER.fullmatch(word):
                return [(word, _NUM, _NUM, NUMBER)]
            both = _NUMBER_UNIT.fullmatch(word.casefold())
            if both and both[2] in UNITS:
                return [(both[1], _NUM, _NUM, NUMBER), (both[2], _UNIT, _UNIT, PLAIN)]
    folded = word.casefold()
    own = _hash(folded)
    is_name = word[0].isupper()
    return [(folded, own, _NAME if is_name else own, UNIT_WORD if folded in UNITS else PLAIN)]


class Canonical:
    """Hash sequences of texts. Chunks between white space that were met before are known by number."""

    def __init__(self):
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.count = np.empty(1 << 12, np.int8)  # tokens of a chunk: none, one, or a number and unit
        self.hashes = np.empty((1 << 12, 2, 2), np.uint64)  # chunk, token, view
        self.kinds = np.empty((1 << 12, 2), np.int8)

    def learn(self, chunks: list[str]) -> None:
        first, size = len(self.number), len(self.count)
        if first + len(chunks) > size:
            size = max(first + len(chunks), 2 * size)
            for name in ("count", "hashes", "kinds"):
                old = getattr(self, name)
                new = np.empty((size, *old.shape[1:]), old.dtype)
                new[:first] = old[:first]
                setattr(self, name, new)
        if not chunks:
            return
        found = [tokens(chunk) for chunk in chunks]
        here = slice(first, first + len(chunks))
        self.number.update(zip(chunks, range(first, first + len(chunks))))
        self.count[here] = [len(f) for f in found]
        for i in (0, 1):
            ith = [f[i] if len(f) > i else ("", 0, 0, PLAIN) for f in found]
            self.hashes[here, i, 0] = np.array([t[1] for t in ith], np.uint64)
            self.hashes[here, i, 1] = np.array([t[2] for t in ith], np.uint64)
            self.kinds[here, i] = [t[3] for t in ith]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[2 views, tokens] of hashes of all the texts, and where each text starts and the last ends."""
        cut = [text.split() for text in texts]
        new = set().union(*cut).difference(self.number)
        if len(new) + len(self.number) > KEPT_CHUNKS:
            self.start()
            new = set().union(*cut)
        self.learn(list(new))
        number = self.number.__getitem__
        at = np.concatenate([np.fromiter(map(number, chunks), np.int64, len(chunks)) for chunks in cut])
        count = self.count[at].astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(count)))
        starts = ends[np.cumsum([0, *map(len, cut)])]
        chunk = np.repeat(at, count)
        which = np.arange(len(chunk)) - np.repeat(ends[:-1], count)
        views, kinds = np.ascontiguousarray(self.hashes[chunk, which].T), self.kinds[chunk, which]
        if kinds.any():
            after = (kinds[1:] == UNIT_WORD) & (kinds[:-1] == NUMBER)
            after[starts[(starts > 0) & (starts < len(kinds))] - 1] = False
            views[:, np.flatnonzero(after) + 1] = _UNIT
        return views, starts


def runs(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of at most so many characters, or of one, and each run's first place."""
    first, size = 0, 0
    for at, text in enumerate(texts):
        if at > first and size + len(text) > most:
            yield first, texts[first:at]
            first, size = at, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def words(text: str) -> list[str]:
    """The tokens' texts, in step with the hashes."""
    return [token[0] for chunk in text.split() for token in tokens(chunk)]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def placeholders(hashes: np.ndarray) -> np.ndarray:
    return (hashes == _NUM) | (hashes == _UNIT) | (hashes == _NAME)


def windows(hashes: np.ndarray, starts: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of a view that hold enough words which are no placeholders, their
    places, and the texts they lie in."""
    size = len(hashes) - wide + 1
    if size <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    made = np.full(size, wide, np.uint64)
    for at in range(wide):
        made ^= hashes[at : at + size]
        made *= _STEP
        made ^= made >> np.uint64(31)
    literal = np.concatenate(([0], np.cumsum(~placeholders(hashes))))
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    fit = np.flatnonzero((literal[wide:] - literal[:-wide] >= LITERAL) & (text[:size] == text[wide - 1 :]))
    return made[fit], fit, text[fit]


def canonical() -> Canonical:
    return held("canonical", Canonical)


SCHEMA = "{id} bigint, view int, wide int, key bigint, at int, slots array<string>"


def _rows(name: str, ids: list[int], texts: list[str], view: int, wide: int, hashes: np.ndarray,
          starts: np.ndarray, keys: np.ndarray, places: np.ndarray, owners: np.ndarray) -> dict[str, list]:
    """Rows for windows, with the values at their placeholders in order."""
    marks = placeholders(hashes)
    values = {owner: words(texts[owner]) for owner in np.unique(owners).tolist()}
    slots = [
        [values[owner][int(i) - starts[owner]] for i in np.flatnonzero(marks[at : at + wide]) + at]
        for at, owner in zip(places.tolist(), owners.tolist())
    ]
    return {
        name: [ids[owner] for owner in owners.tolist()], "view": [view] * len(places),
        "wide": [wide] * len(places), "key": keys.astype(np.int64).tolist(),
        "at": (places - starts[owners]).tolist(), "slots": slots,
    }


def _gather(found: list[dict[str, list]], name: str) -> dict[str, list]:
    return {k: [v for part in found for v in part[k]] for k in (name, "view", "wide", "key", "at", "slots")}


def item_windows(items: DataFrame) -> DataFrame:
    """All windows of every item; one window if the item is shorter. An item with fewer than
    ``LITERAL`` words that are no placeholders says too little to be looked for."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        found = []
        for item, text in zip(rows["item_id"], rows["text"]):
            views, starts = canonical()([text])
            wide = min(WINDOW, views.shape[1])
            for view in (0, 1) if wide else ():
                made = windows(views[view], starts, wide)
                found.append(_rows("item_id", [item], [text], view, wide, views[view], starts, *made))
        return _gather(found, "item_id")

    return by_batch(items, SCHEMA.format(id="item_id"), work)


def filter_bits(keys: DataFrame, bits: int) -> bytes:
    """The filter with every key's places marked: aggregated by Spark, ``bits / 8`` bytes whatever
    the number of keys."""
    each = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS)))
    rows = keys.select(each.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("marks")
    ).collect()
    made = np.zeros(bits // 64, np.int64)
    for row in rows:
        made[row["word"]] = row["marks"]
    return made.tobytes()


def passing(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which keys find all their places marked."""
    at = np.arange(len(keys))
    for shift in SHIFTS:
        place = (keys[at] >> np.uint64(shift)) & np.uint64(len(marks) * 64 - 1)
        shown = marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))
        at = at[(shown & np.uint64(1)).astype(bool)]
    return at


def document_windows(docs: DataFrame, bits: bytes, widths: list[int]) -> DataFrame:
    """The windows of documents that the filter lets through; ``widths`` are those of the items."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        marks, found = np.frombuffer(bits, np.uint64), []
        for first, texts in runs(rows["text"]):
            ids = rows["doc_id"][first : first + len(texts)]
            views, starts = canonical()(texts)
            for view in (0, 1):
                for wide in widths:
                    keys, places, owners = windows(views[view], starts, wide)
                    hit = passing(keys, marks)
                    if len(hit):
                        found.append(_rows("doc_id", ids, texts, view, wide, views[view], starts,
                                           keys[hit], places[hit], owners[hit]))
        return _gather(found, "doc_id")

    return by_batch(docs, SCHEMA.format(id="doc_id"), work)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_windows, n_item_windows, n_changed`` for every benchmark item found in a
    document.

    ``n_windows`` counts the item's windows on the best alignment, which may drift by ``DRIFT`` places: at least
    ``WINDOWS``, or a share of ``SHARE`` of ``n_item_windows``. ``n_changed`` counts item values that the document replaces, 0
    for a verbatim copy. An alignment whose slots disagree counts only its windows with equal slots.

    Null and empty texts have no windows; rows without ``doc_id`` or ``item_id`` are not reported.
    Items of equal text are looked for once and all reported. Repeated rows change nothing. An empty table on either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    items = pick(benchmark, item_id="bigint", text="string").where("item_id IS NOT NULL AND text IS NOT NULL")
    named = items.distinct()
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id"))
    wanted = stage(item_windows(items), "benchmark-windows")
    sizes = wanted.agg(F.count(F.lit(1)).alias("n"), F.collect_set("wide").alias("wide")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, n_windows bigint, n_item_windows bigint, n_changed bigint")
    bits = 1 << max(16, (BITS_A_WINDOW * sizes["n"] - 1).bit_length())
    marks = filter_bits(wanted, min(bits, MOST_BITS))
    found = document_windows(documents(docs).where("doc_id IS NOT NULL"), marks, sorted(sizes["wide"]))

    totals = wanted.groupBy("item_id", "view").agg(F.count(F.lit(1)).alias("n_item_windows"))
    item_side = wanted.join(totals, ["item_id", "view"]).withColumnsRenamed({"at": "item_at", "slots": "item_slots"})
    met = found.join(item_side, ["view", "wide", "key"])
    pairs = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc"))
    # two rows of stretches, shifted against each other: any two shifts that are near share a stretch
    stretches = F.array(*(
        F.struct(F.lit(half).alias("half"), F.floor((F.col("at") - F.col("item_at") + half * DRIFT) / (2 * DRIFT)).alias("nth")) for half in (0, 1)
    ))
    met = met.withColumn("stretch", F.explode(stretches))
    aligned = met.groupBy("doc_id", "item_id", "view", "n_item_windows", "stretch").agg(
        F.size(F.collect_set("item_at")).alias("n_all"),
        F.size(F.collect_set(F.when(F.col("slots") == F.col("item_slots"), F.col("item_at")))).alias("n_equal"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("values"),
    )
    consistent = F.size("values") == F.size(F.array_distinct(F.col("values.item")))
    changed = F.size(F.filter("values", lambda v: v["item"] != v["doc"]))
    judged = aligned.select(
        "doc_id", "item_id", "n_item_windows",
        F.when(consistent, F.col("n_all")).otherwise(F.col("n_equal")).cast("bigint").alias("n_windows"),
        F.when(consistent, changed).otherwise(0).cast("bigint").alias("n_changed"),
    ).where((F.col("n_windows") >= WINDOWS) | (F.col("n_windows") >= F.ceil(SHARE * F.col("n_item_windows"))))
    best = F.min(F.struct(-F.col("n_windows"), "n_changed", "n_item_windows"))
    one = judged.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", F.col("item_id").alias("_item"), (-F.col("best.col1")).alias("n_windows"), "best.n_item_windows", "best.n_changed"
    )
    alike = named.join(items.withColumnRenamed("item_id", "_item"), "text").select("_item", "item_id")
    return one.join(alike, "_item").select("doc_id", "item_id", "n_windows", "n_item_windows", "n_changed")


def without_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, in which no item is found."""
    names = docs.columns
    at = position(docs, "doc_id")
    found = small(stage(matches(docs, benchmark).select(F.col("doc_id").alias("_found_id")).distinct(), "benchmark-found"))
    flat = docs.toDF(*(f"_{i}" for i in range(len(names))))
    return flat.join(found, F.col(f"_{at}").cast("bigint") == F.col("_found_id"), "left_anti").toDF(*names)
