"""Shortest-pack-first packing over the histogram of lengths.

Documents longer than a sequence are cut at its multiples. Only the histogram, at most one number
for each length up to the sequence's, reaches the driver. There, lengths are placed longest first,
each into the emptiest kind of pack that has room, and counts of packing patterns are updated. A
pattern's place for a length is a run of ranks, so documents find their sequence by their rank among
the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfront.llm.bpe_count import byte_symbols
from shopfront.llm.common import by_batch, documents, held
from shopfront.llm.pretokens import WORD_LEVEL, is_common
from shopfront.staging import stage

KEPT_CHUNKS = 200_000  # chunks whose ids a Python worker keeps; beyond it, it starts anew
ASKED_AT_ONCE = 20_000  # chunks that are learned together
SYMBOLS = dict(enumerate(byte_symbols()))
ROWS_A_BUCKET = 500_000  # ranks are counted in buckets of about so many pieces


def gathered(values: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` that ``order`` names, one after another, and their ends. Run ``n`` lies
    from ``ends[n]`` to ``ends[n + 1]``."""
    starts, sizes = ends[:-1][order], np.diff(ends)[order]
    new_ends = np.concatenate(([0], np.cumsum(sizes)))
    places = np.repeat(starts - new_ends[:-1], sizes)
    places += np.arange(len(places))
    return values[places], new_ends


class WordIds:
    """Ids of texts as the library gives them, as little-endian unsigned 32-bit numbers.

    Texts of common characters are cut at white space, which no word crosses, and the library is
    asked for a distinct chunk's words once; any other text, and one that may hold a special string,
    goes to it whole. Chunks and their ids are kept as columns, not as objects: some 40 bytes a chunk.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize  # for one word, in the symbols of its bytes
        self.reset()

    def reset(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and their ends."""
        cut = [WORD_LEVEL.findall(chunk) for chunk in chunks.to_numpy(zero_copy_only=False)]
        words = pa.array([word for some in cut for word in some], pa.string()).dictionary_encode()
        ids, ends, merge = array("I"), [0], self.merge
        for word in words.dictionary.to_numpy(zero_copy_only=False):
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(SYMBOLS)
            ids.extend([token.id for token in merge(word)])
            ends.append(len(ids))
        ids, ends = gathered(np.array(ids, "<u4"), np.array(ends), words.indices.to_numpy())
        return ids, ends[np.concatenate(([0], np.cumsum([len(some) for some in cut])))]

    def look_up(self, chunks: pa.Array) -> np.ndarray:
        """Places of distinct chunks among the known ones, which the others join."""
        if len(self.known) > KEPT_CHUNKS:
            self.reset()
        places = pc.index_in(chunks, value_set=self.known)
        missing = places.is_null()
        places = pc.fill_null(places, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if missing.true_count:
            new = chunks.filter(missing)
            places[missing.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(new))
            ids, ends = [self.ids], [self.ends]
            for at in range(0, len(new), ASKED_AT_ONCE):
                more, its_ends = self.learn(new.slice(at, ASKED_AT_ONCE))
                ids.append(more)
                ends.append(its_ends[1:] + ends[-1][-1])
            self.ids, self.ends = np.concatenate(ids), np.concatenate(ends)
            self.known = pa.concat_arrays([self.known, new])
        return places

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        plain = ["<|" not in text and is_common(text) for text in texts]
        column = pa.array([text for text, is_plain in zip(texts, plain) if is_plain], pa.string())
        cut = pc.utf8_split_whitespace(pc.utf8_lower(column))
        chunks = cut.flatten().dictionary_encode()
        places = self.look_up(chunks.dictionary)[chunks.indices.to_numpy()]
        ids, ends = gathered(self.ids, self.ends, places)
        parts = iter(np.split(ids, ends[cut.offsets.to_numpy()[1:-1]]))
        return [next(parts) if is_plain else self.whole(text) for text, is_plain in zip(texts, plain)]

    def text(self, text: str) -> bytes:
        return self.texts([text])[0].tobytes()


def word_ids(path: str) -> WordIds:
    return held(("word ids", path), lambda: WordIds(path))


def pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """Every document's ids and ``end_id``, cut at the multiples of ``size``."""
    end = end_id.to_bytes(4, "little")

    def work(rows: dict[str, list]) -> dict[str, list]:
        out = defaultdict(list)
        for doc_id, found in zip(rows["doc_id"], word_ids(vocabulary).texts(rows["text"])):
            ids = found.tobytes() + end
            total = len(ids) // 4
            for start in range(0, total, size):
                part = ids[4 * start : 4 * (start + size)]
                for name, value in (
                    ("doc_id", doc_id), ("start", start), ("length", len(part) // 4),
                    ("ids_crc32", zlib.crc32(part)), ("doc_tokens", total),
                ):
                    out[name].append(value)
        return out

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return by_batch(documents(docs), schema, work)


def place_lengths(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, first rank, end rank, pieces a sequence, offset, first sequence)``.

    ``open_packs[room]`` holds patterns with that much room: a count of equal packs and the runs
    placed in them so far. The emptiest packs take the next length, as many pieces each as it needs
    to be no longer the emptiest. Every step uses up a length or a pattern, so the runs depend on
    ``size`` and the spread of lengths, not on how many documents there are.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            rooms = sorted((r for r, packs in open_packs.items() if packs and r >= length), reverse=True)
            if not rooms:
                # as few packs as hold all that is left of this length
                open_packs[size].append((-(-left // (size // length)), ()))
                continue
            room = rooms[0]
            packs, placed = open_packs[room].pop()
            floor = rooms[1] if len(rooms) > 1 and not open_packs[room] else (0 if not open_packs[room] else room)
            each = max(1, min(room // length, (room - floor) // length))
            each = max(1, min(each, left // packs))
            if left < packs:
                open_packs[room].append((packs - left, placed))
                packs = left
            open_packs[room - each * length].append((packs, (*placed, (length, each))))
            left -= packs * each

    runs, taken, sequence = [], defaultdict(int), 0
    for room in sorted(open_packs):
        for packs, placed in open_packs[room]:
            offset = 0
            for length, each in placed:
                first = taken[length]
                taken[length] += packs * each
                runs.append((length, first, taken[length], each, offset, sequence))
                offset += length * each
            sequence += packs if placed else 0
    return runs


def ranked(table: DataFrame, total: int) -> DataFrame:
    """``rank`` from 0 among the pieces of equal length, counted in buckets: however many pieces
    share a length, no task sorts more than a bucket of them."""
    buckets = max(8, -(-total // ROWS_A_BUCKET))
    split = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counted = split.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return (
        split.withColumn("_at", F.row_number().over(inside))
        .join(bases, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("_at") - 1)
        .drop("bucket", "base", "_at")
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, size: int = 2048) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone, one piece. Rows that repeat a ``doc_id`` are packed
    each for itself; an empty table gives no row; columns other than ``doc_id`` and ``text`` are
    not read. Pieces with equal keys are alike in every column, so which of them takes which rank
    does not show.
    """
    spark = docs.sparkSession
    cut = stage(pieces(docs, vocabulary, end_id, size), "packing-pieces")
    rows = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most size rows
    histogram = {row["length"]: row["n"] for row in rows}
    runs = spark.createDataFrame(
        place_lengths(histogram, size),
        "run_length bigint, first bigint, end bigint, each bigint, at bigint, first_sequence bigint",
    )
    placed = ranked(cut, sum(histogram.values())).join(
        F.broadcast(runs),  # bounded by the lengths there are, see place_lengths
        (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first"))
        & (F.col("rank") < F.col("end")),
    )
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("bigint").alias("sequence_id"),
        (F.col("at") + (nth % F.col("each")) * F.col("length")).cast("bigint").alias("offset"),
    )
