"""Token counts by byte-pair merging with a heap over a linked list.

A piece of text starts as one symbol a byte. The heap yields the adjacent pair of lowest rank,
leftmost first; each merge removes one symbol, so the count is initial symbols minus merges and no
identifier is ever put out. A piece of n bytes takes O(n log n), whatever its length.
"""

from __future__ import annotations

import heapq
import json
import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm.common import by_batch, documents, held
from shopfront.llm.pretokens import BYTE_LEVEL, is_common

#: The same pattern with full Unicode classes, for texts with rarer characters.
ANY_TEXT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Counts of distinct pieces that a Python worker keeps between texts; beyond it, it starts anew.
KEPT_PIECES = 1_000_000
SPACE_AFTER_SPACE = re.compile(r"[\t\n\r ] ")


def byte_symbols() -> list[str]:
    """The character that a byte-level vocabulary writes for each byte: printable bytes stand for
    themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeCounter:
    """Counts tokens by the merges of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        number = {symbol: at for at, symbol in enumerate(byte_symbols())}
        #: Rank of a pair, by left symbol * 2**32 + right symbol, and the symbol it makes.
        self.ranks: dict[int, int] = {}
        self.makes: list[int] = []
        for rank, pair in enumerate(content["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[number[left] << 32 | number[right]] = rank
            self.makes.append(number.setdefault(left + right, len(number)))
        added = [token["content"] for token in content["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}
        self.chunks: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Heap entries are rank * 2**32 + place of the left symbol; a merged-away symbol is -1.

        ``following`` and ``preceding`` link the symbols that are left. An entry is stale when the
        pair at its place has another rank by now.
        """
        symbols = list(piece.encode("utf-8"))
        size = len(symbols)
        rank_of, makes = self.ranks.get, self.makes
        heap = []
        for at in range(size - 1):
            rank = rank_of(symbols[at] << 32 | symbols[at + 1])
            if rank is not None:
                heap.append(rank << 32 | at)
        if not heap:
            return size
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        following, preceding = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = 0
        while heap:
            entry = pop(heap)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            left, right = symbols[at], following[at]
            if left < 0 or right >= size or rank_of(left << 32 | symbols[right]) != rank:
                continue
            merges += 1
            made = symbols[at] = makes[rank]
            symbols[right] = -1
            beyond = following[at] = following[right]
            if beyond < size:
                preceding[beyond] = at
                rank = rank_of(made << 32 | symbols[beyond])
                if rank is not None:
                    push(heap, rank << 32 | at)
            earlier = preceding[at]
            if earlier >= 0:
                rank = rank_of(symbols[earlier] << 32 | made)
                if rank is not None:
                    push(heap, rank << 32 | earlier)
        return size - merges

    def pieces(self, text: str) -> int:
        found = (BYTE_LEVEL if is_common(text) else ANY_TEXT).findall(text)
        known = self.known
        for piece in set(found).difference(known):
            known[piece] = self.piece(piece)
        return sum(map(known.__getitem__, found))

    def stretch(self, text: str) -> int:
        """A single space starts a new piece, so what stands between two of them is counted once,
        with the space before it, and remembered. White space before a space would join with it."""
        if len(self.known) + len(self.chunks) > KEPT_PIECES:
            self.known, self.chunks = {}, {}
        if SPACE_AFTER_SPACE.search(text) or not is_common(text):
            return self.pieces(text)
        first, *chunks = text.split(" ")
        known = self.chunks
        for chunk in set(chunks).difference(known):
            known[chunk] = self.pieces(" " + chunk)
        return self.pieces(first) + sum(map(known.__getitem__, chunks))

    def text(self, text: str) -> int:
        """A special string inside the text counts as one token and parts what is around it."""
        if self.special is None or not (found := self.special.findall(text)):
            return self.stretch(text)
        return len(found) + sum(map(self.stretch, self.special.split(text)))


def counter(path: str) -> MergeCounter:
    """One a Python worker, so pieces counted in one task are known in the next."""
    return held(("merge counter", path), lambda: MergeCounter(path))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id, text``).

    Works row by row where the rows lie, without a shuffle. A null or empty text has 0 tokens; a
    null ``doc_id`` stays null; repeated rows come out repeated; other columns are not read.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        tokens = [counter(vocabulary).text(text) for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "n_bytes": rows["n_bytes"], "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens]}

    sized = documents(docs).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    return by_batch(sized, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", work)
