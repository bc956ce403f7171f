"""Token counts and packing against the library."""

import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shopfront.llm import bpe_count, packing

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    "", " ", "  a  b\n\n c'll don't  ", "<|endoftext|>x <|endoftext|> <|startoftext|>y", "ab\x1c\x1d c\x85d\xa0e",
    "日本語 テスト ١٢٣ ½²³ ΑΣ ΣΑΣ. İstanbul ŉ ǅ é İ", "a" * 3000, "'S 'LL ''s .'s   x　y", "🙂🙂 x‍y ß ẞ",
    "end.\nNext  line \n\ttab", "é Å", "trailing space ", "\n \n",
]


def texts():
    rng = random.Random(1)
    letters = "ab 'éß\n\t0².,!İΣ \x1c中<|>"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(1500)]


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(BYTES), bpe_count.MergeCounter(BYTES)
    for text in texts():
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_word_ids_equal_the_library():
    library, words = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert words.text(text) == b"".join(i.to_bytes(4, "little") for i in ids), text


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe_count, "KEPT_PIECES", 5)
    monkeypatch.setattr(packing, "KEPT_CHUNKS", 5)
    test_counts_equal_the_library()
    test_word_ids_equal_the_library()


def test_counts_of_awkward_rows(awkward, empty):
    rows = bpe_count.count_tokens(awkward, BYTES, 1024).collect()
    library = Tokenizer.from_file(BYTES)
    expected = Counter()
    for row in awkward.collect():
        text = row[1] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        expected[row[0], len(text.encode()), n, n > 1024] += 1
    assert Counter(map(tuple, rows)) == expected
    assert bpe_count.count_tokens(empty, BYTES, 1024).count() == 0


def check_packing(docs, size, rows):
    """Pieces tile documents, checksums fit, sequences are gapless and no longer than ``size``."""
    library = Tokenizer.from_file(WORDS)
    ids = Counter()
    for row in docs:
        found = [*library.encode(row[1] or "", add_special_tokens=False).ids, 1]
        for start in range(0, len(found), size):
            part = found[start : start + size]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            ids[row[0], start, len(part), crc, len(found)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == ids
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(r.length for r in rows) / (len(sequences) * size) if rows else 1.0


@pytest.mark.parametrize("size", [2048, 16])
def test_packing_of_awkward_rows(awkward, empty, size):
    check_packing(awkward.collect(), size, packing.pack(awkward, WORDS, size=size).collect())
    assert packing.pack(empty, WORDS, size=size).count() == 0


def test_packing_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert check_packing(rows, 2048, packing.pack(docs, WORDS).collect()) > 0.95


def test_hot_length_is_counted_in_buckets(make, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_A_BUCKET", 10)
    docs = make([(i, "same words here") for i in range(300)])
    rows = packing.pack(docs, WORDS, size=64).collect()
    check_packing(docs.collect(), 64, rows)
    assert len({r.sequence_id for r in rows}) == 19  # 16 of 4 ids each fill a sequence


def test_placements_hold_every_piece():
    rng = random.Random(2)
    for _ in range(30):
        size = rng.choice([8, 100, 2048])
        histogram = {rng.randint(1, size): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        ranks, filled = {}, Counter()
        for length, first, end, each, offset, sequence in packing.place_lengths(histogram, size):
            assert first == ranks.get(length, 0)
            ranks[length] = end
            for rank in range(end - first):
                filled[sequence + rank // each] += length
            assert offset + each * length <= size
        assert ranks == histogram and max(filled.values()) <= size


def test_chunks_take_few_bytes_each():
    """What is kept for a chunk are columns; one object for its text and one for its ids took some 200 bytes."""
    words, n = packing.WordIds(WORDS), 50_000
    texts = [" ".join(f"w{i:x}." for i in range(at, at + 1000)) for at in range(0, n, 1000)]
    found = words.texts([*texts, "", "<|endoftext|>", "ΑΣ", *texts])
    assert [x.tolist() for x in found[: len(texts)]] == [x.tolist() for x in found[-len(texts) :]]
    assert len(words.known) == n + 1 and words.known.nbytes + words.ids.nbytes + words.ends.nbytes < 60 * n
