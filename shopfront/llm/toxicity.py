"""Toxicity by a recurrent network over words and characters that reads every text window by window.

The network is fitted in the driver on a bounded sample of labelled rows; scoring runs where the
rows lie, without a shuffle. See ``gru`` for the network itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.llm import gru
from shopfront.llm.common import by_batch, by_row, documents, held, let_go, pick, position, slices

#: The rows of either label that the network learns from, each of them whole, as the highest of all
#: windows counts when texts are scored. Only fitting is bounded; every text is scored whole.
POSITIVES, NEGATIVES = 1000, 3000
FOLDS, HELD_OUT = 5, 0


def fold() -> F.Column:
    """The row's fold by the checksum of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[list[list[str]], int]]:
    """At most ``POSITIVES`` and ``NEGATIVES`` labelled documents, chosen by a hash of the id, as
    all their windows of words. Rows of the held-out fold and rows without a label take no part."""
    marked = pick(labels, doc_id="bigint", toxic="int").where("toxic IN (0, 1)").where(fold() != HELD_OUT)
    mixed = F.xxhash64("doc_id")
    chosen = (
        marked.where("toxic = 1").orderBy(mixed, "doc_id").limit(POSITIVES)
        .unionByName(marked.where("toxic = 0").orderBy(mixed, "doc_id").limit(NEGATIVES))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )

    def work(rows: dict[str, list]) -> dict[str, list]:
        let_go()
        words = [" ".join(gru.core(c) for c in text.split()) for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "toxic": rows["toxic"], "words": words}

    few = documents(docs).join(F.broadcast(chosen), "doc_id")  # at most POSITIVES + NEGATIVES ids
    found = by_batch(few, "doc_id bigint, toxic int, words string", work)
    rows = found.orderBy("doc_id", "words").limit(2 * (POSITIVES + NEGATIVES)).collect()
    one: dict[str, str] = {}  # one object a distinct word, as windows of all rows share them
    out = []
    for row in rows:
        words = [one.setdefault(w, w) for w in row["words"].split(" ")]
        out.append(([words[s : s + gru.WINDOW] for s in gru.starts(len(words))], row["toxic"]))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> gru.Network:
    return gru.train(training_rows(docs, labels))


def scorer(network: gru.Network) -> gru.Scorer:
    return held(("scorer", network.name), lambda: gru.Scorer(network))


def score(docs: DataFrame, network: gru.Network) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null or empty text is one window without words and gets a score too; a null ``doc_id`` is in
    no fold (``held_out`` false). Repeated rows come out repeated, columns other than ``doc_id`` and
    ``text`` are never read, and with no usable label every text scores near 0.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        scores = scorer(network).scores(rows["text"])
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": scores,
                "predicted": [int(s >= 0.5) for s in scores]}

    marked = documents(docs).withColumn("held_out", F.coalesce(fold() == HELD_OUT, F.lit(False)))
    return by_batch(marked, "doc_id bigint, held_out boolean, score double, predicted int", work)


def keep_clean(docs: DataFrame, network: gru.Network, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns as they are, whose text scores below ``threshold``."""
    at = position(docs, "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = scorer(network).scores([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return by_row(docs, walk)
