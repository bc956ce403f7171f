"""Batches cut by bytes, and the one helper that a worker keeps."""

import pyarrow as pa
import pytest

from shopfront.llm import common


def test_batches_are_cut_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(common, "SLICE_ROWS", 50)
    monkeypatch.setattr(common, "SLICE_BYTES", 1000)
    texts = ["x" * (n % 7) for n in range(300)] + [None, "y" * 5000, "z" * 900, "é" * 60, None, "end"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["at", "text"])
    parts = list(common.slices(batch))
    assert [v for p in parts for v in p.column(0).to_pylist()] == list(range(len(texts)))
    for part in parts:
        size = sum(len((t or "").encode()) for t in part.column(1).to_pylist())
        assert 0 < part.num_rows <= 50 and (size <= 1000 or part.num_rows == 1)
    assert list(common.slices(batch.slice(0, 0))) == []
    assert [p.num_rows for p in common.slices(batch.slice(301, 3))] == [1, 1, 1]


def test_a_worker_keeps_one_helper():
    made = []

    def make(name):
        return lambda: made.append(name) or name

    assert [common.held(n, make(n)) for n in ("a", "a", "b", "b", "a")] == ["a", "a", "b", "b", "a"]
    assert made == ["a", "b", "a"]


@pytest.mark.parametrize("rows", [0, 1, 2500])
def test_work_by_batch_covers_every_row(spark, rows):
    table = spark.range(rows).selectExpr("id AS doc_id", "repeat('w', int(id % 40)) AS text")
    out = common.by_batch(table, "doc_id bigint, size int", lambda part: {"doc_id": part["doc_id"], "size": [len(t) for t in part["text"]]})
    assert sorted(map(tuple, out.collect())) == [(n, n % 40) for n in range(rows)]


def test_a_step_without_helper_gives_up_the_one_before(make, monkeypatch):
    from shopfront.llm import pii, toxicity

    steps, docs = [], make([(1, "some words, 10 of 12")])
    for module in (toxicity, pii):
        monkeypatch.setattr(module, "by_batch", lambda *step: steps.append(step[2]) or common.by_batch(*step))
    toxicity.training_rows(docs, make([(1, 1)], "doc_id bigint, toxic int"))
    pii.training_spans(docs)
    for step in steps:
        assert common.held("helper", lambda: [0] * 9) == [0] * 9
        step({"doc_id": [1], "toxic": [1], "text": ["some words"]})
        assert common._held == [None, None]
    assert len(steps) == 2


def test_batches_reach_python_in_bounded_bytes(make):
    """A task's rows came in one batch of up to 64 MB, held by the executor and by the worker."""
    docs = make([(n, "x" * 100_000) for n in range(200)]).coalesce(1)

    def walk(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([str(batch.nbytes)] * batch.num_rows)], batch.schema.names)

    rows = common.by_row(docs, walk).collect()
    assert [r.doc_id for r in rows] == list(range(200))
    assert max(int(r.text) for r in rows) < common.BATCH_BYTES + 1_000_000
