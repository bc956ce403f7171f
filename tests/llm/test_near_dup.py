"""Near duplicates and components against brute force."""

import random

import numpy as np
import pytest

from shopfront.llm import graph, near_dup


def brute(rows, width, percent):
    """Smallest doc_id reachable, by all pairs of rows with an id and a word."""
    nodes = [(i, near_dup.shingles(t or "", width)) for i, t in rows]
    reach = list(range(len(nodes)))

    def root(at):
        while reach[at] != at:
            at = reach[at]
        return at

    for i, (a, s) in enumerate(nodes):
        for j, (b, t) in enumerate(nodes[:i]):
            if a is not None and b is not None and s and near_dup.similar(s, t, percent):
                reach[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for at, (i, _) in enumerate(nodes):
        if i is not None:
            smallest[root(at)] = min(smallest.get(root(at), i), i)
    return sorted(((i, len(s), smallest.get(root(at)) if i is not None else None) for at, (i, s) in enumerate(nodes)), key=repr)


def found(table, width, percent):
    rows = near_dup.link(table, width, percent).collect()
    for r in rows:
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def family(rng, words, copies, edits):
    """Edited copies of one text: neighbours are similar, the ends of the chain are not."""
    text, out = [f"w{rng.randrange(500)}" for _ in range(words)], []
    for _ in range(copies):
        for _ in range(edits):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(make, monkeypatch, width):
    monkeypatch.setattr(near_dup, "BLOCK", 8)  # many blocks a bucket
    rng = random.Random(width)
    texts = family(rng, 120, 30, 1) + family(rng, 60, 25, 2) + family(rng, 40, 20, 6)
    base = [f"w{n}" for n in range(150)]
    for _ in range(40):  # one hot group at very different similarities
        at = set(rng.sample(range(150), rng.randrange(1, 16)))
        texts.append(" ".join(f"x{rng.randrange(10**6)}" if n in at else w for n, w in enumerate(base)))
    texts += ["a b", "a b", "a", "A", "", None, "a b c", "A  B\nC", " ".join(["x"] * 50), "x " * 40]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(make(rows), width, 80) == brute(rows, width, 80)


def test_awkward_rows(awkward, empty):
    rows = [(r[0], r[1]) for r in awkward.collect()]
    assert found(awkward, 2, 80) == brute(rows, 2, 80)
    assert near_dup.link(empty).count() == 0
    kept = near_dup.keep_one(awkward)
    assert kept.columns == awkward.columns
    assert sorted((repr(r[0]), r[1] or "") for r in kept.collect()) == sorted({(repr(i), t or "") for i, t in rows})
    assert near_dup.keep_one(empty).count() == 0


def test_one_of_each_group_stays(make):
    text = " ".join(f"w{n}" for n in range(200))
    docs = make([(7, text), (3, text), (5, text + " more"), (9, "something else altogether here now")])
    assert sorted(r.doc_id for r in near_dup.keep_one(docs).collect()) == [3, 9]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    for size in (1, 2, 10, 511, 5000):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        assert len(near_dup.sketch(a)) == near_dup.BINS
    for share in (0.5, 0.8, 0.95):
        union = rng.integers(0, 2**63, 1000).astype(np.uint64)
        cut = int(1000 * (1 + share) / 2)
        a, b = near_dup.sketch(union[:cut]), near_dup.sketch(union[1000 - cut :])
        assert abs((a == b).mean() - (2 * cut - 1000) / 1000) < near_dup.SLACK


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    links = [(n, n + 1) for n in range(1000, 1100)] + [(5, n) for n in range(20, 80)] + [(3, 3), (90, 91), (91, 90)]
    rng.shuffle(links)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == 1000 for n in range(1000, 1101)) and all(got[n] == 5 for n in range(20, 80))
    assert got[91] == 90 and 3 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
