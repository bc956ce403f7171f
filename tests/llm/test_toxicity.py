"""The network's gradients, held-out accuracy, and rows that are awkward."""

import random
import zlib

import numpy as np

from shopfront.llm import gru, toxicity


def test_gradients_by_differences():
    net = gru.Network({"a": 1, "bad": 2}, seed=1)
    for name in net.weights:
        net.weights[name] = net.weights[name].astype(np.float64)
    words, index, real = gru.layout([["a", "bad", "c"], ["xy", "a"], ["q"] * gru.WINDOW])
    labels, weigh = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        x = net.forward(net.project(words), index, real)[0]
        return float(((np.logaddexp(0, x) - labels * x) * weigh).mean())

    grad = net.gradients(words, index, real, labels, weigh)
    rng = np.random.default_rng(0)
    for name in ("inputs", "states", "bias", "attend", "query", "out", "out_bias"):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.weights[name].shape)
            old = net.weights[name][at]
            net.weights[name][at] = old + 1e-3
            up = loss()
            net.weights[name][at] = old - 1e-3
            slope = (up - loss()) / 2e-3
            net.weights[name][at] = old
            assert abs(slope - grad[name][at]) < 1e-3 + 0.02 * abs(slope), name


def test_windows_cover_every_word():
    for words in (0, 1, gru.WINDOW, gru.WINDOW + 1, 500):
        seen = {w for s in gru.starts(words) for w in range(s, min(words, s + gru.WINDOW))}
        assert seen == set(range(words))


def corpus():
    rng = random.Random(5)
    docs, labels = [], []
    for n in range(1200):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}" for _ in range(rng.randrange(1, 150))]
        toxic = n % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 40):
                words[rng.randrange(len(words))] = rng.choice(["vex" + rng.choice(["ando", "ique", "ul"]), "stinker"])
        docs.append((n, " ".join(words)))
        labels.append((n, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(make, spark):
    docs, labels = corpus()
    table, marks = make(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    network = toxicity.fit(table, marks)
    rows = {r.doc_id: r for r in toxicity.score(table, network).collect()}
    assert all(rows[n].held_out == (zlib.crc32(str(n).encode()) % 5 == 0) for n in rows)
    held = [(rows[n].predicted, y) for n, _, y in labels if rows[n].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    kept = {r.doc_id for r in toxicity.keep_clean(table, network).collect()}
    assert kept == {n for n in rows if not rows[n].predicted}


def test_scores_do_not_depend_on_the_batch():
    docs, labels = corpus()
    network = gru.train([([t.split()[s : s + gru.WINDOW] for s in gru.starts(len(t.split()))], y) for (_, t), (_, _, y) in zip(docs[:200], labels)])
    texts = [t for _, t in docs[:60]] + ["", "word " * 3000]
    together = gru.Scorer(network).scores(texts)
    alone = [gru.Scorer(network).scores([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-4)


def test_sampled_rows_are_learned_from_whole(make, spark):
    texts = [" ".join(f"W{n}." for n in range(size)) for size in (0, 10, 24, 250, 1350)]
    marks = spark.createDataFrame([(n, 1, n % 2) for n in (1, 2, 3, 4, 6, 7, 8, 9)], "doc_id bigint, quality int, toxic int")
    ids = [n for n in range(1, 10) if n != 5 and zlib.crc32(str(n).encode()) % 5][: len(texts)]
    assert len(ids) == len(texts)
    for (windows, label), n, text in zip(toxicity.training_rows(make(list(zip(ids, texts))), marks), ids, texts):
        words = [gru.core(w) for w in text.split()] or [""]
        assert label == n % 2 and windows == [words[s : s + gru.WINDOW] for s in gru.starts(len(words))]


def test_awkward_rows(awkward, empty, spark):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 7)], "doc_id bigint, quality int, toxic int")
    network = toxicity.fit(awkward, none)
    rows = toxicity.score(awkward, network).collect()
    assert len(rows) == awkward.count() and all(r.predicted == 0 for r in rows)
    back = toxicity.keep_clean(awkward, network)
    assert back.columns == awkward.columns and back.count() == awkward.count()
    assert toxicity.score(empty, network).count() == 0 and toxicity.fit(empty, none) is not None


def test_scores_are_the_highest_of_all_windows_by_the_plain_way():
    rng = random.Random(2)
    net = gru.Network({"a": 1, "bad": 2, "word3": 3}, seed=4)
    net.scale, net.shift = 3.0, -0.5
    texts = ["", " \n", "a", "Bad, a!", *(" ".join(rng.choice(["a", "BAD", "other", "é日", "x1", "(a)", "word3"]) for _ in range(n)) for n in (3, 24, 25, 44, 200, 1500))]
    expected = []
    for text in texts:
        words = [gru.core(c) for c in text.split()] or [""]
        windows = [words[s : s + gru.WINDOW] for s in gru.starts(len(words))]
        logits = [float(net.forward(net.project(w), index, real)[0][0]) for w, index, real in (gru.layout([window]) for window in windows)]
        expected.append(1 / (1 + np.exp(-(net.scale * max(logits) + net.shift))))
    scorer = gru.Scorer(net)
    assert np.allclose(scorer.scores(texts), expected, atol=2e-5)
    assert np.allclose([scorer.scores([t])[0] for t in texts[::-1]], expected[::-1], atol=2e-5)
    assert np.allclose([x.max() for x in gru.document_logits(net, [[["a", "bad"], ["a"]], [["q"] * 24]])],
                       [max(float(net.forward(net.project(w), i, r)[0][0]) for w, i, r in (gru.layout([win]) for win in d)) for d in ([["a", "bad"], ["a"]], [["q"] * 24])], atol=2e-5)
