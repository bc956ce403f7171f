"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A window is a fixed number of words. A word enters as the sum of two inputs: a vector of its own if
the vocabulary has it, and the scaled sum of vectors of its character sequences, found by hash. Both
directions read the window, attention weighs the positions, and a logistic unit scores the mixture.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np

WINDOW, STRIDE = 24, 20  # words a window, and from one start to the next
GRAMS = (2, 4, 5)  # lengths of character sequences, the word's ends included
BUCKETS = 1 << 16  # vectors for character sequences
HIDDEN, WORD, CHAR, ATTENTION = 12, 12, 12, 8
#: What learning is bounded by, beside the sample of rows: words with a vector of their own, and windows of
#: a row that each of the two first passes takes at random. The passes after them choose among all.
VOCABULARY, FIRST_WINDOWS = 20_000, 4
KEPT_CHUNKS = 150_000  # chunks whose inputs a Python worker keeps; beyond it, it starts anew
_CORE = re.compile(r"\w(?:.*\w)?", re.S)


def core(chunk: str) -> str:
    """A chunk between white space without the punctuation around it, lower-cased."""
    if chunk.isalnum():
        return chunk.lower()
    found = _CORE.search(chunk)
    return (found[0] if found else chunk).lower()


def starts(words: int) -> list[int]:
    """Starts of windows that overlap and cover all words; the last one ends with the text."""
    if words <= WINDOW:
        return [0]
    return [*range(0, words - WINDOW, STRIDE), words - WINDOW]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character sequences of the words, and each word's first place in them."""
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    left = np.repeat(firsts + sizes, sizes) - np.arange(len(codes))  # characters to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    found, owners = [], []
    for n in GRAMS:
        here = np.flatnonzero(left >= n)
        hashed = np.full(len(here), n, dtype=np.uint64)
        for at in range(n):
            hashed = (hashed ^ codes[here + at]) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
        found.append((hashed >> np.uint64(11)) % np.uint64(BUCKETS))
        owners.append(owner[here])
    found, owners = np.concatenate(found).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the rows of ``values`` for each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    firsts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[firsts], np.add.reduceat(values[order], firsts, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


class Network:
    """Weights, and both directions of the computation. ``vocabulary`` maps words to rows from 1;
    row 0 of the word vectors stands for any other word."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.name = vocabulary, uuid.uuid4().hex
        size = WORD + CHAR

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        self.weights = {
            "words": (rng.standard_normal((len(vocabulary) + 1, WORD)) * 0.1).astype(np.float32),
            "chars": (rng.standard_normal((BUCKETS, CHAR)) * 0.1).astype(np.float32),
            "inputs": draw(2, size, 3 * HIDDEN), "states": draw(2, HIDDEN, 3 * HIDDEN),
            "bias": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "attend": draw(2 * HIDDEN, ATTENTION), "query": draw(ATTENTION, 1)[:, 0],
            "out": draw(2 * HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0

    # --- inputs -------------------------------------------------------------------------
    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the rows, buckets and places they come from."""
        rows = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        buckets, places = grams(words)
        counts = np.diff(places)
        chars = np.add.reduceat(self.weights["chars"][buckets], places[:-1], axis=0)
        scale = (1 / np.sqrt(np.maximum(counts, 1))).astype(np.float32)
        return np.hstack([self.weights["words"][rows], chars * scale[:, None]]), rows, buckets, places

    def project(self, words: list[str]) -> np.ndarray:
        """What a word adds to the gates in either direction: [words, 2, 3 * HIDDEN]."""
        inputs = self.features(words)[0]
        return np.einsum("wi,dij->wdj", inputs, self.weights["inputs"]) + self.weights["bias"][:, 0]

    # --- forward ------------------------------------------------------------------------
    def forward(self, projected: np.ndarray, index: np.ndarray, real: np.ndarray):
        """Logits of windows, and what the way back needs. ``index``: [windows, steps] into
        ``projected``; ``real``: words, not padding."""
        weights, (batch, steps) = self.weights, index.shape
        gates = projected.reshape(len(projected), -1)
        hidden = np.zeros((2, batch, HIDDEN), np.float32)
        states = np.empty((steps, batch, 2 * HIDDEN), np.float32)
        kept, two = [], 2 * HIDDEN
        for step in range(steps):
            ways = (step, steps - 1 - step)
            inputs = np.stack([gates[index[:, ways[0]], : 3 * HIDDEN], gates[index[:, ways[1]], 3 * HIDDEN :]])
            recurrent = np.matmul(hidden, weights["states"])
            both = _sigmoid(inputs[:, :, :two] + recurrent[:, :, :two])
            update, reset = both[:, :, :HIDDEN], both[:, :, HIDDEN:]
            new = np.tanh(inputs[:, :, two:] + reset * recurrent[:, :, two:])
            mask = np.stack([real[:, ways[0]], real[:, ways[1]]])[:, :, None]
            following = new + update * (hidden - new)
            following = np.where(mask, following, hidden)
            kept.append((hidden, update, reset, new, recurrent[:, :, two:], mask))
            hidden = following
            states[ways[0], :, :HIDDEN], states[ways[1], :, HIDDEN:] = hidden[0], hidden[1]
        shown = np.tanh(states @ weights["attend"])
        energy = np.where(real.T, shown @ weights["query"], np.float32(-1e9))
        energy = np.exp(energy - energy.max(axis=0))
        share = energy / energy.sum(axis=0)
        mixed = np.einsum("tb,tbh->bh", share, states)
        logits = mixed @ weights["out"] + weights["out_bias"]
        return logits, (states, shown, share, mixed, kept)

    def infer(self, table: np.ndarray, index: np.ndarray, real: np.ndarray) -> np.ndarray:
        """The logits of ``forward``, in place and with the mixture taken after the output weights.
        ``table``: [2, words, 3 * HIDDEN], its gate columns halved as a logistic curve by ``tanh`` needs."""
        weights, (batch, steps), two = self.weights, index.shape, 2 * HIDDEN
        recur = weights["states"] * np.repeat(np.float32([0.5, 1]), [two, HIDDEN])
        steps_first, full = np.ascontiguousarray(index.T), bool(real.all())
        hidden = np.zeros((2, batch, HIDDEN), np.float32)
        inputs, recurrent = (np.empty((2, batch, 3 * HIDDEN), np.float32) for _ in range(2))
        states = np.empty((steps, batch, 2 * HIDDEN), np.float32)
        for step in range(steps):
            back = steps - 1 - step
            np.take(table[0], steps_first[step], axis=0, out=inputs[0], mode="clip")
            np.take(table[1], steps_first[back], axis=0, out=inputs[1], mode="clip")
            np.matmul(hidden, recur, out=recurrent)
            gates = inputs[:, :, :two] + recurrent[:, :, :two]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = recurrent[:, :, two:] * gates[:, :, HIDDEN:]
            new += inputs[:, :, two:]
            np.tanh(new, out=new)
            following = hidden - new
            following *= gates[:, :, :HIDDEN]
            following += new
            if not full:
                following = np.where(np.stack([real[:, step], real[:, back]])[:, :, None], following, hidden)
            hidden = following
            states[step, :, :HIDDEN], states[back, :, HIDDEN:] = hidden
        shown = states.reshape(-1, two) @ np.hstack([weights["attend"], weights["out"][:, None]])
        energy = (np.tanh(shown[:, :-1]) @ weights["query"]).reshape(steps, batch)
        if not full:
            energy[~real.T] = -1e9
        energy = np.exp(energy - energy.max(axis=0))
        voted = (energy * shown[:, -1].reshape(steps, batch)).sum(axis=0) / energy.sum(axis=0)
        return voted + weights["out_bias"]

    # --- backward -----------------------------------------------------------------------
    def gradients(self, words: list[str], index: np.ndarray, real: np.ndarray, labels: np.ndarray,
                  importance: np.ndarray) -> dict[str, np.ndarray | tuple]:
        weights, (batch, steps) = self.weights, index.shape
        inputs, rows, buckets, places = self.features(words)
        projected = np.einsum("wi,dij->wdj", inputs, weights["inputs"]) + weights["bias"][:, 0]
        logits, (states, shown, share, mixed, kept) = self.forward(projected, index, real)
        d_logit = ((_sigmoid(logits) - labels) * importance / batch).astype(np.float32)
        grad = {"out": mixed.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_mixed = d_logit[:, None] * weights["out"]
        d_states = share[:, :, None] * d_mixed
        d_share = np.einsum("bh,tbh->tb", d_mixed, states)
        d_energy = share * (d_share - (share * d_share).sum(axis=0))
        grad["query"] = np.einsum("tb,tba->a", d_energy, shown)
        d_shown = d_energy[:, :, None] * weights["query"] * (1 - shown**2)
        grad["attend"] = np.einsum("tbh,tba->ha", states, d_shown)
        d_states += d_shown @ weights["attend"].T
        d_steps = np.empty((2, batch, steps, 3 * HIDDEN), np.float32)
        grad["states"], two = np.zeros_like(weights["states"]), 2 * HIDDEN
        d_hidden = np.zeros((2, batch, HIDDEN), np.float32)
        for step in reversed(range(steps)):
            ways = (step, steps - 1 - step)
            hidden, update, reset, new, candidate, mask = kept[step]
            arriving = d_hidden + np.stack([d_states[ways[0], :, :HIDDEN], d_states[ways[1], :, HIDDEN:]])
            d_following = np.where(mask, arriving, 0)
            d_new = d_following * (1 - update) * (1 - new**2)
            d_gates = np.concatenate([d_following * (hidden - new) * update * (1 - update),
                                      d_new * candidate * reset * (1 - reset), d_new], axis=2)
            d_recurrent = np.concatenate([d_gates[:, :, :two], d_new * reset], axis=2)
            grad["states"] += np.matmul(hidden.transpose(0, 2, 1), d_recurrent)
            d_hidden = (np.where(mask, d_following * update, arriving)
                        + np.matmul(d_recurrent, weights["states"].transpose(0, 2, 1)))
            d_steps[0, :, ways[0]], d_steps[1, :, ways[1]] = d_gates
        d_projected = np.zeros((len(words), 2, 3 * HIDDEN), np.float32)
        for way in (0, 1):
            at, total = summed(index.ravel(), d_steps[way].reshape(-1, 3 * HIDDEN))
            d_projected[at, way] = total
        grad["bias"] = d_projected.sum(axis=0)[:, None]
        grad["inputs"] = np.einsum("wi,wdj->dij", inputs, d_projected)
        d_inputs = np.einsum("wdj,dij->wi", d_projected, weights["inputs"])
        counts = np.diff(places)
        spread = np.repeat(d_inputs[:, WORD:] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0)
        grad["words"], grad["chars"] = (rows, d_inputs[:, :WORD]), (buckets, spread)
        return grad


class Steps:
    """Adaptive steps: Adam for the dense weights, per-row root sums for the vectors."""

    def __init__(self, network: Network, rate: float):
        self.network, self.rate, self.time = network, rate, 0
        self.first = {k: np.zeros_like(w) for k, w in network.weights.items() if k not in ("words", "chars")}
        self.second = {k: np.zeros_like(w) for k, w in self.first.items()}
        self.sums = {k: np.full(len(network.weights[k]), 1e-6, np.float32) for k in ("words", "chars")}

    def take(self, grad: dict) -> None:
        self.time += 1
        for name, g in grad.items():
            w = self.network.weights[name]
            if isinstance(g, tuple):
                rows, total = summed(*g)
                self.sums[name][rows] += (total**2).mean(axis=1)
                w[rows] -= self.rate * 5 * total / np.sqrt(self.sums[name][rows])[:, None]
                continue
            self.first[name] = 0.9 * self.first[name] + 0.1 * g
            self.second[name] = 0.999 * self.second[name] + 0.001 * g**2
            step = self.first[name] / (1 - 0.9**self.time)
            w -= self.rate * step / (np.sqrt(self.second[name] / (1 - 0.999**self.time)) + 1e-8)


def layout(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, [windows, WINDOW] places in them, and which of these are words."""
    number: dict[str, int] = {"": 0}
    index = np.zeros((len(windows), WINDOW), np.int64)
    real = np.zeros((len(windows), WINDOW), bool)
    for at, words in enumerate(windows):
        words = words or [""]
        index[at, : len(words)] = [number.setdefault(w, len(number)) for w in words]
        real[at, : len(words)] = True
    return list(number), index, real


def train(documents: list[tuple[list[list[str]], int]], seed: int = 7) -> Network:
    """Fits a network to documents given as windows and a 0/1 label.

    First every window takes its document's label. Then, in turns, the network scores all windows
    and learns from those that score highest in each document, since a document is marked for
    its worst passage. A fifth of the documents sets the scale of the final scores.
    """
    rng = np.random.default_rng(seed)
    seen = Counter(w for windows, _ in documents for w in {w for words in windows for w in words})
    frequent = [w for w, n in seen.most_common(VOCABULARY) if n >= 3]
    network = Network({w: at for at, w in enumerate(frequent, 1)}, seed)
    if len({label for _, label in documents}) < 2:  # nothing to tell apart
        share = float(np.mean([label for _, label in documents])) if documents else 0.0
        network.weights["out"][:] = 0
        network.shift = -4.0 if share < 0.5 else 4.0
        return network
    held = rng.random(len(documents)) < 0.2
    held &= len(documents) >= 500
    learn = [d for d, out in zip(documents, held) if not out]
    steps = Steps(network, 0.01)
    positive = max(1, sum(label for _, label in learn))
    importance = {1: 0.5 * len(learn) / positive, 0: 0.5 * len(learn) / max(1, len(learn) - positive)}

    def fit(examples: list[tuple[list[str], int]]) -> None:
        order = rng.permutation(len(examples))
        size = min(256, max(16, len(examples) // 40))  # some forty steps at least, however few examples
        for at in range(0, len(order), size):
            part = [examples[i] for i in order[at : at + size]]
            labels = np.array([label for _, label in part], np.float32)
            weigh = np.array([importance[label] for _, label in part], np.float32)
            steps.take(network.gradients(*layout([words for words, _ in part]), labels, weigh))

    for _ in range(2):
        fit([(windows[i], label) for windows, label in learn
             for i in rng.permutation(len(windows))[:FIRST_WINDOWS]])
    for turn in range(4):
        steps.rate = 0.01 / (turn + 1)
        scored = document_logits(network, [windows for windows, _ in learn])
        chosen = []
        for (windows, label), logits in zip(learn, scored):
            best = np.argsort(-logits)[: 2 if label else 1]
            chosen += [(windows[i], label) for i in (*best, *rng.permutation(len(windows))[: 1 - label])]
        fit(chosen)
        fit(chosen)
    fitted = [d for d, out in zip(documents, held) if out] if held.any() else documents
    top = np.array([x.max() for x in document_logits(network, [w for w, _ in fitted])])
    network.scale, network.shift = calibrate(top, np.array([label for _, label in fitted]))
    return network


def calibrate(top: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve over the documents' highest logits. Newton steps, halved
    until the penalised loss falls; the penalty keeps the scale finite where classes part cleanly."""
    inputs = np.stack([top, np.ones_like(top)], axis=1).astype(np.float64)
    pull = np.array([0.05, 0.001])
    start = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        x = inputs @ at
        return float((np.logaddexp(0, x) - labels * x).sum() + (pull * (at - start) ** 2).sum() / 2)

    found = start
    for _ in range(100):
        p = _sigmoid(np.clip(inputs @ found, -30, 30))
        slope = inputs.T @ (p - labels) + pull * (found - start)
        curve = (inputs * (p * (1 - p))[:, None]).T @ inputs + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        while loss(found - step) > loss(found) and np.abs(step).max() > 1e-9:
            step = step / 2
        found = found - step
        if np.abs(step).max() < 1e-7:
            break
    return (float(found[0]), float(found[1])) if found[0] > 0 else (1.0, 0.0)


def document_logits(network: Network, documents: list[list[list[str]]]) -> list[np.ndarray]:
    flat = [words for windows in documents for words in windows]
    logits = np.empty(len(flat), np.float32)
    for at in range(0, len(flat), 4096):
        words, index, real = layout(flat[at : at + 4096])
        table = network.project(words)
        table[:, :, : 2 * HIDDEN] *= 0.5
        table = np.ascontiguousarray(table.transpose(1, 0, 2))
        logits[at : at + 4096] = network.infer(table, index, real)
    return np.split(logits, np.cumsum([len(windows) for windows in documents])[:-1])


class Scorer:
    """Scores texts, keeping what distinct chunks add to the gates from text to text."""

    BLOCK = 1536  # windows that go through the network together

    def __init__(self, network: Network):
        self.network = network
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.table = np.empty((2, 1 << 12, 3 * HIDDEN), np.float32)
        self.learn([""])

    def learn(self, chunks: list[str]) -> None:
        first = len(self.number)
        need = first + len(chunks)
        if need > self.table.shape[1]:
            grown = np.empty((2, max(need, 2 * self.table.shape[1]), 3 * HIDDEN), np.float32)
            grown[:, :first] = self.table[:, :first]
            self.table = grown
        projected = self.network.project([core(c) for c in chunks])
        projected[:, :, : 2 * HIDDEN] *= 0.5
        self.table[:, first:need] = projected.transpose(1, 0, 2)
        self.number.update(zip(chunks, range(first, need)))

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window logit of each text."""
        if len(self.number) > KEPT_CHUNKS:
            self.reset()
        cut = [text.split() or [""] for text in texts]
        new = list(set().union(*cut).difference(self.number))
        for at in range(0, len(new), 5000):  # character sequences of so many chunks at once
            self.learn(new[at : at + 5000])
        ids, firsts, owners, total = [], [], [], 0
        for at, chunks in enumerate(cut):
            ids.append(np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks)))
            here = starts(len(chunks))
            firsts += [total + start for start in here]
            owners += [at] * len(here)
            total += len(chunks)
        ids = np.concatenate([*ids, np.zeros(WINDOW, np.int64)])
        ends = np.cumsum([len(chunks) for chunks in cut])
        firsts, owners = np.array(firsts), np.array(owners)
        best = np.full(len(texts), -np.inf, np.float32)
        for at in range(0, len(firsts), self.BLOCK):
            place = firsts[at : at + self.BLOCK, None] + np.arange(WINDOW)
            real = place < ends[owners[at : at + self.BLOCK], None]
            logits = self.network.infer(self.table, ids[place], real)
            np.maximum.at(best, owners[at : at + self.BLOCK], logits)
        return best

    def scores(self, texts: list[str]) -> list[float]:
        """Between 0 and 1 for each text."""
        if not texts:
            return []
        x = np.clip(self.network.scale * self.logits(texts) + self.network.shift, -30, 30)
        return _sigmoid(x.astype(np.float64)).tolist()
