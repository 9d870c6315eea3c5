"""Text quality: random-indexing word vectors, pooled per text, and a two-layer network with calibrated probabilities.

A text is a stream of words, each with its shape: the kinds of its characters in order (upper, lower, digit, or the
sign itself), runs as one; a word that repeats the one before has a shape of its own. Words and shapes are hashed to
2**BITS buckets. Each bucket has a sparse random index vector, and its word vector is that plus the index vectors of
its neighbours, summed over the sample and scaled to length 1. A text is the mean of its words' vectors next to the
mean of its shapes' vectors and next to their lengths; a tanh layer and a logistic one give a margin, and a
temperature fitted on texts kept aside makes it a probability.

Fitted on the driver on at most ONES + ZEROS labelled texts (whole ones, the first by a hash of their id), weighed to
the classes' true shares. Without labels of both kinds every score is the share of label 1, or 1 without any label.
Every text is scored whole; null, empty and wordless texts have a zero vector and what the network makes of it. Equal
texts have equal scores. An empty table gives no rows; other columns come back as they were, but for one named like the
score, which is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from voxlake.llm import labelled
from voxlake.llm.common import lowered, mix, prefix_hash, span_hash, word_spans
from voxlake.llm.toxicity import sigmoid

BITS, WIDTH, NONZERO, NEAR, HIDDEN, ONES, ZEROS = 15, 32, 4, 2, 24, 3000, 2000

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2


def words_and_shapes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of its shape, and row numbers."""
    starts, ends, rows = word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rows
    data = lowered(raw)
    word = span_hash(prefix_hash(data), starts, ends)
    kind = _KIND[raw]
    new = np.ones(len(raw), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    runs = np.concatenate([[0], np.cumsum(new)])
    shape = span_hash(prefix_hash(kind[new]), runs[starts], runs[ends])
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    shape = np.where(again, np.uint64(1), shape)
    top = np.uint64(64 - BITS)
    return (word >> top).astype(np.int64), (mix(shape + np.uint64(9)) >> top).astype(np.int64), rows


def _streams(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    word, shape, row = words_and_shapes(raw, offsets)
    at = np.searchsorted(row, np.arange(len(offsets)))
    both = np.stack([word, shape], axis=1).astype(np.uint16)
    return [both[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


def index_vectors() -> np.ndarray:
    """A few +1 and -1 for each bucket."""
    rng = np.random.default_rng(17)
    out = np.zeros((1 << BITS, WIDTH), np.float32)
    for k in range(NONZERO):
        out[np.arange(1 << BITS), rng.integers(0, WIDTH, 1 << BITS)] += 1 if k % 2 else -1
    return out


def word_vectors(streams: list[np.ndarray]) -> np.ndarray:
    """(2, buckets, WIDTH): vectors of words and of shapes."""
    index = index_vectors()
    out = np.empty((2, 1 << BITS, WIDTH), np.float32)
    for part in range(2):
        tokens = [s[:, part].astype(np.int64) for s in streams if len(s) > 1]
        sums = index.astype(np.float64)
        seen = np.bincount(np.concatenate(tokens), minlength=1 << BITS) if tokens else np.zeros(1 << BITS)
        sums *= np.maximum(1, seen)[:, None]
        for distance in range(1, NEAR + 1):
            left = np.concatenate([t[:-distance] for t in tokens]) if tokens else np.zeros(0, np.int64)
            right = np.concatenate([t[distance:] for t in tokens]) if tokens else np.zeros(0, np.int64)
            for d in range(WIDTH):
                sums[:, d] += np.bincount(left, index[right, d], 1 << BITS) + np.bincount(right, index[left, d], 1 << BITS)
        out[part] = sums / np.maximum(1e-9, np.sqrt((sums * sums).sum(axis=1, keepdims=True)))
    return out


class Network:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], mean: np.ndarray, scale: np.ndarray, temperature: float, shift: float):
        self.vectors, self.layers, self.mean, self.scale, self.temperature, self.shift = vectors, layers, mean, scale, temperature, shift

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((pooled - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return sigmoid((self.margin(pooled) + self.shift) / self.temperature)

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        word, shape, row = words_and_shapes(raw, offsets)
        return self.probability(pool(self.vectors, word, shape, row, len(offsets) - 1))


def pool(vectors: np.ndarray, word: np.ndarray, shape: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, 2 * WIDTH + 2): means of the word and of the shape vectors, and the lengths of the two."""
    out = np.zeros((n, 2 * WIDTH + 2))
    counts = np.bincount(row, minlength=n)
    filled = np.flatnonzero(counts)
    if len(filled):
        first = (np.cumsum(counts) - counts)[filled]
        for part, token in enumerate((word, shape)):
            sums = np.add.reduceat(vectors[part][token], first, axis=0)
            mean = sums / counts[filled, None]
            out[filled, part * WIDTH : (part + 1) * WIDTH] = mean
            out[filled, 2 * WIDTH + part] = np.sqrt((mean * mean).sum(axis=1))
    return out


def fit_network(streams: list[bytes], label: np.ndarray, counts: dict[int, int], epochs: int = 150, rate: float = 0.02) -> Network:
    """Adam on the log loss of four texts in five; the fifth sets the temperature."""
    width = 2 * WIDTH + 2
    rng = np.random.default_rng(29)
    layers = [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    if len(set(label.tolist())) < 2:
        ones, zeros = counts.get(1, 0), counts.get(0, 0)
        prior = np.log(max(1e-9, ones) / max(1e-9, zeros)) if ones + zeros else 40.0
        layers = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([prior])]
        return Network(np.zeros((2, 1 << BITS, WIDTH), np.float32), layers, np.zeros(width), np.ones(width), 1.0, 0.0)
    lists = [np.frombuffer(s, np.uint16).reshape(-1, 2) for s in streams]
    vectors = word_vectors(lists)
    pooled = np.zeros((len(lists), width))
    for i, s in enumerate(lists):
        pooled[i] = pool(vectors, s[:, 0].astype(np.int64), s[:, 1].astype(np.int64), np.zeros(len(s), np.int64), 1)[0]
    aside = rng.permutation(len(lists)) % 5 == 0
    mean, scale = pooled[~aside].mean(axis=0), pooled[~aside].std(axis=0) + 1e-3
    x, y = (pooled[~aside] - mean) / scale, label[~aside]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in layers]
    turn = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(order), 128):
            a, t = x[order[k : k + 128]], y[order[k : k + 128]]
            hidden = np.tanh(a @ layers[0] + layers[1])
            error = (sigmoid(hidden @ layers[2] + layers[3]) - t) / len(t)
            back = error[:, None] * layers[2] * (1 - hidden * hidden)
            grads = [a.T @ back + 1e-3 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-3 * layers[2], np.array([error.sum()])]
            turn += 1
            for i, (w, g, (m, v)) in enumerate(zip(layers, grads, moments, strict=True)):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                layers[i] = w - rate * 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    total = np.bincount(label, minlength=2)
    # the sample's shares aren't those of all labelled rows
    shift = float(np.log(counts[1] / counts[0]) - np.log(total[1] / total[0]))
    out = Network(vectors, layers, mean, scale, 1.0, shift)
    held, truth = pooled[aside], label[aside]
    if len(set(truth.tolist())) == 2:
        weight = np.array([counts[c] / total[c] for c in range(2)])[truth]
        margins = out.margin(held) + shift

        # as if one more text of each class had been of the other: kinds told apart without error have a temperature too
        ones = np.bincount(truth, minlength=2)
        goal = np.where(truth == 1, (ones[1] + 1) / (ones[1] + 2), 1 / (ones[0] + 2))

        def loss(temperature: float) -> float:
            p = np.clip(sigmoid(margins / temperature), 1e-12, 1 - 1e-12)
            return float(-(weight * (goal * np.log(p) + (1 - goal) * np.log(1 - p))).sum())

        out.temperature = float(min(np.geomspace(1 / 64, 64, 193), key=loss))
    return out


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "quality") -> Network:
    """Learns `label` from the rows of `fold` (a condition on doc_id)."""
    chosen, counts = labelled.sample(labels, label, fold, {1: ONES, 0: ZEROS})
    streams, y = labelled.gathered(docs, chosen, _streams, ONES + ZEROS)
    return fit_network(streams, y, counts)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """`docs` with the score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(network)  # 2 * 2**BITS vectors and the layers: bounded
    return labelled.scored(docs, lambda raw, offsets: held.value.score(raw, offsets))
