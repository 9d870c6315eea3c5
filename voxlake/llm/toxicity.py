"""Toxicity: a factorization machine over hashed terms.

Terms are the letter runs of a text, ASCII in lower case, and their first 4, 5 and 6 bytes, hashed to 2**BITS buckets;
a text has each term once. Of the buckets the machine takes those that label 1 has more often, by a likelihood ratio of
at least LEAST; terms of clean texts say nothing, as a clean passage doesn't make up for an insult. To a bias and a weight for each term it adds, for each
pair of terms in a text, the product of their factor vectors, so that two terms can mean what neither means alone.

Fitted on the driver on at most POSITIVES + NEGATIVES labelled texts (whole ones, the first by a hash of their id);
without labels of both kinds every score is the share of label 1, or 0 without any label. Every text is scored whole,
null texts as empty ones. Equal texts have equal scores. An empty table gives no rows; other columns come back as they
were, but for one named like the score, which is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from voxlake.llm import labelled
from voxlake.llm.common import lowered, prefix_hash, span_hash

BITS, LEAST, FACTORS, POSITIVES, NEGATIVES = 18, 8.0, 4, 2000, 6000
PREFIXES = (4, 5, 6)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and row numbers of all terms of all rows, repeats included."""
    data = lowered(raw)
    letter = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = letter.copy(), letter.copy()
    if len(data):
        first[1:] &= ~letter[:-1] | cut[1:-1]
        last[:-1] &= ~letter[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    prefix = prefix_hash(data)
    hashes, owners = [span_hash(prefix, starts, ends)], [rows]
    for n in PREFIXES:
        long = ends - starts > n
        hashes.append(span_hash(prefix, starts[long], starts[long] + n) ^ np.uint64(n))
        owners.append(rows[long])
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def _sets(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    bucket, row = terms(raw, offsets)
    both = np.unique(row << BITS | bucket)
    at = np.searchsorted(both >> BITS, np.arange(len(offsets)))
    low = (both & ((1 << BITS) - 1)).astype(np.uint32)
    return [low[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]


class Machine:
    """place: bucket -> parameter row or -1."""

    def __init__(self, bias: float, place: np.ndarray, weight: np.ndarray, factor: np.ndarray):
        self.bias, self.place, self.weight, self.factor = bias, place, weight, factor

    def margin(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """The machine's sums for n rows, from parameter rows present in them, each once a row."""
        out = self.bias + np.bincount(row, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, row = terms(raw, offsets)
        term = self.place[bucket].astype(np.int64)
        have = term >= 0
        width = max(1, len(self.weight))
        both = np.unique(row[have] * width + term[have])
        return sigmoid(self.margin(both % width, both // width, len(offsets) - 1))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _likelihood_ratio(with_term: np.ndarray, total: np.ndarray) -> np.ndarray:
    """G of each term's 2 x 2 table; with_term: (2, terms) texts of each class that have it."""
    n = total.sum()
    out = np.zeros(with_term.shape[1])
    for seen in (with_term, total[:, None] - with_term):
        both = seen.sum(axis=0)
        for c in range(2):
            want = np.maximum(both * total[c] / n, 1e-12)
            out += 2 * np.where(seen[c] > 0, seen[c] * np.log(np.maximum(seen[c], 1e-12) / want), 0)
    return out


def fit_machine(sets: list[bytes], label: np.ndarray, counts: dict[int, int], epochs: int = 60, rate: float = 0.2, shrink: float = 1e-5) -> Machine:
    """AdaGrad on the log loss, rows weighed to the classes' true shares. counts: rows by class before sampling."""
    place = np.full(1 << BITS, -1, np.int32)
    none = Machine(-40.0 if not counts.get(1) else float(np.log(counts[1] / max(1e-9, counts.get(0, 0)))) if counts.get(0) else 40.0, place, np.zeros(0), np.zeros((0, FACTORS)))
    if len(set(label.tolist())) < 2:
        return none
    lists = [np.frombuffer(s, np.uint32).astype(np.int64) for s in sets]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    bucket = np.concatenate(lists)
    seen = np.stack([np.bincount(bucket[label[row] == c], minlength=1 << BITS) for c in range(2)]).astype(float)
    total = np.bincount(label, minlength=2).astype(float)
    more = seen[1] * total[0] > seen[0] * total[1]
    taken = np.flatnonzero(more & (_likelihood_ratio(seen, total) >= LEAST) & (seen.sum(axis=0) >= 3))
    place[taken] = np.arange(len(taken))
    term = place[bucket].astype(np.int64)
    row, term = row[term >= 0], term[term >= 0]
    share = np.array([counts[c] / total[c] for c in range(2)])
    worth = share[label] / share[label].mean()
    rng = np.random.default_rng(3)
    odds = np.log((seen[1, taken] + 0.5) / (total[1] + 1)) - np.log((seen[0, taken] + 0.5) / (total[0] + 1))
    start = odds / (1 + len(PREFIXES)) * 1.5  # a word comes with its prefixes; the fit goes on from what each says alone
    machine = Machine(float(np.log(counts[1] / counts[0])), place, start, rng.normal(0, 0.05, (len(taken), FACTORS)))
    sums = [1e-8, np.full(len(taken), 1e-8), np.full((len(taken), FACTORS), 1e-8)]
    at = np.searchsorted(row, np.arange(len(lists) + 1))
    for _ in range(epochs):
        order = rng.permutation(len(lists))
        for k in range(0, len(order), 256):
            some = order[k : k + 256]
            mine = np.concatenate([np.arange(at[i], at[i + 1]) for i in some]) if len(some) else np.zeros(0, int)
            r = np.repeat(np.arange(len(some)), at[some + 1] - at[some])
            t = term[mine]
            error = (sigmoid(machine.margin(t, r, len(some))) - label[some]) * worth[some] / len(some)
            step = error.sum()
            sums[0] += step * step
            machine.bias -= rate * step / np.sqrt(sums[0])
            grad = np.bincount(t, error[r], len(taken)) + shrink * machine.weight
            sums[1] += grad * grad
            machine.weight -= rate * grad / np.sqrt(sums[1])
            for f in range(FACTORS):
                v = machine.factor[t, f]
                pooled = np.bincount(r, v, len(some))
                grad = np.bincount(t, error[r] * (pooled[r] - v), len(taken)) + shrink * machine.factor[:, f]
                sums[2][:, f] += grad * grad
                machine.factor[:, f] -= 0.1 * rate * grad / np.sqrt(sums[2][:, f])
    return machine


def fit(docs: DataFrame, labels: DataFrame, fold: Column, label: str = "toxic") -> Machine:
    """Learns `label` from the rows of `fold` (a condition on doc_id)."""
    chosen, counts = labelled.sample(labels, label, fold, {1: POSITIVES, 0: NEGATIVES})
    sets, y = labelled.gathered(docs, chosen, _sets, POSITIVES + NEGATIVES)
    return fit_machine(sets, y, counts)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """`docs` with the score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # 2**BITS places and the parameters: bounded
    return labelled.scored(docs, lambda raw, offsets: held.value.score(raw, offsets))
