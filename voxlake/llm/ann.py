"""Nearest neighbours by largest inner product over shifted space-filling curves.

Each of CURVES orderings projects the vectors onto DIMS random orthonormal directions, shifts them by a random offset
and sorts them along a Hilbert curve; the order is cut at quantiles of a sample into ranges of equal size, SEGMENTS or as
many as keep a range near RANGE_ROWS rows. A query meets all rows of its own range and of `reach` ranges on either side, on every curve, in double precision; the
best of all curves are merged. Inner products become nearness by one more component, which fills every row up to the
largest norm. Rows of equal keys are ordered by a hash of their id, so a range stays of equal size however many rows
agree.

The sample (SAMPLE rows by a hash of the id, 4 a range if those are more, SAMPLE_MOST at most) gives the quantiles, and the reach: the smallest at which the sample's own
neighbours are found to TARGET. That is on the safe side, as neighbours in a sample are farther than in all rows.
Vectors that spread alike in all directions have no near ones to speak of; there the reach is wide and much of the
table is scored. Every row is indexed and every query answered.

Vectors null, zero, of another length than most, or with null or non-finite components take no part, nor do null ids. A
query never finds rows of its own id. Equal scores go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import mix, written
from voxlake.llm.hilbert import hilbert_keys
from voxlake.llm.vectors import matrix, usable

CURVES, DIMS, BITS, SEGMENTS, RANGE_ROWS, SAMPLE, SAMPLE_MOST, TARGET = 12, 6, 10, 64, 50_000, 4096, 65_536, 0.95


class Curves:
    """The orderings: projections, shifts and the quantiles of their keys, fitted on a sample."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, top_norm: float, segments: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS):
        rng = np.random.default_rng(11)
        self.top, self.bits, self.segments = top_norm, bits, segments
        width = sample.shape[1] + 1
        dims = min(dims, width)
        self.bases = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        filled = self.filled(sample)
        self.low, self.scale, self.shift, self.cuts = [], [], [], []
        for basis in self.bases:
            flat = filled @ basis
            low, high = flat.min(axis=0), flat.max(axis=0)
            self.low.append(low)
            self.scale.append(1 / np.maximum(1e-12, (high - low) * 1.5))
            self.shift.append(rng.random(dims) / 3)
        for c in range(curves):
            key, tie = self.keys(c, filled, ids)
            order = np.lexsort((tie, key))
            at = order[(np.arange(1, segments) * len(order)) // segments] if len(order) else order
            self.cuts.append((key[at], tie[at]))

    def filled(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def keys(self, c: int, filled: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (filled @ self.bases[c] - self.low[c]) * self.scale[c] + self.shift[c]
        cells = np.clip(place * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.uint64)
        return hilbert_keys(cells, self.bits), mix(ids.astype(np.uint64)) >> np.uint64(1)

    def segment(self, c: int, filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
        key, tie = self.keys(c, filled, ids)
        cut_key, cut_tie = self.cuts[c]
        low, high = np.searchsorted(cut_key, key, "left"), np.searchsorted(cut_key, key, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(cut_tie[low[i] : high[i]], tie[i], "right")
        return low

    def as_query(self, x: np.ndarray) -> np.ndarray:
        """A query points where its best possible neighbour would lie: along itself, at the largest norm."""
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.column_stack([x * (self.top / norm), np.zeros(len(x))])


def _top(query: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and scores of the k best rows for each query, best first, equal scores by id; scores summed alike for equal vectors."""
    step = max(1, 4_000_000 // max(1, len(rows)))
    for i in range(0, len(query), step):
        rough = query[i : i + step] @ rows.T
        rough[query_ids[i : i + step, None] == ids[None, :]] = -np.inf
        last = -np.partition(-rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        for q, line, least in zip(query[i : i + step], rough, last, strict=True):
            near = np.flatnonzero((line >= least - 1e-9 * max(1.0, abs(least))) & (line > -np.inf)) if least > -np.inf else np.flatnonzero(line > -np.inf)
            found, scores = _first(rows, ids, q, near, k)
            if len(found) < k and len(near) < len(line):  # repeated ids took the places of others
                found, scores = _first(rows, ids, q, np.flatnonzero(line > -np.inf), k)
            yield found, scores


def _first(rows: np.ndarray, ids: np.ndarray, q: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids of the rows `near`, by exact score and id."""
    exact = (rows[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -exact))
    found, scores = ids[near][order], exact[order]
    once = np.sort(np.unique(found, return_index=True)[1])[:k]
    return found[once], scores[once]


def _reach(curves: Curves, sample: np.ndarray, ids: np.ndarray, k: int, target: float) -> int:
    """The fewest ranges to either side at which the sample's own neighbours are found."""
    if len(sample) < 2:
        return curves.segments
    asks = np.arange(0, len(sample), max(1, len(sample) // 256))
    score = sample[asks] @ sample.T
    score[np.arange(len(asks)), asks] = -np.inf
    near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    filled, pointed = curves.filled(sample), curves.as_query(sample[asks])
    least = np.full(near.shape, 1 << 30)
    for c in range(len(curves.bases)):
        rows, query = curves.segment(c, filled, ids), curves.segment(c, pointed, ids[asks])
        least = np.minimum(least, np.abs(rows[near] - query[:, None]))
    return int(np.quantile(least, target, method="higher"))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", segments: int | None = None, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows found for every row of `is_query`."""
    marked = rows.select(F.col(key).cast("bigint").alias("_key"), F.col(vector).alias("_vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    vectors = written(usable(marked, "_key", "_vector", ["asks"]), "vectors")
    widths = vectors.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect()
    found = [_of_width(vectors.where(F.col("width") == r["width"]), r["width"], r["n"], k, segments, target) for r in widths]
    if not found:
        return rows.sparkSession.createDataFrame([], FOUND)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out if len(found) == 1 else _best(out, k)


FOUND = "query_id bigint, rank int, vec_id bigint, score double"


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best of an id that asks with vectors of several widths; a query has at most k rows of each."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_width(vectors: DataFrame, width: int, n: int, k: int, segments: int | None, target: float) -> DataFrame:
    segments = segments or max(SEGMENTS, min(SAMPLE_MOST // 4, -(-n // RANGE_ROWS)))

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max()) if len(batch.column(0)) else 0.0])], names=["squared"])

    top = vectors.select("vec").mapInArrow(norms, "squared double").agg(F.max("squared")).collect()[0][0] or 0.0
    held = vectors.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(min(SAMPLE_MOST, max(SAMPLE, 4 * segments))).collect()
    sample = np.array([np.frombuffer(r["vec"]) for r in held]).reshape(len(held), width)
    sample_ids = np.array([r["id"] for r in held], np.int64)
    curves = Curves(sample, sample_ids, float(np.sqrt(top)), segments)
    reach = _reach(curves, sample, sample_ids, k, target)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(batches, curves, len(curves.bases), reach)

    def dealt_to_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(batches, curves, 1, segments)

    def searched(group: pa.Table) -> pa.Table:
        ids, asks, x = np.array(group.column("id")), np.array(group.column("asks")), matrix(group.column("vec"))
        found = list(_top(x[asks], ids[asks], x[~asks], ids[~asks], k)) if asks.any() and not asks.all() else []
        return pa.table({"query_id": pa.array(ids[asks] if found else [], pa.int64()), "ids": pa.array([a.tobytes() for a, _ in found], pa.binary()), "scores": pa.array([s.tobytes() for _, s in found], pa.binary())})

    def merged(group: pa.Table) -> pa.Table:
        query = group.column("query_id")[0].as_py()
        ids = np.frombuffer(b"".join(group.column("ids").to_pylist()), np.int64)
        scores = np.frombuffer(b"".join(group.column("scores").to_pylist()), np.float64)
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        first = np.sort(np.unique(ids, return_index=True)[1])[:k]
        return pa.table({"query_id": pa.array(np.full(len(first), query), pa.int64()), "rank": pa.array(np.arange(1, len(first) + 1), pa.int32()), "vec_id": pa.array(ids[first], pa.int64()), "score": pa.array(scores[first], pa.float64())})

    def found_by(rows: DataFrame, deal) -> DataFrame:
        met = rows.select("id", "vec", "asks").mapInArrow(deal, "curve int, segment int, id bigint, asks boolean, vec binary")
        return met.groupBy("curve", "segment").applyInArrow(searched, "query_id bigint, ids binary, scores binary").groupBy("query_id").applyInArrow(merged, FOUND)

    best = written(found_by(vectors, dealt), "nearest")
    asked = vectors.where("asks").select(F.col("id").alias("query_id")).distinct()
    full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = written(asked.join(full, "query_id", "left_anti"), "short")
    if not short.limit(1).count():
        return best
    again = vectors.join(short.select(F.col("query_id").alias("id"), F.lit(True).alias("_short")), "id", "left").withColumn("asks", F.col("asks") & F.coalesce("_short", F.lit(False)))
    return best.join(short, "query_id", "left_anti").unionByName(found_by(again, dealt_to_all))


def _dealt(batches: Iterator[pa.RecordBatch], curves: Curves, some: int, reach: int) -> Iterator[pa.RecordBatch]:
    """Rows in their own range, and queries in all ranges within reach, of the first `some` curves."""
    for batch in batches:
        ids, x, asks = batch.column(0).to_numpy(), matrix(batch.column(1)), np.array(batch.column(2))
        if not len(ids):
            continue
        filled, wanted = curves.filled(x), np.flatnonzero(asks)
        pointed = curves.as_query(x[wanted])
        for c in range(some):
            own = curves.segment(c, filled, ids)
            query = curves.segment(c, pointed, ids[wanted])
            span = query[:, None] + np.arange(-reach, reach + 1)[None, :]
            inside = (span >= 0) & (span < curves.segments)
            at = np.concatenate([np.arange(len(ids)), wanted[np.nonzero(inside)[0]]])
            segment = np.concatenate([own, span[inside]])
            asked = np.arange(len(at)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(segment, pa.int32()), pa.array(ids[at], pa.int64()), pa.array(asked), batch.column(1).take(pa.array(at))], names=["curve", "segment", "id", "asks", "vec"])


def nearest_exact(vectors: dict[int, list[float]], queries: list[int], k: int) -> list[tuple[int, int, int, float]]:
    """Brute force over a small table, for tests and for measuring recall."""
    ids = np.array(sorted(vectors), np.int64)
    x = np.array([vectors[i] for i in ids.tolist()], np.float64)
    at = np.searchsorted(ids, queries)
    out = []
    for q, (found, scores) in zip(queries, _top(x[at], np.array(queries), x, ids, k), strict=True):
        out += [(q, r + 1, int(i), float(s)) for r, (i, s) in enumerate(zip(found, scores, strict=True))]
    return out
