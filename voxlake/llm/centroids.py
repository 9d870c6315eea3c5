"""Centroid clustering in exact integers, screened by float32 products with rigorous error intervals.

Components become integers, floor(scale * x). In a block of vectors one float32 matrix product gives all inner products
with the centroids. Whatever the order of its additions, and fused or not, its error is at most (n + 4) * 2**-24 * 1.01
times |x| |c| (n components; rounding both factors to float32 included), so every squared distance less |x|**2 lies in a
known interval. Centroids whose interval starts behind the least end of any can't be nearest; where more than one is
left, the distances to those are computed anew in integers, and the smallest number among equals wins. Sums are exact
integers too: a task adds up its own vectors and sends base 2**32 digits, which Spark adds up by cluster and component.
What reaches the driver is the centroids, k times width numbers.

Vectors that are null, of another width, or hold null or non-finite components take no part. A null id is an id that
can't start a centroid; if there is no other, cluster, distance and sums are null. Rows of one id are vectors of their own, ordered by
their components where both start centroids. Fewer vectors than k start fewer centroids. Components of any finite size
are exact: vectors with integers beyond 2**27 are computed one by one in Python's integers; distances and sums beyond a
long are null. An empty table gives no rows. Only the id and the vector are read of other columns.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import in_small_batches, written

CENTROIDS, WIDTH, SCALE, ROUNDS = 16, 64, 64, 3
#: Integers up to this size are int32, and 64 squares of their differences fit an int64.
NARROW = 1 << 27
#: Centroids with a component beyond this are not screened by float32, whose products could overflow.
SCREENED = 1 << 80
_LONG = 2**63 - 1
_DIGIT = 32


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x)


def integers(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """id, q (int32 little-endian) or, where those don't hold it, far (decimal integers joined by commas) of the vectors that take part."""
    got = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.size("v") == width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls are NaN
            keep = np.flatnonzero(np.isfinite(x).all(axis=1))
            x = x[keep]
            near = (np.abs(x) <= NARROW / scale - 1).all(axis=1)
            q = np.floor(scale * np.where(near[:, None], x, 0)).astype("<i4")
            narrow = [r.tobytes() if n else None for r, n in zip(q, near.tolist(), strict=True)]
            far = [None if n else ",".join(str(whole(a, scale)) for a in r.tolist()) for r, n in zip(x, near.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(narrow, pa.binary()), pa.array(far, pa.string())], names=["id", "q", "far"])

    return in_small_batches(got).mapInArrow(run, "id bigint, q binary, far string")


@dataclass
class Centroids:
    """Centroids as integers of any size, and what screening needs of them."""

    values: list[list[int]]
    factors: np.ndarray = field(init=False)
    squares: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)
    huge: np.ndarray = field(init=False)
    narrow: np.ndarray | None = field(init=False)

    def __post_init__(self) -> None:
        self.huge = np.array([max(map(abs, c), default=0) > SCREENED for c in self.values])
        small = [[0] * len(c) if h else c for c, h in zip(self.values, self.huge, strict=True)]
        self.factors = np.array([list(map(float, c)) for c in small], np.float64).astype(np.float32)
        self.squares = np.array([float(sum(x * x for x in c)) for c in small])
        self.norms = np.sqrt(self.squares) * (1 + 2.0**-50)
        fits = all(max(map(abs, c), default=0) <= NARROW for c in self.values)
        self.narrow = np.array(self.values, np.int64) if fits else None

    def shortlist(self, q: np.ndarray) -> np.ndarray:
        """Which centroids can be nearest to each vector of int32 components."""
        wide = q.astype(np.int64)
        norm = np.sqrt((wide * wide).sum(axis=1).astype(np.float64)) * (1 + 2.0**-50)
        both = norm[:, None] * self.norms[None, :]
        error = (q.shape[1] + 4) * 2.0**-24 * 1.01
        middle = self.squares[None, :] - 2 * (q.astype(np.float32) @ self.factors.T).astype(np.float64)
        radius = 2 * error * (1 + 2.0**-40) * both + 2.0**-50 * (self.squares[None, :] + 2 * both)
        low, high = middle - radius, middle + radius
        low[:, self.huge], high[:, self.huge] = 2.0**150, np.inf
        return low <= high.min(axis=1)[:, None]

    def exact(self, vector: list[int], number: int) -> int:
        return sum((x - c) * (x - c) for x, c in zip(vector, self.values[number], strict=True))

    def nearest(self, q: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector of int32 components."""
        able = self.shortlist(q)
        out = able.argmax(axis=1)
        several = np.flatnonzero(able.sum(axis=1) > 1)
        if len(several) and self.narrow is not None:
            row, number = np.nonzero(able[several])
            apart = q[several[row]].astype(np.int64) - self.narrow[number]
            distance = np.full((len(several), len(self.values)), _LONG, np.int64)
            distance[row, number] = (apart * apart).sum(axis=1)
            out[several] = distance.argmin(axis=1)
        else:
            for r in several.tolist():
                out[r] = min(np.flatnonzero(able[r]).tolist(), key=lambda c, v=q[r].tolist(): (self.exact(v, c), c))
        return out

    def distances(self, q: np.ndarray, number: np.ndarray) -> list[int]:
        if self.narrow is not None:
            apart = q.astype(np.int64) - self.narrow[number]
            return (apart * apart).sum(axis=1).tolist()
        return [self.exact(v, c) for v, c in zip(q.tolist(), number.tolist(), strict=True)]

    def nearest_far(self, vector: list[int]) -> int:
        return min(range(len(self.values)), key=lambda c: (self.exact(vector, c), c))


def _parts(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """(rows, components) of the int32 vectors of a batch, and the same of the others."""
    near = np.flatnonzero(np.asarray(batch.column(1).is_valid()))
    far = np.flatnonzero(np.asarray(batch.column(1).is_null()))
    q = np.frombuffer(b"".join(batch.column(1).take(pa.array(near)).to_pylist()), "<i4").reshape(-1, width)
    return near, q, far, [list(map(int, s.split(","))) for s in batch.column(2).take(pa.array(far)).to_pylist()]


def _digits(total: int) -> list[int]:
    """total as the sum of digit i times 2**(32 i); the last one has its sign."""
    out = []
    while not -(2**62) < total < 2**62:
        out.append(total & (2**_DIGIT - 1))
        total >>= _DIGIT
    return [*out, total]


def moved(vectors: DataFrame, centroids: Centroids, width: int = WIDTH) -> Centroids:
    """Every centroid with vectors replaced by floor(sum / count) of each component, exactly."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(held.value.values)
        sums, counts = [[0] * width for _ in range(k)], [0] * k
        for batch in batches:
            _, q, _, far = _parts(batch, width)
            number = held.value.nearest(q)
            for c in np.unique(number).tolist():
                mine = q[number == c]
                counts[c] += len(mine)
                sums[c] = [a + b for a, b in zip(sums[c], mine.sum(axis=0, dtype=np.int64).tolist(), strict=True)]
            for vector in far:
                c = held.value.nearest_far(vector)
                counts[c] += 1
                sums[c] = [a + b for a, b in zip(sums[c], vector, strict=True)]
        out = [(c, i, d, v) for c in range(k) if counts[c] for i, total in enumerate([*sums[c], counts[c]]) for d, v in enumerate(_digits(total)) if v]
        cols = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38)), strict=True)], names=["cluster", "component", "digit", "value"])

    digits = vectors.mapInArrow(run, "cluster int, component int, digit int, value decimal(38,0)")
    totals: dict[tuple[int, int], int] = {}
    for r in digits.groupBy("cluster", "component", "digit").agg(F.sum("value").alias("value")).collect():  # bounded by centroids times components
        at = r["cluster"], r["component"]
        totals[at] = totals.get(at, 0) + (int(r["value"]) << _DIGIT * r["digit"])
    return Centroids([[totals.get((c, i), 0) // n for i in range(width)] if (n := totals.get((c, width), 0)) else old for c, old in enumerate(centroids.values)])


def starts(vectors: DataFrame, k: int = CENTROIDS, salt: str = "1:") -> Centroids:
    """The k vectors with the smallest sha256 of salt and id."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.where("id is not null").orderBy(order, F.col("far").asc_nulls_first(), "q").limit(k).collect()
    return Centroids([list(map(int, r["far"].split(","))) if r["far"] is not None else np.frombuffer(bytes(r["q"]), "<i4").tolist() for r in first])


def assigned(vectors: DataFrame, centroids: Centroids, width: int = WIDTH) -> DataFrame:
    """id, cluster and squared distance of every vector."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, q, far_rows, far = _parts(batch, width)
            cluster, distance = np.zeros(batch.num_rows, np.int32), [0] * batch.num_rows
            cluster[near] = number = held.value.nearest(q)
            for r, d in zip(near.tolist(), held.value.distances(q, number), strict=True):
                distance[r] = d
            for r, vector in zip(far_rows.tolist(), far, strict=True):
                cluster[r] = c = held.value.nearest_far(vector)
                distance[r] = held.value.exact(vector, c)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array([d if d <= _LONG else None for d in distance], pa.int64())], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(run, "id bigint, cluster int, distance bigint")


def clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, width: int = WIDTH, scale: int = SCALE, rounds: int = ROUNDS, salt: str = "1:") -> DataFrame:
    """`key`, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part, after `rounds` moves of the centroids."""
    spark = rows.sparkSession
    vectors = written(integers(rows, key, vector, width, scale), "integers")
    centroids = starts(vectors, k, salt)
    if not centroids.values:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string"))]
        return vectors.select(F.col("id").alias(key), *none)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, width)
    last = written(assigned(vectors, centroids, width), "assigned")
    sums = {r["cluster"]: int(r["total"]) if r["fits"] else None for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), (F.count("distance") == F.count("*")).alias("fits")).collect()}  # k rows
    inertia = None if None in sums.values() else sum(sums.values())
    shas = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids.values]
    per_cluster = [(c, *(None if n is None or n > _LONG else n for n in (total, inertia)), shas[c]) for c, total in sums.items()]
    named = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return last.join(F.broadcast(named), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
