"""Joins by distance in a box that is periodic in x and y."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import squared_distance
from voxlake.tables import dropped, written

#: Broadcast tables of up to this many rows; larger ones meet in cells.
BROADCAST_ROWS = 4096

#: Places in a pack of pair_histogram.
PACK = 8192


def _cells(box: tuple[float, float], radius: float) -> tuple[int, int]:
    """Cells per periodic axis, none narrower than the radius."""
    return tuple(max(1, int(side // radius)) for side in box)


def _with_cell(points: DataFrame, box: tuple[float, float], radius: float, solid: bool) -> DataFrame:
    nx, ny = _cells(box, radius)
    cell = lambda c, side, n: F.least(F.floor(F.pmod(F.col(c), F.lit(side)) / (side / n)).cast("int"), F.lit(n - 1))
    out = points.withColumn("_cx", cell("x", box[0], nx)).withColumn("_cy", cell("y", box[1], ny))
    return out.withColumn("_cz", F.floor(F.col("z") / radius).cast("int")) if solid else out


def _around(points: DataFrame, box: tuple[float, float], radius: float, solid: bool) -> DataFrame:
    """Each point once for every different cell next to its own."""
    nx, ny = _cells(box, radius)
    near = lambda c, n: F.array_distinct(F.array(*[F.pmod(F.col(c) + d, F.lit(n)) for d in (-1, 0, 1)]))
    out = points.withColumn("_cx", F.explode(near("_cx", nx))).withColumn("_cy", F.explode(near("_cy", ny)))
    return out.withColumn("_cz", F.explode(F.array(*[F.col("_cz") + d for d in (-1, 0, 1)]))) if solid else out


def spacing(box: tuple[float, float], n: int) -> float:
    """The side of a square that holds one of n points spread over the box."""
    return math.sqrt(box[0] * box[1] / max(n, 1))


def pairs_within(points: DataFrame, radius: float, box: tuple[float, float], by: str | None = None) -> DataFrame:
    """(a, b, distance) of all pairs a < b no farther apart than `radius`; points: id, x, y, z if there is one, and `by`, which both must share.

    Cells as wide as the radius: each two of the 9 or 27 cells around a point meet once, by an equi-join, never all others.
    """
    solid = "z" in points.columns
    axes, cells = ["x", "y", *("z" * solid)], ["_cx", "_cy", *(["_cz"] if solid else [])]
    keys, spark = [*cells, *([by] if by else [])], points.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    own = _with_cell(points, box, radius, solid)
    home, there = F.struct(*[f"_h{c}" for c in cells]), F.struct(*cells)
    dealt = _around(own.withColumns({f"_h{c}": F.col(c) for c in cells}), box, radius, solid).where(there >= home)
    left = dealt.select(*keys, (there == home).alias("_own"), F.col("id").alias("_a"), *[F.col(c).alias(f"_{c}") for c in axes])
    right = own.select(*keys, F.col("id").alias("_b"), *axes)
    d2 = squared_distance(tuple(f"_{c}" for c in axes), tuple(axes), box)
    met = left.repartition(parts, *keys).join(right, keys)  # few rows go in, many come out: tasks by number, not by size
    met = met.where((F.col("_a") < F.col("_b")) | (~F.col("_own") & (F.col("_a") > F.col("_b")))).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius)
    first = F.col("_a") < F.col("_b")
    return met.select(*([by] if by else []), F.when(first, F.col("_a")).otherwise(F.col("_b")).alias("a"), F.when(first, F.col("_b")).otherwise(F.col("_a")).alias("b"), "distance")


def joined_within(left: DataFrame, right: DataFrame, radius: float, box: tuple[float, float], by: list[str] | None = None) -> DataFrame:
    """(by, a, b, distance) of a left and a right point within `radius`, of equal `by`: collision tests, points near centres."""
    by = by or []
    solid = "z" in left.columns and "z" in right.columns
    keys = ["_cx", "_cy", *(["_cz"] if solid else []), *by]
    axes = ("x", "y", *("z" * solid))
    many = _around(_with_cell(left, box, radius, solid), box, radius, solid).select(*keys, F.col("id").alias("a"), *[F.col(c).alias(f"_{c}") for c in axes])
    few = _with_cell(right, box, radius, solid).select(*keys, F.col("id").alias("b"), *axes)
    d2 = squared_distance(tuple(f"_{c}" for c in axes), axes, box)
    return many.join(few, keys).withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius).select(*by, "a", "b", "distance")


def pair_histogram(points: DataFrame, width: float, bins: int, box: tuple[float, float], by: str | list[str] | None = None) -> DataFrame:
    """by, bin and n: the pairs of points of equal `by`, counted by distance in bins as in `histogram`. Points: x, y, z if there is one, and id if there is one, which two points of a pair don't share.

    Pairs aren't made as rows. Points of one place become one with a weight; places are dealt to cells, and a cell's to packs
    of about PACK by hash; each two packs of cells near enough meet once, in arrays. Rows without a finite place, `by` or id count nowhere.
    """
    spark, reach = points.sparkSession, width * bins
    axes, keys = ["x", "y", *("z" * ("z" in points.columns))], [by] if isinstance(by, str) else by or []
    sound = sum((F.abs(F.col(c)) for c in axes[1:]), F.abs(F.col("x"))) < float("inf")
    for key in [*keys, *(["id"] if "id" in points.columns else [])]:
        sound = sound & F.col(key).isNotNull()
    points = points.where(sound)
    spots = points.groupBy(*keys, *axes).agg(F.count("*").alias("_w"))
    spots = written(spots.select(*keys, *[F.col(c).cast("double").alias(c) for c in axes], F.col("_w").cast("double").alias("_w")), "places")
    cells = _with_cell(spots, box, reach, len(axes) == 3)
    home = ["_cx", "_cy", *(["_cz"] if len(axes) == 3 else [])]
    sizes = cells.groupBy(*keys, *home).agg(F.count("*").alias("_n")).withColumn("_packs", F.ceil(F.col("_n") / PACK))
    held = cells.join(sizes, [*home, *keys])
    pack = F.pmod(F.xxhash64(*axes), F.col("_packs")).alias("_p")
    packed = written(held.select(*keys, *home, pack, *axes, "_w").groupBy(*keys, *home, "_p").agg(*[F.collect_list(F.struct(*axes, "_w")).alias("_at")]), "packs")
    packed = packed.withColumn("_pack", F.struct(*home, "_p"))
    # which packs meet: keys only, then their points are joined to them
    near = _around(packed.select(*keys, *home, F.col("_pack").alias("_a")), box, reach, len(axes) == 3)
    met = near.join(packed.select(*keys, *home, F.col("_pack").alias("_b")), [*home, *keys]).where(F.col("_a") <= F.col("_b")).select(*keys, "_a", "_b")
    left, right = (packed.select(*keys, F.col("_pack").alias(end), F.col("_at").alias(f"_at{end}")) for end in ("_a", "_b"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    both = met.join(left, [*keys, "_a"]).join(right, [*keys, "_b"]).repartition(parts, *keys, "_a", "_b")
    kinds = dict(points.dtypes)

    def counted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                a, b = (_array(row.column(end), axes) for end in ("_at_a", "_at_b"))
                n = _pair_counts(a, b, row.column("_a")[0].as_py() == row.column("_b")[0].as_py(), width, bins, box)
                out = {"bin": pa.array(range(bins), pa.int32()), "n": pa.array(n, pa.int64())}
                yield pa.RecordBatch.from_pydict({k: pa.array([row.column(k)[0].as_py()] * bins, row.column(k).type) for k in keys} | out)

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "bin int, n bigint"
    counts = both.select(*keys, "_a", "_b", "_at_a", "_at_b").mapInArrow(counted, schema)
    if "id" in points.columns:
        counts = counts.unionByName(_within_ids(points, axes, keys, width, bins, box).withColumn("n", -F.col("n")))
    return counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n")).where("n > 0")


def _within_ids(points: DataFrame, axes: list[str], keys: list[str], width: float, bins: int, box: tuple[float, float]) -> DataFrame:
    """keys, bin and n: the pairs of points that share an id. Those of one place are counted by id, the others as pair_histogram does, by id."""
    at = F.struct(*axes)
    ids = written(points.groupBy(*keys, "id").agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high")).where("_n > 1"), "ids")
    out = ids.where("_low = _high").groupBy(*keys).agg(F.expr("cast(coalesce(sum(_n * (_n - 1) / 2), 0) as bigint)").alias("n")).select(*keys, F.lit(0).alias("bin"), "n")
    apart = ids.where("_low <> _high").select(*keys, "id")
    if not apart.limit(1).count():
        return out
    some = points.join(apart, [*keys, "id"], "left_semi").withColumnRenamed("id", "_id")
    return out.unionByName(pair_histogram(some, width, bins, box, [*keys, "_id"]).select(*keys, "bin", "n"))


def _array(column: pa.Array, axes: list[str]) -> np.ndarray:
    flat = column.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in [*axes, "_w"]])


def _blocks(a: np.ndarray, size: int) -> list[np.ndarray]:
    """Points (coordinates and weight by row) split at medians of their widest side until a part fits the processor's cache."""
    if a.shape[1] <= size:
        return [a]
    axis = int(np.argmax(np.ptp(a[:-1], axis=1)))
    a, half = a[:, np.argsort(a[axis], kind="stable")], a.shape[1] // 2
    return _blocks(a[:, :half], size) + _blocks(a[:, half:], size)


def _by_weight(a: np.ndarray) -> list[np.ndarray]:
    """Blocks of places of one weight, for every weight that enough places have; the others in smaller ones together."""
    weights, n = np.unique(a[-1], return_counts=True)
    common = weights[n >= min(96, a.shape[1])]
    rest = a[:, ~np.isin(a[-1], common)]
    blocks = [b for w in common for b in _blocks(a[:, a[-1] == w], 384)]
    return blocks + _blocks(rest, 192) if rest.shape[1] else blocks


def _pair_counts(a: np.ndarray, b: np.ndarray, same: bool, width: float, bins: int, box: tuple[float, float]) -> np.ndarray:
    """Weighted pairs by distance between two packs, or within one: blocks whose distances all lie in one bin, or beyond the last, by product, the others by _edge_counts or, where weights differ within a block, one by one in the order of `squared_distance`."""
    out, top = np.zeros(bins, np.int64), width * bins
    parts = _by_weight(a)
    others = parts if same else _by_weight(b)
    low, high = (np.array([f(o[:-1], axis=1) for o in others]) for f in (np.min, np.max))
    weights = np.array([o[-1].sum() for o in others])
    even = [[bool((q[-1] == q[-1, 0]).all()) for q in side] for side in (parts, others)]
    sharp = width**2 > 2.0**-14 * sum((np.abs(q[:-1]).max() + side) ** 2 for q in (a, b) for side in box)  # bins wider than _edge_counts' errors
    for i, p in enumerate(parts):
        start = i if same else 0
        middle = (p[:-1].min(axis=1) + p[:-1].max(axis=1)) / 2 - (low[start:] + high[start:]) / 2
        slack = (np.ptp(p[:-1], axis=1) + high[start:] - low[start:]) / 2
        for k, side in enumerate(box):
            middle[:, k] -= side * np.rint(middle[:, k] / side)
        middle = np.abs(middle)
        most = middle + slack
        least = np.maximum(middle - slack, 0)
        for k, side in enumerate(box):  # the nearer image of some may be another one
            least[:, k] = np.minimum(least[:, k], np.maximum(side - most[:, k], 0))
            most[:, k] = np.minimum(most[:, k], side / 2)
        least, most = np.sqrt((least**2).sum(1)) * (1 - 1e-9) - 1e-9, np.sqrt((most**2).sum(1)) * (1 + 1e-9) + 1e-9
        first, last = np.floor(np.maximum(least, 0) / width), np.floor(most / width)
        for j in np.flatnonzero(least <= top):
            o, own = others[start + j], same and j == 0
            if first[j] == last[j] < bins and not own:
                out[int(first[j])] += int(p[-1].sum() * weights[start + j])
                continue
            if even[0][i] and even[1][start + j] and not own and sharp:
                turns = [range(int(np.rint((p[k].min() - high[start + j, k]) / side)), int(np.rint((p[k].max() - low[start + j, k]) / side)) + 1) for k, side in enumerate(box)]
                out += int(p[-1, 0] * o[-1, 0]) * _edge_counts(p[:-1], o[:-1], turns, int(first[j]), int(last[j]), width, bins, box)
                continue
            d = p[0][:, None] - o[0]
            d -= box[0] * np.rint(d / box[0])
            d2 = d * d
            d = p[1][:, None] - o[1]
            d -= box[1] * np.rint(d / box[1])
            d2 += d * d
            if len(p) == 4:
                d = p[2][:, None] - o[2]
                d2 += d * d
            np.sqrt(d2, out=d2)
            at = np.minimum(np.floor(d2 / width), bins + 1).astype(np.int64)
            at[d2 == top] = bins - 1
            at[d2 > top] = bins
            w = p[-1][:, None] * o[-1]
            plain = w.size == w.sum() and w.min() == 1
            n = np.bincount(at.ravel(), None if plain else w.ravel(), bins + 2)[:bins].astype(np.int64)
            if own:  # both orders of each pair of places, and each place with itself
                n[0] -= int((p[-1] ** 2).sum())
                n //= 2
                n[0] += int((p[-1] * (p[-1] - 1) / 2).sum())
            out += n
    return out


def _edge_counts(p: np.ndarray, o: np.ndarray, turns: list[range], first: int, last: int, width: float, bins: int, box: tuple[float, float]) -> np.ndarray:
    """Pairs of two blocks of places by bin, each place counted once; all lie in bins first to last, at one of the periodic images in `turns`.

    Squared distances are float32 products about the blocks' middle, the least of the images'; pairs nearer to a bin's edge
    than their error bound are measured again in the order of `squared_distance`, so that counts are exact.
    """
    d2, error = None, 0.0
    for x in turns[0]:
        for y in turns[1]:
            moved = p - np.array([x * box[0], y * box[1], 0.0])[: len(p), None]
            middle = (moved[:, :1] + o[:, :1]) / 2
            a, b = (moved - middle).astype(np.float32), (o - middle).astype(np.float32)
            left, right = np.ones((len(p) + 2, a.shape[1]), np.float32), np.ones((len(p) + 2, b.shape[1]), np.float32)
            left[: len(p)], right[: len(p)] = a, -2 * b
            left[-2], right[-1] = np.einsum("ij,ij->j", a, a), np.einsum("ij,ij->j", b, b)
            # over twice the bound of rounding coordinates, squares, products and edges
            error = max(error, 2.0**-19 * (math.sqrt(left[-2].max()) + math.sqrt(right[-1].max())) ** 2)
            image = left.T @ right
            d2 = image if d2 is None else np.minimum(d2, image, out=d2)
    out, at, near = np.zeros(bins + 1, np.int64), 0, None
    for k in range(first + 1, min(last, bins) + 1):
        under, over = d2 < np.float32((k * width) ** 2 - error), d2 <= np.float32((k * width) ** 2 + error)
        n = np.count_nonzero(over)
        out[k - 1] = np.count_nonzero(under) - at
        near, at = np.logical_xor(under, over, out=under) if near is None else np.logical_or(near, np.logical_xor(under, over, out=under), out=near), n
    if last < bins:
        out[last] = d2.size - at
    i, j = np.divmod(np.flatnonzero(near), d2.shape[1]) if near is not None else (np.zeros(0, int),) * 2
    if len(i):
        d = p[:, i] - o[:, j]
        for c, side in enumerate(box):
            d[c] -= side * np.rint(d[c] / side)
        r = d[0] * d[0] + d[1] * d[1]
        if len(d) == 3:
            r += d[2] * d[2]
        r = np.sqrt(r)
        exact = np.where(r == width * bins, bins - 1, np.where(r > width * bins, bins, np.minimum(np.floor(r / width), bins))).astype(np.int64)
        out += np.bincount(exact, minlength=bins + 1)
    return out[:bins]


def histogram(values: DataFrame, column: str, width: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """bin and n over equal bins from 0: half-open, the last one closed, what lies outside left out."""
    value = F.col(column)
    top = width * bins
    at = F.when(value == top, F.lit(bins - 1)).otherwise(F.floor(value / width)).cast("int")
    inside = values.where((value >= 0) & (value <= top)).withColumn("bin", at)
    return inside.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"))


def nearest_center(points: DataFrame, centers: DataFrame, box: tuple[float, float], radius: float) -> DataFrame:
    """points with center and distance of their nearest centre in the plane, the smaller id on a tie.

    Points and centres meet in cells of `radius`, or narrower ones if that leaves about one centre in each; points that find
    none so near are tried again with twice the radius, until the cells are the box. Of centres in one place the smallest id
    is tried. The table is written, so that what uses it twice doesn't search twice.
    """
    left, found = points.select("id", "x", "y"), None
    centers = written(centers.groupBy("x", "y").agg(F.min("id").alias("id")), "centres")
    radius = min(radius, spacing(box, centers.count()))
    while True:
        met = joined_within(left, centers, radius, box)
        near = met.groupBy(F.col("a").alias("id")).agg(F.min(F.struct("distance", F.col("b").alias("center"))).alias("m")).select("id", "m.center", "m.distance")
        near = written(near, "nearest")
        found = near if found is None else found.unionByName(near)
        if radius >= math.hypot(*box):
            return points.join(found, "id")
        left = written(left.join(near, "id", "left_anti"), "unmet")
        if not left.limit(1).count():
            dropped(left)
            return points.join(found, "id")
        radius *= 2


def weighted_centroids(rows: DataFrame, by: str, weight: Column, values: list[str]) -> DataFrame:
    """Weighted means of `values` by group; a group without weight has none."""
    total = F.sum(weight)
    return rows.groupBy(by).agg(*[(F.sum(weight * F.col(v)) / F.when(total > 0, total)).alias(v) for v in values])


def normalised_counts(observed: DataFrame, reference: DataFrame, mean_one: bool = False) -> DataFrame:
    """observed / reference by bin, 0 where the reference is 0; mean_one divides by the mean over bins with a reference."""
    ratio = reference.join(observed, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ratio = ratio.withColumn("g", F.when(F.col("reference") > 0, F.col("n") / F.col("reference")).otherwise(F.lit(0.0)))
    if not mean_one:
        return ratio
    mean = ratio.where("reference > 0").agg(F.avg("g").alias("mean"))
    return ratio.crossJoin(F.broadcast(mean)).withColumn("g", F.when(F.col("mean") > 0, F.col("g") / F.col("mean")).otherwise(F.lit(0.0))).drop("mean")  # one row


def curve_loss(curve: DataFrame, value: str, target: str) -> DataFrame:
    """Mean squared error weighted by the target, at least 1e-12; infinite without any pair."""
    w = F.greatest(F.col(target), F.lit(1e-12))
    d = F.col(value) - F.col(target)
    return curve.agg(F.when(F.sum("n") > 0, F.sum(w * d * d) / F.sum(w)).otherwise(F.lit(float("inf"))).alias("loss"))
