"""Distances to the solid and local thickness of runs of any size: no task holds a run.

A run is a table slab(run_id, z, mask): one bit-packed slice a row; slices that aren't there are solid. x and y wrap
where `periodic` says so, z never.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.tables import written

#: Cells of a column of tiles, and voxels a side of a block.
CELLS, BLOCK = 1 << 21, 32
_FAR = np.int64(1 << 60)


def squared_distances(slabs: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool] = (True, True), cells: int = CELLS) -> DataFrame:
    """run_id, x, y, z and d2 of every pore voxel: the squared distance in voxels to the nearest solid one, null if there is none.

    The transform is separable. A slice is done along y and x where it is read; its tiles then meet those of the other
    slices, column by column (the one shuffle), and are done along z, no farther than anything can still come nearer.
    """
    nx, ny, nz = shape
    kind = dict(slabs.dtypes)["run_id"]
    side = max(1, int((cells / nz) ** 0.5))

    def flat(frames):
        for frame in frames:
            out = []
            for run, z, raw in zip(frame["run_id"], frame["z"], frame["mask"], strict=True):
                mask = np.unpackbits(np.frombuffer(raw, np.uint8))[: nx * ny].reshape(ny, nx).astype(bool)
                found = K.squared_distances(mask, (periodic[1], periodic[0]))
                near = np.where(np.isfinite(found), found, -1).astype("<i8")
                out += [(run, int(z), ty, tx, near[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side].tobytes()) for ty in range(-(-ny // side)) for tx in range(-(-nx // side))]
            yield pd.DataFrame(out, columns=["run_id", "z", "ty", "tx", "near"])

    def upwards(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        run, ty, tx = key
        wide, high = min(side, nx - tx * side), min(side, ny - ty * side)
        first = np.zeros((nz, high * wide), np.int64)
        for z, raw in zip(frame["z"], frame["near"], strict=True):
            first[int(z)] = np.frombuffer(raw, "<i8")
        first[first < 0] = _FAR
        best = first.copy()
        for dz in range(1, nz):
            if dz * dz >= best.max(initial=0):
                break
            np.minimum(best[dz:], first[:-dz] + dz * dz, out=best[dz:])
            np.minimum(best[:-dz], first[dz:] + dz * dz, out=best[:-dz])
        z, at = np.nonzero(first > 0)
        d2 = best[z, at]
        values = pd.array(d2, dtype="Int64")
        values[d2 >= _FAR] = pd.NA
        return pd.DataFrame({"run_id": run, "x": tx * side + at % wide, "y": ty * side + at // wide, "z": z, "d2": values})

    tiles = slabs.select("run_id", "z", "mask").mapInPandas(flat, f"run_id {kind}, z int, ty int, tx int, near binary")
    return tiles.groupBy("run_id", "ty", "tx").applyInPandas(upwards, f"run_id {kind}, x int, y int, z int, d2 bigint")


def _met(axis: str, n: int, wraps: bool, reach: Column, block: int) -> Column:
    """(block, at) of every block along an axis that comes within reach of a voxel, and the voxel's place as seen from there, around the border if that wraps."""
    turns = F.sequence(F.lit(-1) - F.floor(reach / n), F.lit(1) + F.floor(reach / n)) if wraps else F.array(F.lit(0).cast("bigint"))

    def blocks(turn: Column) -> Column:
        at = F.col(axis) + turn * n
        low, high = F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(n - 1))
        some = F.transform(F.sequence(F.floor(low / block), F.floor(high / block)), lambda b: F.struct(b.cast("int").alias("block"), at.cast("int").alias("at")))
        return F.when(low <= high, some).otherwise(F.array().cast("array<struct<block:int,at:int>>"))

    return F.flatten(F.transform(turns, blocks))


def _dealt(voxels: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool], reach: Column, block: int) -> DataFrame:
    """Every voxel once for each block within reach, with its place as seen from there in ax, ay, az."""
    out = voxels.withColumn("_reach", reach.cast("bigint"))
    for c, n, wraps in zip("xyz", shape, (*periodic, False), strict=True):
        out = out.withColumn("_m", F.explode(_met(c, n, wraps, F.col("_reach"), block))).withColumn(f"b{c}", F.col("_m.block")).withColumn(f"a{c}", F.col("_m.at")).drop("_m")
    return out.drop("_reach")


_AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]


def largest_balls(distances: DataFrame, shape: tuple[int, int, int], periodic: tuple[bool, bool] = (True, True), block: int = BLOCK) -> DataFrame:
    """The rows of squared_distances whose ball lies in none of the balls about the 26 voxels around: they cover all that all balls cover.

    A ball of radius b lies in one of radius a at distance s if a >= b + s, which in squares is decided in whole numbers.
    """
    kind = dict(distances.dtypes)["run_id"]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((block + 2,) * 3, np.int64)
        at = [frame[f"a{c}"].to_numpy() - key[1 + i] * block + 1 for i, c in enumerate("xyz")]
        grid[tuple(at)] = frame["d2"].to_numpy()
        own = np.ones(len(frame), bool)
        for i, c in enumerate("xyz"):
            own &= (frame[f"a{c}"] == frame[c]).to_numpy() & (at[i] >= 1) & (at[i] <= block)
        inside = tuple(a[own] for a in at)
        mine = grid[inside]
        kept = np.ones(len(mine), bool)
        for step in _AROUND:
            s = sum(d * d for d in step)
            more = grid[tuple(a + d for a, d in zip(inside, step, strict=True))] - mine - s
            kept &= ~((more >= 0) & (more * more >= 4 * s * mine))
        return frame.loc[own, ["run_id", "x", "y", "z", "d2"]][kept]

    return _dealt(distances.where("d2 is not null"), shape, periodic, F.lit(1), block).groupBy("run_id", "bx", "by", "bz").applyInPandas(run, f"run_id {kind}, x int, y int, z int, d2 bigint")


def local_thickness(slabs: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0, periodic: tuple[bool, bool] = (True, True), block: int = BLOCK) -> DataFrame:
    """run_id, x, y, z and diameter of every pore voxel: of the largest ball that fits into the pores and covers it, 0 if the run has no solid.

    The largest balls are dealt to the blocks they meet, where they are painted, the largest first: a join by the
    cells of a radius that keeps the maximum.
    """
    kind = dict(slabs.dtypes)["run_id"]
    found = written(squared_distances(slabs, shape, periodic), "distances")
    balls = _dealt(largest_balls(found, shape, periodic, block), shape, periodic, F.ceil(F.sqrt("d2")) - 1, block)
    own = found.select("run_id", "x", "y", "z", *[F.floor(F.col(c) / block).cast("int").alias(f"b{c}") for c in "xyz"])

    def painted(key: tuple, cells: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        best = np.zeros((block,) * 3, np.int64)
        met = met.sort_values("d2", ascending=False)
        span = np.arange(block)
        origin = [b * block for b in key[1:]]
        for r2, *at in met[["d2", "ax", "ay", "az"]].itertuples(index=False):
            reach = int(np.ceil(np.sqrt(r2)))
            low = [max(0, a - o - reach) for a, o in zip(at, origin, strict=True)]
            high = [min(block, a - o + reach + 1) for a, o in zip(at, origin, strict=True)]
            part = best[low[0] : high[0], low[1] : high[1], low[2] : high[2]]
            x, y, z = ((span[a:b] + o - c) ** 2 for a, b, o, c in zip(low, high, origin, at, strict=True))
            covered = x[:, None, None] + y[None, :, None] + z[None, None, :] < r2
            np.maximum(part, np.where(covered, r2, 0), out=part)
        r2 = best[tuple(cells[c].to_numpy() - o for c, o in zip("xyz", origin, strict=True))]
        return cells[["run_id", "x", "y", "z"]].assign(diameter=2 * np.sqrt(r2) * spacing)

    keys = ["run_id", "bx", "by", "bz"]
    return own.groupBy(*keys).cogroup(balls.select(*keys, "d2", "ax", "ay", "az").groupBy(*keys)).applyInPandas(painted, f"run_id {kind}, x int, y int, z int, diameter double")
