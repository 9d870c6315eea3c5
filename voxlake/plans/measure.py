"""Measuring final geometry from voxels: slices, tracks, sections, channels, orientations, pair distances.

A phase is a table slab(run_id, z, mask BINARY): one bit-packed slice a row, so that slices are measured apart and a
run's sections see its slices together. A run is what one task holds; runs are independent.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.functions.geometry import projected_angle
from voxlake.operators import pairs, tracks

#: The measuring contract: spacings, separations and exclusions in angstrom, as the configuration's block has them.
CONTRACT = {
    "z_slice_spacing_A": 1.0, "center_min_separation_A": 1.0, "center_tracking_max_displacement_A": 2.0, "surface_exclusion_length_A": 1.0, "branch_exclusion_length_A": 0.0,
    "cross_section_spacing_A": 1.0, "boundary_resample_spacing_A": 0.5, "curvature_smoothing_length_A": 1.0, "orientation_projection_min_fraction": 0.1,
}


def packed(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """slab(run_id, z, mask) of voxel(run_id, x, y, z, pore); voxels that aren't there are solid."""
    nx, ny, _ = shape

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((ny, nx), bool)
        on = frame["pore"].to_numpy(bool)
        mask[frame["y"].to_numpy()[on], frame["x"].to_numpy()[on]] = True
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "z": [int(frame["z"].iloc[0])], "mask": [np.packbits(mask).tobytes()]})

    kind = dict(voxels.dtypes)["run_id"]
    return voxels.select("run_id", "x", "y", "z", "pore").groupBy("run_id", "z").applyInPandas(run, f"run_id {kind}, z int, mask binary")


def _unpacked(mask: bytes, shape: tuple[int, int, int]) -> np.ndarray:
    nx, ny, _ = shape
    return np.unpackbits(np.frombuffer(mask, np.uint8))[: nx * ny].reshape(ny, nx).astype(bool)


def sampled_slices(slabs: DataFrame, nz: int, spacing: float, wanted: float) -> DataFrame:
    """Every so many slices, and always the last one."""
    stride = max(1, round(wanted / spacing))
    return slabs.where((F.col("z") % stride == 0) | (F.col("z") == nz - 1))


def slice_centers(slabs: DataFrame, shape: tuple[int, int, int], spacing: float, contract: dict = CONTRACT) -> DataFrame:
    """run_id, z_index, z, centers(x, y, wall) of each sampled slice; slices without pores have none. A map over slices, no shuffle."""
    kind = dict(slabs.dtypes)["run_id"]

    def run(frames):
        for frame in frames:
            rows = [[{"x": x, "y": y, "wall": w} for x, y, w in K.slice_centers(_unpacked(m, shape), spacing, contract["center_min_separation_A"])] for m in frame["mask"]]
            yield pd.DataFrame({"run_id": frame["run_id"], "z_index": frame["z"], "z": (frame["z"] + 0.5) * spacing, "centers": rows})

    wanted = sampled_slices(slabs, shape[2], spacing, contract["z_slice_spacing_A"])
    return wanted.mapInPandas(run, f"run_id {kind}, z_index int, z double, centers array<struct<x:double,y:double,wall:double>>")


def track_points(centers: DataFrame, shape: tuple[int, int, int], spacing: float, contract: dict = CONTRACT) -> DataFrame:
    """Points of all tracks of a run, followed slice by slice; a run's slices are folded in order in one task."""
    kind = dict(centers.dtypes)["run_id"]
    box = (shape[0] * spacing, shape[1] * spacing)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("z_index")
        slices = [(int(i), float(z), [(c["x"], c["y"], c["wall"]) for c in cs]) for i, z, cs in zip(frame["z_index"], frame["z"], frame["centers"], strict=True)]
        points, _ = K.linked_tracks(slices, box, contract["center_tracking_max_displacement_A"])
        out = pd.DataFrame(points, columns=["track_id", "z_index", "x", "y", "z", "wrapped_x", "wrapped_y", "wall", "branch"])
        out.insert(0, "run_id", frame["run_id"].iloc[0])
        return out

    return centers.groupBy("run_id").applyInPandas(run, f"run_id {kind}, track_id int, z_index int, x double, y double, z double, wrapped_x double, wrapped_y double, wall double, branch boolean")


def through(points: DataFrame, centers: DataFrame) -> DataFrame:
    """(run_id, track_id) of tracks from the lowest sampled slice to the highest."""
    ends = centers.groupBy("run_id").agg(F.min("z_index").alias("low"), F.max("z_index").alias("high"))
    each = points.groupBy("run_id", "track_id").agg(F.min("z_index").alias("a"), F.max("z_index").alias("b"))
    return each.join(ends, "run_id").where("a = low and b = high").select("run_id", "track_id")


SECTION = "track_id int, arc double, x double, y double, z double, tx double, ty double, tz double, valid boolean, invalid_reason string, area double, diameter double, fluctuation double"


def sections(slabs: DataFrame, points: DataFrame, shape: tuple[int, int, int], spacing: float, contract: dict = CONTRACT) -> DataFrame:
    """Sections across each track at even arc positions off its ends; rows that can't be measured say why."""
    kind = dict(points.dtypes)["run_id"]
    nx, ny, nz = shape

    def run(key: tuple, grid: pd.DataFrame, track: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((nz, ny, nx), bool)
        for z, m in zip(grid["z"], grid["mask"], strict=True):
            mask[int(z)] = _unpacked(m, shape)
        rows = []
        for name, mine in track.sort_values("z_index").groupby("track_id"):
            line = K.smoothed(mine[["x", "y", "z"]].to_numpy())
            if len(line) < 2:
                continue
            arc = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(line, axis=0), axis=1))])
            low, high = contract["surface_exclusion_length_A"], arc[-1] - contract["surface_exclusion_length_A"]
            step = contract["cross_section_spacing_A"]
            at = low + step * np.arange(int(np.floor((high - low + 1e-9) / step)) + 1) if high >= low else np.array([arc[-1] / 2])
            branches = np.interp(mine["z"].to_numpy()[mine["branch"].to_numpy(bool)], line[:, 2], arc)
            wall = mine["wall"].to_numpy()
            for s in at:
                i = int(np.clip(np.searchsorted(arc, s, "right") - 1, 0, len(line) - 2))
                t = np.clip((s - arc[i]) / max(arc[i + 1] - arc[i], 1e-12), 0, 1)
                center = (1 - t) * line[i] + t * line[i + 1]
                tangent = (line[i + 1] - line[i]) / np.linalg.norm(line[i + 1] - line[i])
                near = contract["branch_exclusion_length_A"]
                if near > 0 and len(branches) and np.abs(branches - s).min() <= near + 1e-9:
                    got = {"valid": False, "invalid_reason": "branch_neighborhood"}
                else:
                    got = K.normal_section(mask, center, tangent, float((1 - t) * wall[i] + t * wall[i + 1]), contract, spacing, np.zeros(3))
                rows.append({"run_id": key[0], "track_id": int(name), "arc": float(s), **dict(zip(("x", "y", "z", "tx", "ty", "tz"), [*center, *tangent], strict=True)), **got})
        return pd.DataFrame(rows, columns=["run_id", *[c.split()[0] for c in SECTION.split(", ")]])

    return slabs.groupBy("run_id").cogroup(points.groupBy("run_id")).applyInPandas(run, f"run_id {kind}, {SECTION}")


def channels(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """Geometry of each track: eta, tau and mean curvature fluctuation, or the reason why not."""
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "track_id").orderBy("z_index")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ("y", "z")), (F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w))))
    ends = points.withColumn("_d", F.coalesce(step, F.lit(0.0))).groupBy("run_id", "track_id").agg(
        F.sum("_d").alias("arc"), F.count("*").alias("points"), F.bool_or("branch").alias("branched"), *[(F.max_by(c, "z_index") - F.min_by(c, "z_index")).alias(f"d{c}") for c in "xyz"]
    )
    flat = ends.withColumn("chord", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")))
    one = F.struct("run_id", "track_id")
    out = tracks.channel_rows(flat.select(one.alias("track_id"), "arc", "chord", "points", "branched"), cuts.select(one.alias("track_id"), "valid", "diameter", "fluctuation"))
    return out.select("track_id.run_id", "track_id.track_id", *[c for c in out.columns if c != "track_id"])


def orientations(points: DataFrame, contract: dict = CONTRACT) -> DataFrame:
    """theta_xz and theta_xy of each track's end-to-end axis, in degrees."""
    ends = points.groupBy("run_id", "track_id").agg(*[(F.max_by(c, "z_index") - F.min_by(c, "z_index")).alias(f"d{c}") for c in "xyz"])
    least = contract["orientation_projection_min_fraction"]
    return ends.select("run_id", "track_id", projected_angle("dx", "dz", "dy", least).alias("theta_xz"), projected_angle("dx", "dy", "dz", least).alias("theta_xy"))


def center_distances(points: DataFrame, shape: tuple[int, int, int], spacing: float, width: float, bins: int) -> DataFrame:
    """Pair distances of through centres within their slice, binned, over what an even spread would give."""
    box = (shape[0] * spacing, shape[1] * spacing)
    spots = points.select(F.struct("run_id", "track_id").alias("id"), F.struct("run_id", "z_index").alias("slice"), F.col("wrapped_x").alias("x"), F.col("wrapped_y").alias("y"))
    met = pairs.pairs_within(spots, width * bins, box, "slice")
    return pairs.histogram(met, "distance", width, bins)


def pair_curve(points: DataFrame, shape: tuple[int, int, int], spacing: float, contract: dict = CONTRACT) -> DataFrame:
    """run_id, bin, n, reference and g of through centres: pairs within a slice by distance, over what an even spread of as many centres would give.

    Bins of center_distance_bin_width_A (the voxel spacing without it) up to center_distance_max_A (half the shorter
    side, beyond which rings aren't whole). Runs without two centres in a slice have a g of 0.
    """
    box = (shape[0] * spacing, shape[1] * spacing)
    width = float(contract.get("center_distance_bin_width_A") or spacing)
    bins = max(1, int(float(contract.get("center_distance_max_A") or min(box) / 2) / width + 1e-9))
    spots = points.select("run_id", "z_index", F.col("track_id").alias("id"), F.col("wrapped_x").alias("x"), F.col("wrapped_y").alias("y"))
    slices = spots.withColumn("_slice", F.struct("run_id", "z_index"))
    met = pairs.pairs_within(slices.select("_slice", "id", "x", "y"), width * bins, box, "_slice").select("_slice.run_id", "distance")
    n = F.count("*").cast("double")
    total = spots.groupBy("run_id", "z_index").agg((n * (n - 1) / 2).alias("pairs")).groupBy("run_id").agg(F.sum("pairs").alias("pairs"))
    k = F.col("bin").cast("double")
    ring = F.pi() * width * width * (2 * k + 1) / (box[0] * box[1])
    reference = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("reference", F.col("pairs") * ring)
    both = reference.join(pairs.histogram(met, "distance", width, bins, ["run_id"]), ["run_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return both.select("run_id", "bin", "n", "reference", F.when(F.col("reference") > 0, F.col("n") / F.col("reference")).otherwise(0.0).alias("g"))


def measure_slabs(slabs: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0, contract: dict = CONTRACT) -> dict[str, DataFrame]:
    """All tables of a measurement of slab(run_id, z, mask): slabs, centers, points, through, sections, channels, orientations, distances, porosity."""
    from voxlake.tables import written

    slabs = written(slabs, "slabs")
    centers = written(slice_centers(slabs, shape, spacing, contract), "centers")
    points = written(track_points(centers, shape, spacing, contract), "tracks")
    cuts = written(sections(slabs, points, shape, spacing, contract), "sections")
    kind = dict(slabs.dtypes)["run_id"]

    def counted(frames):
        for frame in frames:
            yield pd.DataFrame({"run_id": frame["run_id"], "pores": [int(_unpacked(m, shape).sum()) for m in frame["mask"]]})

    pores = slabs.mapInPandas(counted, f"run_id {kind}, pores bigint").groupBy("run_id").agg((F.sum("pores") / float(shape[0] * shape[1] * shape[2])).alias("porosity"))
    whole = through(points, centers)
    distances = pair_curve(points.join(whole, ["run_id", "track_id"], "left_semi"), shape, spacing, contract)
    return {"slabs": slabs, "centers": centers, "points": points, "through": whole, "distances": distances, "sections": cuts, "channels": channels(points, cuts), "orientations": orientations(points, contract), "porosity": pores}


def measure(voxels: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0, contract: dict = CONTRACT) -> dict[str, DataFrame]:
    """measure_slabs of voxel(run_id, x, y, z, pore)."""
    return measure_slabs(packed(voxels, shape), shape, spacing, contract)
