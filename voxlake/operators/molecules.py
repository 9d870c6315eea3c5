"""Rigid molecules: placing templates, collisions, intrusion into the solid, counts that must agree, and a sequential packer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import fields
from voxlake.functions.geometry import placed, voxel_index
from voxlake.functions.kernels import kabsch_rmsd
from voxlake.operators.pairs import joined_within


def placed_atoms(instances: DataFrame, template: DataFrame) -> DataFrame:
    """Every instance's atoms: instance(instance, x, y, z, qx, qy, qz, qw) by template(serial, x, y, z, radius). A template is one molecule and goes to all executors."""
    atom = F.broadcast(template.select("serial", "radius", *[F.col(c).alias(f"_{c}") for c in "xyz"]))
    at = placed(("qx", "qy", "qz", "qw"), ("_x", "_y", "_z"), ("x", "y", "z"))
    return instances.crossJoin(atom).select("instance", "serial", "radius", *[p.alias(c) for p, c in zip(at, "xyz", strict=True)])


def collisions(atoms: DataFrame, radius: float, box: tuple[float, float]) -> DataFrame:
    """Pairs of atoms of different instances nearer than `radius`, the border in x and y no border."""
    spots = atoms.select(F.struct("instance", "serial").alias("id"), "x", "y", "z")
    return joined_within(spots, spots, radius, box).where("a.instance < b.instance and distance < " + repr(float(radius)))


def least_distance(atoms: DataFrame, box: tuple[float, float], upto: float) -> DataFrame:
    """The least distance of atoms of different instances, if there is one up to `upto`."""
    return collisions(atoms, upto, box).agg(F.min("distance").alias("minimum_distance"))


def molecule_centers(atoms: DataFrame) -> DataFrame:
    return atoms.groupBy("chain", "residue", "residue_no").agg(*[F.avg(c).alias(c) for c in "xyz"])


def intrusion(points: DataFrame, pore: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """Points, points in the pore, in the solid and outside the film in z, from an equi-join with the pore's voxels (x, y, z)."""
    nx, ny, nz = shape
    at = points.select(*[voxel_index(c, 0.0, spacing, n, c != "z").cast("int").alias(f"i{c}") for c, n in zip("xyz", shape, strict=True)])
    marked = at.join(pore.select(*[F.col(c).alias(f"i{c}") for c in "xyz"], F.lit(True).alias("pore")), ["ix", "iy", "iz"], "left")
    return marked.agg(F.count("*").alias("points"), F.count_if("pore").alias("in_pore"), F.count_if(F.col("iz").isNotNull() & F.col("pore").isNull()).alias("in_solid"), F.count_if(F.col("iz").isNull()).alias("outside"))


def agreeing_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """source and n of each table's instances, and whether all agree; sources: name -> table with a column instance, or one row n."""
    out = None
    for name, df in sources.items():
        n = df.agg(F.count_distinct("instance").alias("n")) if "instance" in df.columns else df.select("n")
        part = n.select(F.lit(name).alias("source"), F.col("n").cast("bigint").alias("n"))
        out = part if out is None else out.union(part)
    same = out.agg((F.min("n") == F.max("n")).alias("agree"))
    return out.crossJoin(F.broadcast(same))  # one row


def template_deviation(atoms: DataFrame, template: DataFrame) -> DataFrame:
    """rmsd of each instance from the template under a rigid motion. An instance is one molecule."""
    wanted = {r["serial"]: (r["x"], r["y"], r["z"]) for r in template.select("serial", "x", "y", "z").collect()}  # one molecule

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mine = frame.sort_values("serial")
        return pd.DataFrame({"instance": [int(mine["instance"].iloc[0])], "rmsd": [kabsch_rmsd(mine[["x", "y", "z"]].to_numpy(), np.array([wanted[s] for s in mine["serial"]]))]})

    return atoms.groupBy("instance").applyInPandas(run, "instance bigint, rmsd double")


class PackingError(ValueError):
    """Not all molecules found a place."""


def _random_quaternion(rng: np.random.Generator) -> np.ndarray:
    q = rng.normal(size=4)
    return q / np.linalg.norm(q)


def _turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2 * np.cross(q[:3], v)
    return v + q[3] * t + np.cross(q[:3], t)


def packed(template: np.ndarray, radii: np.ndarray, units: list[fields.Unit], box: tuple[float, float, float], count: int, rng: np.random.Generator, wall: float = 0.0, apart: float = 2.0, tries: int = 2000, repairs: int = 8, open_z: bool = True) -> np.ndarray:
    """(count, 7): places and quaternions (x, y, z, w) of molecules within the pore, put in one after another.

    A place stands if every atom's ball keeps `wall` from the solid, by the field over its slope bound, and `apart`
    from the atoms placed before; atoms may stand out of the film in z where it is open. One that fails is moved a
    little up to `repairs` times. Raises PackingError if a molecule finds no place.
    """
    bound = fields.slope(units)
    done: list[np.ndarray] = []
    cells: dict[tuple, list[np.ndarray]] = {}
    side = np.array(box)
    n = np.maximum(1, np.floor(side[:2] / apart)).astype(int)

    def cell(p: np.ndarray) -> tuple[int, int, int]:
        xy = np.minimum(np.floor(p[:2] % side[:2] / (side[:2] / n)).astype(int), n - 1)
        return int(xy[0]), int(xy[1]), int(np.floor(p[2] / apart))

    def free(atoms: np.ndarray) -> bool:
        inside = (atoms[:, 2] >= 0) & (atoms[:, 2] <= side[2])
        if not open_z and not inside.all():
            return False
        if inside.any():
            f = fields.union_field(units, np.column_stack([atoms[inside, :2] % side[:2], atoms[inside, 2]]), box)
            if (f / bound > -(radii[inside] + wall)).any():
                return False
        for p in atoms:
            cx, cy, cz = cell(p)
            for dx in {(cx + d) % n[0] for d in (-1, 0, 1)}:
                for dy in {(cy + d) % n[1] for d in (-1, 0, 1)}:
                    for dz in (-1, 0, 1):
                        for q in cells.get((dx, dy, cz + dz), ()):
                            d = p - q
                            d[:2] -= side[:2] * np.rint(d[:2] / side[:2])
                            if d @ d < apart * apart:
                                return False
        return True

    for k in range(count):
        for _ in range(tries):
            place, q = rng.random(3) * side, _random_quaternion(rng)
            for step in range(repairs + 1):
                atoms = _turned(q, template) + place
                if free(atoms):
                    break
                place = place + rng.normal(0, apart / 4, 3)
                if step == repairs:
                    atoms = None
            if atoms is not None:
                break
        else:
            raise PackingError(f"{k} of {count} molecules found a place")
        place = np.array([*(place[:2] % side[:2]), place[2]])
        done.append(np.concatenate([place, q]))
        for p in _turned(q, template) + place:
            cells.setdefault(cell(p), []).append(p)
    return np.array(done).reshape(-1, 7)
