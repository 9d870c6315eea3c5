"""Finding the scale at which units have a porosity: many scales in one job, narrowed round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.geometry import squared_distance


def porosity_by_scale(units: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0) -> DataFrame:
    """f and porosity for every scale f of `units` (id, cx, cy, cz, r, f), r being scaled already."""
    nx, ny, nz = shape
    scales = units.select("f").distinct()
    return scales.join(_covered_by(units, shape, spacing), "f", "left").select("f", (F.coalesce("pores", F.lit(0)) / float(nx * ny * nz)).alias("porosity"))


def _covered_by(units: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    nx, ny, nz = shape

    def span(c: str, n: int, periodic: bool):
        low, high = F.floor((F.col(c) - F.col("r")) / spacing - 0.5), F.ceil((F.col(c) + F.col("r")) / spacing - 0.5)
        if periodic:
            return F.sequence(low.cast("int"), F.least(high, low + n - 1).cast("int"))
        low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    rows = units.select("f", "cx", "cy", "cz", "r", F.explode(span("cz", nz, False)).alias("z")).select("*", F.explode(span("cy", ny, True)).alias("_y")).select("*", F.explode(span("cx", nx, True)).alias("_x"))
    rows = rows.withColumn("x", F.pmod("_x", F.lit(nx))).withColumn("y", F.pmod("_y", F.lit(ny)))
    d2 = squared_distance(tuple((F.col(c) + 0.5) * spacing for c in "xyz"), ("cx", "cy", "cz"), (nx * spacing, ny * spacing))
    voxels = rows.where(d2 < F.col("r") * F.col("r")).groupBy("f", "x", "y", "z").agg(F.count("*").alias("n"))
    return voxels.groupBy("f").agg(F.count("*").alias("pores"))


def solve_scale(units: DataFrame, shape: tuple[int, int, int], target: float, tolerance: float, low: float = 0.1, high: float = 10.0, each: int = 8, rounds: int = 20, spacing: float = 1.0) -> tuple[float, float]:
    """(scale, porosity): porosity grows with the scale, so each round tries `each` scales of the bracket in one job and keeps the part around the target."""
    best = None
    for _ in range(rounds):
        tried = [low + (high - low) * (i + 1) / (each + 1) for i in range(each)]
        scaled = units.withColumn("f", F.explode(F.array(*[F.lit(f) for f in tried]))).withColumn("r", F.col("r") * F.col("f"))
        found = sorted((r["f"], r["porosity"]) for r in porosity_by_scale(scaled, shape, spacing).collect())  # `each` rows
        near = min(found, key=lambda x: (abs(x[1] - target), x[0]))
        best = near if best is None or abs(near[1] - target) < abs(best[1] - target) else best
        if abs(best[1] - target) <= tolerance:
            return best
        under, over = [f for f, p in found if p < target], [f for f, p in found if p >= target]
        low, high = max([low, *under]), min([high, *over])
        if high - low < 1e-9:
            break
    raise ValueError(f"no scale gives a porosity within {tolerance} of {target}; the nearest is {best}")
