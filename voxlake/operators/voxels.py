"""Phases on a voxel lattice: units drawn into voxels, fractions by column and face, coverage, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.geometry import minimum_image, squared_distance
from voxlake.operators.ordered import ranked
from voxlake.operators.pairs import BROADCAST_ROWS
from voxlake.tables import written


def lattice(spark: SparkSession, nx: int, ny: int, nz: int, spacing: float = 1.0) -> DataFrame:
    """x, y, z indices (x fastest in the flat id) and the centre px, py, pz of every voxel; generated, never stored."""
    ids = spark.range(nx * ny * nz)
    at = ids.select("id", (F.col("id") % nx).cast("int").alias("x"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("y"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("z"))
    return at.select("*", *[((F.col(c) + 0.5) * spacing).alias(f"p{c}") for c in "xyz"])


def covered(units: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0) -> DataFrame:
    """x, y, z and n, the spheres (id, cx, cy, cz, r) a voxel centre lies in (field < 0), of all voxels in any.

    Units walk through their own bounding boxes, so the work is the volume covered, not voxels times units; partial
    counts shrink it before the shuffle. Equal spheres walk once, and are dealt to tasks for that.
    """
    nx, ny, nz = shape

    def span(c: str, n: int, periodic: bool):
        low, high = F.floor((F.col(c) - F.col("r")) / spacing - 0.5), F.ceil((F.col(c) + F.col("r")) / spacing - 0.5)
        if not periodic:
            low, high = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
            return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
        high = F.least(high, low + n - 1)  # not twice around
        return F.sequence(low.cast("int"), high.cast("int"))

    place = ["cx", "cy", "cz", "r"]
    alike = units.groupBy(*place).agg(F.count("*").alias("_n"))
    rows = alike.select(*place, "_n", F.explode(span("cz", nz, False)).alias("z")).select("*", F.explode(span("cy", ny, True)).alias("_y")).select("*", F.explode(span("cx", nx, True)).alias("_x"))
    rows = rows.withColumn("x", F.pmod("_x", F.lit(nx))).withColumn("y", F.pmod("_y", F.lit(ny)))
    centre = [(F.col(c) + 0.5) * spacing for c in "xyz"]
    d2 = squared_distance(tuple(centre), ("cx", "cy", "cz"), (nx * spacing, ny * spacing))
    return rows.where(d2 < F.col("r") * F.col("r")).groupBy("x", "y", "z").agg(F.sum("_n").alias("n"))


def phase(covered_voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The whole lattice with pore (in any unit)."""
    nx, ny, nz = shape
    whole = lattice(covered_voxels.sparkSession, nx, ny, nz).select("id", "x", "y", "z")
    return whole.join(covered_voxels.select("x", "y", "z", "n"), ["x", "y", "z"], "left").select("id", "x", "y", "z", F.col("n").isNotNull().alias("pore"))


def porosity_and_sections(covered_voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """porosity, and the least solid fraction of a section across x and the first x that has it. One small aggregate by x."""
    nx, ny, nz = shape
    spark = covered_voxels.sparkSession
    by_x = spark.range(nx).select(F.col("id").cast("int").alias("x")).join(covered_voxels.groupBy("x").agg(F.count("*").alias("pores")), "x", "left").withColumn("pores", F.coalesce("pores", F.lit(0)))
    solid = 1.0 - F.col("pores") / float(ny * nz)
    return by_x.withColumn("solid", solid).agg((F.sum("pores") / float(nx * ny * nz)).alias("porosity"), F.min("solid").alias("min_section"), F.min_by("x", F.struct("solid", "x")).alias("min_section_x"))


def surface_openings(covered_voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Pore fraction of the six faces, in one pass."""
    nx, ny, nz = shape
    areas = {"x": ny * nz, "y": nx * nz, "z": nx * ny}
    ends = {"x": nx - 1, "y": ny - 1, "z": nz - 1}
    aggs = [(F.count_if(F.col(c) == at) / float(areas[c])).alias(f"{c}_{side}") for c in "xyz" for side, at in (("low", 0), ("high", ends[c]))]
    return covered_voxels.agg(*aggs)


def overlap_fraction(covered_voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Share of all voxels in two units or more, and share of the pore that is."""
    nx, ny, nz = shape
    twice = F.count_if(F.col("n") > 1)
    return covered_voxels.agg((twice / float(nx * ny * nz)).alias("overlap_fraction"), (twice / F.nullif(F.count("*"), F.lit(0))).alias("overlap_of_pore"), F.max("n").alias("most_units"))


def sphere_field(points: DataFrame, units: DataFrame, box: tuple[float, float], sharpness: float | None = None) -> DataFrame:
    """`points` (px, py, pz) with sdf, the least signed distance to the spheres `units` (id, cx, cy, cz, r).

    With a sharpness b the smooth minimum -log(sum(exp(-b d))) / b, shifted by the minimum before it is exponentiated.
    Few units travel as one array and are folded in place, with no shuffle; many meet the points in blocks of at most
    BROADCAST_ROWS and are reduced to one row a point before the shuffle.
    """

    def distance(cx, cy, cz, r):
        d2 = F.pow(minimum_image(F.col("px") - cx, box[0]), 2) + F.pow(minimum_image(F.col("py") - cy, box[1]), 2) + F.pow(F.col("pz") - cz, 2)
        return F.sqrt(d2) - r

    of = lambda u: distance(u["cx"], u["cy"], u["cz"], u["r"])
    least = F.aggregate("units", F.lit(float("inf")), lambda acc, u: F.least(acc, of(u)))
    total = F.aggregate("units", F.lit(0.0), lambda acc, u: acc + F.exp(-(sharpness or 0.0) * (of(u) - F.col("sdf"))))
    if units.count() <= BROADCAST_ROWS:
        rows = units.agg(F.sort_array(F.collect_list(F.struct("id", "cx", "cy", "cz", "r"))).alias("units"))
        out = points.crossJoin(F.broadcast(rows)).withColumn("sdf", least)  # one row of at most BROADCAST_ROWS units
        return (out.withColumn("sdf", F.col("sdf") - F.log(total) / sharpness) if sharpness else out).drop("units")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # within the partition
    blocks = units.select(F.spark_partition_id().alias("_part"), F.floor(place / BROADCAST_ROWS).alias("_block"), F.struct("cx", "cy", "cz", "r").alias("_unit"))
    blocks = written(blocks.groupBy("_part", "_block").agg(F.collect_list("_unit").alias("units")).select("units"), "units")
    held = written(points.withColumn("_point", F.monotonically_increasing_id()), "points")

    def reduced(rows: DataFrame, of_block: Column, how) -> DataFrame:
        """A value of each block and point, folded where they meet, then over the blocks by point alone; the points' columns come back by a join."""
        met = rows.select("_point", "px", "py", "pz", *(["sdf"] if "sdf" in rows.columns else [])).crossJoin(blocks.hint("shuffle_replicate_nl"))
        return rows.join(met.select("_point", of_block.alias("_value")).groupBy("_point").agg(how("_value").alias("_reduced")), "_point", "left")

    out = reduced(held, least, F.min).withColumn("sdf", F.coalesce("_reduced", F.lit(float("inf")))).drop("_reduced")
    if sharpness:
        out = reduced(written(out, "field"), total, F.sum).withColumn("sdf", F.col("sdf") - F.log("_reduced") / sharpness)
    return out.select(*[F.col(f"`{c}`") for c in points.columns], "sdf")


def evenly_sampled(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """`most` rows at even ranks from the first to the last, whole ranks rounded down; all rows if there are no more."""
    placed = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], order)
    last = F.greatest(F.col("n") - 1, F.lit(1))
    i = F.ceil(F.col("rank") * F.lit(most - 1.0) / last)
    here = (F.floor(i * last / F.lit(most - 1.0)) == F.col("rank")) | (F.floor((i - 1) * last / F.lit(most - 1.0)) == F.col("rank")) if most > 1 else F.col("rank") == 0
    return placed.where((F.col("n") <= most) | here).drop("_all", "rank", "n")


def coverage_by_run(runs: DataFrame) -> DataFrame:
    """Longest run of pore voxels along z and the column that has it: islands by row number minus z."""
    from pyspark.sql import Window

    w = Window.partitionBy("x", "y").orderBy("z")
    islands = runs.withColumn("island", F.col("z") - F.row_number().over(w)).groupBy("x", "y", "island").agg(F.count("*").alias("length"))
    return islands.groupBy("x", "y").agg(F.max("length").alias("longest"))
