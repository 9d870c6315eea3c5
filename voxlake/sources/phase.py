"""Phases, units and curves as Parquet: written with what they mean, read with every claim checked. Findings are rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version and meaning of a stored phase.
META = {"version": 1, "axis_order": "z,y,x", "periodic_axes": ["x", "y"], "semiconductor": 0, "pore": 1}


def write_phase(voxels: DataFrame, path: str, shape: tuple[int, int, int], spacing: float, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), contract: dict | None = None) -> None:
    """voxel(x, y, z, pore) by slice, and one row that says what it is, with the measuring contract if it has one."""
    voxels.select("x", "y", "z", "pore").repartitionByRange("z").sortWithinPartitions("z", "y", "x").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/voxels")
    meta = META | {"shape": list(shape), "spacing_A": spacing, "origin_A": list(origin)} | ({"contract": contract} if contract else {})
    voxels.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_phase(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The voxels and their description; a ValueError says what isn't as it should be."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    wrong = [k for k, v in META.items() if meta.get(k) != v]
    if wrong or not meta.get("spacing_A", 0) > 0 or len(meta.get("shape", [])) != 3:
        raise ValueError(f"no phase of this version: {wrong or 'shape or spacing'}")
    voxels = spark.read.parquet(f"{path}/voxels")
    found = phase_issues(voxels, meta).limit(1).collect()
    if found:
        raise ValueError(f"{found[0]['code']}: {found[0]['detail']}")
    return voxels, meta


def phase_issues(voxels: DataFrame, meta: dict) -> DataFrame:
    """(code, detail): voxels outside the shape, null or repeated ones, and their number. One aggregate and one by voxel."""
    nx, ny, nz = meta["shape"]
    inside = F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1) & F.col("z").between(0, nz - 1)
    facts = voxels.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"), F.count_if(F.col("pore").isNull()).alias("null"))
    twice = voxels.groupBy("x", "y", "z").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("twice"))
    row = facts.crossJoin(twice)  # one row each
    codes = F.array(
        F.when(F.col("n") != nx * ny * nz, F.struct(F.lit("voxel_count").alias("code"), F.col("n").cast("string").alias("detail"))),
        *[F.when(F.col(c) > 0, F.struct(F.lit(code).alias("code"), F.col(c).cast("string").alias("detail"))) for c, code in (("outside", "voxel_outside"), ("null", "voxel_null"), ("twice", "voxel_repeated"))],
    )
    return row.select(F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("i")).select("i.code", "i.detail")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A column from the first table, or from the second where the first has none."""
    return first.select(*keys, F.col(column).alias("_a")).join(second.select(*keys, F.col(column).alias("_b")), keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias(column))


def curve_issues(units: DataFrame, curves: DataFrame) -> DataFrame:
    """(unit_id, code): channels without a curve, curves without a unit, too short, not finite, not positive, or with gaps in their order."""
    parts = curves.groupBy("unit_id").agg(
        F.count("*").alias("n"), (F.max("idx") - F.min("idx") + 1).alias("span"), F.bool_and(F.col("radius") > 0).alias("positive"),
        F.bool_and((F.abs(F.col("x")) + F.abs(F.col("y")) + F.abs(F.col("z")) + F.abs(F.col("radius"))) < float("inf")).alias("finite"),
    )
    both = units.where("kind = 'channel'").select("unit_id", F.lit(True).alias("_u")).join(parts, "unit_id", "full_outer")
    code = (
        F.when(F.col("_u").isNull(), "curve_without_unit").when(F.col("n").isNull(), "missing_curve").when(F.col("n") < 2, "curve_too_short")
        .when(~F.coalesce("finite", F.lit(False)), "curve_not_finite").when(~F.coalesce("positive", F.lit(False)), "radius_not_positive").when(F.col("span") != F.col("n"), "curve_order")
    )
    return both.select("unit_id", code.alias("code")).where("code is not null")


def curve_volumes(curves: DataFrame) -> DataFrame:
    """unit_id and volume: pi times the integral of the squared radius along each curve."""
    from pyspark.sql import Window

    from voxlake.operators.tracks import trapezoid

    w = Window.partitionBy("unit_id").orderBy("idx")
    step = F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in "yz"), (F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w)))), F.lit(0.0))
    placed = curves.withColumn("_d", step).withColumn("s", F.sum("_d").over(w)).withColumn("area", F.pi() * F.col("radius") * F.col("radius"))
    return trapezoid(placed, "unit_id", ["idx"], "s", "area").withColumnRenamed("integral", "volume")


def unit_rows(units: DataFrame) -> DataFrame:
    """Unit metrics as text with ten decimals, empty for null, as the CSV has them."""
    from voxlake.sources.files import fixed_decimals

    numbers = [c for c, t in units.dtypes if t == "double"]
    return units.select(*[c for c in units.columns if c not in numbers], *fixed_decimals(numbers))


def write_measurement(tables: dict[str, DataFrame], path: str, contract: dict | None = None) -> None:
    """A measurement's tables, and the contract that it was made by: Parquet for the program, sections as CSV with a header and channels as JSON for others."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    if "sections" in tables:
        tables["sections"].write.mode("overwrite").option("header", True).csv(f"{path}/final_cross_sections")
    if "channels" in tables:
        tables["channels"].write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/final_channels")
    if contract is not None:
        spark = tables["sections"].sparkSession
        spark.createDataFrame([(json.dumps(contract, sort_keys=True),)], "contract string").coalesce(1).write.mode("overwrite").parquet(f"{path}/contract")
