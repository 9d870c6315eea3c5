"""What channels' records claim, derived again from the rows of their curves."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import shapes

#: An angle between segments that counts as a bend, in radians, and how far a claim may be off.
BEND, RTOL = 0.08, 1e-6


def flatness(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Smallest over largest spread of points, from the covariances of their coordinates: roots of the eigenvalues of a symmetric 3 x 3 matrix, in closed form; 0 if they don't spread at all.

    With q a third of the trace and p the size of what is left, the eigenvalues are q + 2 p cos(phi + 2 k pi / 3).
    """
    q = (xx + yy + zz) / 3
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    determinant = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), determinant / (2 * p * p * p)))) / 3
    large, small = q + 2 * p * F.cos(phi), F.greatest(q + 2 * p * F.cos(phi + 2 * math.pi / 3), F.lit(0.0))
    return F.when(q <= 0, 0.0).when(p <= 0, 1.0).otherwise(F.sqrt(small / large))


def facts(curves: DataFrame, by: list[str]) -> DataFrame:
    """by, points, arc, chord, volume, radius_cv, radius_ratio, bend_count and nonplanarity of curves(by, idx, x, y, z, radius).

    The volume is what a circle of the radius sweeps, linear in its area between points. Standing still is no bend.
    """
    w = Window.partitionBy(*by).orderBy("idx")  # as many rows as a curve has points
    ahead = curves
    for c in ("x", "y", "z"):
        ahead = ahead.withColumn(f"_d{c}", F.lead(c).over(w) - F.col(c))
    step = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz"))
    ahead = ahead.withColumn("_step", step).withColumn("_swept", F.pi() * F.col("_step") * (F.col("radius") * F.col("radius") + F.lead("radius").over(w) * F.lead("radius").over(w)) / 2)
    for c in ("dx", "dy", "dz", "step"):
        ahead = ahead.withColumn(f"_before_{c}", F.lag(f"_{c}").over(w))
    dot = F.col("_dx") * F.col("_before_dx") + F.col("_dy") * F.col("_before_dy") + F.col("_dz") * F.col("_before_dz")
    sizes = F.col("_step") * F.col("_before_step")
    turn = F.when(sizes > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / sizes))))
    ends = [F.max_by(c, "idx") - F.min_by(c, "idx") for c in ("x", "y", "z")]
    covariance = [F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    out = ahead.groupBy(*by).agg(
        F.count("*").alias("points"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("arc"), F.sqrt(ends[0] * ends[0] + ends[1] * ends[1] + ends[2] * ends[2]).alias("chord"), F.coalesce(F.sum("_swept"), F.lit(0.0)).alias("volume"),
        (F.stddev_pop("radius") / F.avg("radius")).alias("radius_cv"), (F.min("radius") / F.max("radius")).alias("radius_ratio"), F.count_if(turn > BEND).alias("bend_count"), *covariance,
    )
    flat = F.when(F.col("points") < 3, 0.0).otherwise(flatness(*[F.col(f"_{n}") for n in ("xx", "yy", "zz", "xy", "xz", "yz")]))
    return out.withColumn("nonplanarity", flat).drop(*[f"_{n}" for n in ("xx", "yy", "zz", "xy", "xz", "yz")])


def record_issues(records: DataFrame, curves: DataFrame, by: list[str], rtol: float = RTOL) -> DataFrame:
    """by, code and detail of every claim of records(by, kind, volume, and any of radius_cv, radius_ratio, bend_count, nonplanarity, eta, tau) that the curves don't bear out, and radii that vary outside their limits.

    Channels without a curve and curves without a channel are issues too. Claims that are null aren't made.
    """
    found = facts(curves, by)
    found = found.withColumn("tau", F.when(F.col("chord") > 0, F.col("arc") / F.col("chord"))).withColumn("eta", F.when(F.col("arc") > 0, F.col("arc") / F.sqrt(4 * F.col("volume") / (F.pi() * F.col("arc")))))
    claims = [c for c in ("radius_cv", "radius_ratio", "bend_count", "nonplanarity", "eta", "tau") if c in records.columns]
    channels = records.where("kind = 'channel'").select(*by, "volume", *claims, F.lit(True).alias("_claimed"))
    names = ["volume", *claims]
    measured = found.select(*by, *[F.col(c).cast("double").alias(f"_{c}") for c in dict.fromkeys([*names, "radius_cv"])], F.lit(True).alias("_found"))
    both = channels.join(measured, by, "full_outer")

    def off(name: str) -> Column:
        limit = F.lit(shapes.VOLUME) * F.col(name) if name == "volume" else rtol * F.greatest(F.lit(1.0), F.abs(F.col(f"_{name}")))
        text = F.format_string(f"{name}: %s against %s", F.round(f"_{name}", 9).cast("string"), F.round(F.col(name).cast("double"), 9).cast("string"))
        return F.when(F.abs(F.col(f"_{name}") - F.col(name)) > limit, F.struct(F.lit(f"{name}_mismatch").alias("code"), text.alias("detail")))

    low, high = shapes.SPREAD
    varies = F.when(~F.col("_radius_cv").between(low, high), F.struct(F.lit("radius_cv_limits").alias("code"), F.round("_radius_cv", 9).cast("string").alias("detail"))) if "radius_cv" in claims else F.lit(None).cast("struct<code:string,detail:string>")
    alone = F.when(F.col("_claimed").isNull(), F.struct(F.lit("curve_without_unit").alias("code"), F.lit("").alias("detail"))).when(F.col("_found").isNull(), F.struct(F.lit("missing_curve").alias("code"), F.lit("").alias("detail")))
    listed = F.when(alone.isNotNull(), F.array(alone)).otherwise(F.array_compact(F.array(varies, *[off(n) for n in names])))
    return both.select(*by, F.explode(listed).alias("_i")).select(*by, "_i.code", "_i.detail")
