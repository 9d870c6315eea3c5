"""Operators on tracks: clearance of a polyline from itself, closed curves, joins of tracks and their cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.ordered import circular


def vertex_clearance(points: DataFrame, by: str, order: list[str], axes: list[str], apart: int = 2) -> DataFrame:
    """Least distance by key of vertices at least `apart` places apart. Keys are bounded polylines; each meets itself alone."""
    w = Window.partitionBy(by).orderBy(*order)
    placed = points.withColumn("_i", F.row_number().over(w)).select(by, "_i", *axes)
    other = placed.select(by, F.col("_i").alias("_j"), *[F.col(c).alias(f"_{c}") for c in axes])
    d2 = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in axes[1:]), (F.col(axes[0]) - F.col(f"_{axes[0]}")) * (F.col(axes[0]) - F.col(f"_{axes[0]}")))
    return placed.join(other, by).where(F.col("_j") >= F.col("_i") + apart).groupBy(by).agg(F.sqrt(F.min(d2)).alias("clearance"))


def closed_curves(points: DataFrame, by: str, order: list[str]) -> DataFrame:
    """area (shoelace), and fluctuation of the second difference around the closed curve, population deviation over mean."""
    rows = points
    for c in ("x", "y"):
        before, after = circular(rows, by, order, c)
        rows = rows.withColumn(f"_b{c}", before).withColumn(f"_a{c}", after)
    bend = F.sqrt(F.pow(F.col("_ax") - 2 * F.col("x") + F.col("_bx"), 2) + F.pow(F.col("_ay") - 2 * F.col("y") + F.col("_by"), 2))
    area = F.abs(F.sum(F.col("x") * F.col("_ay") - F.col("y") * F.col("_ax"))) / 2
    return rows.groupBy(by).agg(area.alias("area"), (F.stddev_pop(bend) / F.abs(F.avg(bend))).alias("fluctuation"))


def through_tracks(points: DataFrame, track: str, z: str) -> DataFrame:
    """Tracks that begin on the lowest slice of all and end on the highest."""
    ends = points.agg(F.min(z).alias("_low"), F.max(z).alias("_high"))
    each = points.groupBy(track).agg(F.min(z).alias("a"), F.max(z).alias("b"))
    return each.crossJoin(F.broadcast(ends)).where("a = _low and b = _high").select(track)  # one row


def channel_rows(tracks: DataFrame, sections: DataFrame) -> DataFrame:
    """track_id, mean diameter and curvature fluctuation of a track's valid sections, arc over chord, and why a track has none.

    tracks: track_id, arc, chord, points, branched; sections: track_id, valid, diameter, fluctuation.
    """
    means = sections.where("valid and diameter is not null").groupBy("track_id").agg(F.count("*").alias("sections"), F.avg("diameter").alias("diameter"), F.avg("fluctuation").alias("fluctuation"))
    both = tracks.join(means, "track_id", "left")
    reason = (
        F.when(F.col("branched"), "branch_neighborhood")
        .when(F.col("points") < 2, "insufficient_centerline_points")
        .when(F.col("sections").isNull(), "no_valid_cross_sections")
        .when(~((F.col("arc") > 0) & (F.col("chord") > 0) & (F.col("diameter") > 0)), "nonpositive_channel_measure")
    )
    ok = reason.isNull()
    return both.select("track_id", ok.alias("valid"), reason.alias("invalid_reason"), *[F.when(ok, v).alias(n) for n, v in (("diameter", F.col("diameter")), ("eta", F.col("arc") / F.col("diameter")), ("tau", F.col("arc") / F.col("chord")), ("fluctuation", F.col("fluctuation")))])


def formal_samples(rows: DataFrame, through: DataFrame, track: str, value: str) -> DataFrame:
    """Valid, finite values of through tracks."""
    return rows.where(F.col("valid") & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf"))).join(through, track, "left_semi")


def trapezoid(points: DataFrame, by: str, order: list[str], at: str, value: str) -> DataFrame:
    """Integral of `value` over `at` by key."""
    w = Window.partitionBy(by).orderBy(*order)
    part = (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(at) - F.lag(at).over(w))
    return points.withColumn("_p", part).groupBy(by).agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias("integral"))
