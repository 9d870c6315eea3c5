"""One-to-one matching of two sets without a common key: points by distance, and anything by a cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.pairs import joined_within, spacing
from voxlake.tables import dropped, written


def mutual(pairs: DataFrame, cost: str, by: list[str] | None = None) -> DataFrame:
    """The pairs (by, a, b, cost) left when the cheapest is taken, both its ends are struck out, and so on; ties go by a, then b.

    Done in rounds instead: every pair that is the cheapest of both its ends is taken at once, which gives the same
    pairs, since nothing can take one of its ends first. Each round is two partial aggregates and joins by end.
    """
    by = by or []
    left, found = written(pairs.select(*by, "a", "b", F.col(cost).alias("_cost")).where("a is not null and b is not null and _cost is not null"), "pairs"), []
    order = F.min(F.struct("_cost", "a", "b")).alias("_best")
    while True:
        best = [left.groupBy(*by, end).agg(order).select(*by, F.col(f"_best.{end}").alias(end), "_best") for end in "ab"]
        both = best[0].alias("l").join(best[1].alias("r"), (F.col("l._best") == F.col("r._best")) if not by else [*by, "_best"])
        taken = written((both.select("l._best") if not by else both.select(*by, "_best")).select(*by, "_best.a", "_best.b", F.col("_best._cost").alias(cost)), "matched")
        if not taken.limit(1).count():
            dropped(left)
            break
        found.append(taken)
        rest = written(left.join(taken.select(*by, "a"), [*by, "a"], "left_anti").join(taken.select(*by, "b"), [*by, "b"], "left_anti"), "pairs")
        dropped(left)
        left = rest
    out = found[0] if found else taken
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def matched_points(reported: DataFrame, expected: DataFrame, tolerance: float, box: tuple[float, float], by: list[str] | None = None) -> DataFrame:
    """by, reported, expected (ids), distance and status of every point: ok, missing (only expected) or unexpected (only reported).

    Points: id, x, y, z if both have one, and `by`. Periodic in x and y. Points meet in cells, then pairs are taken one to
    one, nearest first; ids are unique within `by`. Where points are dense, pairs up to about their spacing are taken to
    the end first, then those of what is left up to twice as far, until the tolerance: the same pairs, and never all of them at once.
    """
    by = by or []
    most = expected.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    reach, left, right, near = min(tolerance, spacing(box, most or 1)), reported, expected, None
    while True:
        taken = mutual(joined_within(left, right, reach, box, by), "distance", by)
        near = taken if near is None else near.unionByName(taken)
        if reach >= tolerance:
            break
        left, right = (written(points.join(taken.select(*by, F.col(end).alias("id")), [*by, "id"], "left_anti"), "unmatched") for points, end in ((left, "a"), (right, "b")))
        reach = min(2 * reach, tolerance)
    left = near.join(reported.select(*by, F.col("id").alias("a"), F.lit(True).alias("_r")), [*by, "a"], "right").select(*by, "a", "b", "distance")
    extra = expected.select(*by, F.col("id").alias("b")).join(near.select(*by, "b"), [*by, "b"], "left_anti").select(*by, F.lit(None).cast(dict(left.dtypes)["a"]).alias("a"), "b", F.lit(None).cast("double").alias("distance"))
    status = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "unexpected").otherwise("ok")
    return left.unionByName(extra).select(*by, F.col("a").alias("reported"), F.col("b").alias("expected"), "distance", status.alias("status"))
