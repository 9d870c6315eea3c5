"""Molecules placed in the pores without touching each other: rounds of proposals that are judged all at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.ordered import ranked
from voxlake.operators.pairs import joined_within, pairs_within
from voxlake.operators.units import uniform
from voxlake.tables import written


def placed(molecules: DataFrame, allowed: DataFrame, shape: tuple[int, int, int], radius: float, seed: int, attempts: int = 16, spacing: float = 1.0) -> DataFrame:
    """id, attempt, x, y and z of every molecule (id): null where none of `attempts` places was free.

    allowed: the voxels (x, y, z) that centres may lie in. In a round each molecule without a place proposes one, evenly
    over these voxels, by random numbers that are counters of seed, round and id. Proposals nearer than two radii to a
    molecule that has its place go; of those nearer to each other the smaller id stays, unless it meets a smaller one
    itself. Distances are periodic in x and y. Neighbours meet in cells, no task sees all, and how rows are dealt
    doesn't matter. Repeated ids are one molecule; null ids have none.
    """
    spark = molecules.sparkSession
    box = (shape[0] * spacing, shape[1] * spacing)
    ids = molecules.select(F.col("id").cast("bigint")).where("id is not null").distinct()
    spots = written(ranked(allowed.select("x", "y", "z").distinct().withColumn("_all", F.lit(0)), ["_all"], ["z", "y", "x"]).select("rank", "x", "y", "z"), "spots")
    n, left = spots.count(), written(ids, "molecules")
    kept = spark.createDataFrame([], "id bigint, attempt int, x double, y double, z double")
    for k in range(attempts if n else 0):
        draw = lambda stream: uniform(F.lit(seed), f"{stream}-{k}", F.col("id"))  # noqa: B023, E731
        aimed = left.withColumn("rank", F.floor(draw("spot") * n)).join(spots, "rank")
        tried = written(aimed.select("id", F.lit(k).alias("attempt"), *[((F.col(c) + draw(c)) * spacing).alias(c) for c in "xyz"]), "tried")
        free = written(tried.join(joined_within(tried, kept, 2 * radius, box).select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "free") if k else tried
        behind = pairs_within(free.select("id", "x", "y", "z"), 2 * radius, box).select(F.col("b").alias("id")).distinct()
        kept = written(kept.unionByName(free.join(behind, "id", "left_anti").select(kept.columns)), "placed")
        left = written(left.join(kept.select("id"), "id", "left_anti"), "molecules")
        if not left.limit(1).count():
            break
    return ids.join(kept, "id", "left")
