"""Placing in rounds: no two touch, all lie in the pores, and rows may be dealt anyhow."""

import math

from pyspark.sql import functions as F

from voxlake.operators import placing
from voxlake.operators.pairs import pairs_within

SHAPE = (8, 8, 6)


def voxels(spark):
    at = spark.range(8 * 8 * 6).select((F.col("id") % 8).cast("int").alias("x"), (F.floor(F.col("id") / 8) % 8).cast("int").alias("y"), F.floor(F.col("id") / 64).cast("int").alias("z"))
    return at.where("x < 5 or y = 7")


def test_none_touch_and_all_lie_in_the_pores(spark):
    molecules = spark.range(120)
    got = placing.placed(molecules.repartition(5), voxels(spark), SHAPE, 0.45, 7, 8).cache()
    there = got.where("x is not null")
    assert got.count() == 120 and 60 < there.count() <= 120
    assert pairs_within(there.select("id", "x", "y", "z"), 0.9, (8, 8)).count() == 0
    pore = {(r["x"], r["y"], r["z"]) for r in voxels(spark).collect()}
    assert all(tuple(math.floor(r[c]) for c in "xyz") in pore for r in there.collect())
    assert got.groupBy("attempt").count().count() > 2
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = placing.placed(molecules.orderBy(F.desc("id")), voxels(spark), SHAPE, 0.45, 7, 8)
        assert {r["id"]: tuple(r) for r in again.collect()} == {r["id"]: tuple(r) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_too_many_and_none(spark):
    few = voxels(spark).where("x = 0 and y = 0 and z < 2")
    got = placing.placed(spark.createDataFrame([(i,) for i in (1, 2, 2, 3, None)], "id bigint"), few, SHAPE, 2.0, 7, 4).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3] and sum(r["x"] is not None for r in got) == 1  # room for one
    assert placing.placed(spark.range(3), few.limit(0), SHAPE, 0.1, 7).where("x is not null").count() == 0
    assert placing.placed(spark.range(0), few, SHAPE, 0.1, 7).count() == 0
