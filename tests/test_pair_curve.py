"""Pair curves by run against the array version, Sobol points as columns, and losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.operators import pair_curve as P
from voxlake.plans import generate

BOX, WIDTH, BINS = (20.0, 30.0, 12.0), 1.5, 6
EDGES = np.arange(BINS + 1) * WIDTH


def points_of(spark, runs):
    rows = [(r, i, *map(float, p)) for r, ps in runs.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "run_id int, id int, x double, y double, z double").repartition(3)


def test_sobol_points_as_columns(spark):
    got = spark.range(1000).select("id", *P.sobol(F.col("id"), 6, 10)).orderBy("id").toPandas().to_numpy()[:, 1:]
    assert (got == K.sobol(1000, 6)).all()


@pytest.mark.parametrize("n", [2, 5, 6, 7, 40, 363, 500])
def test_reference_of_any_number_of_points(spark, n):
    got = {r["bin"]: r["reference"] for r in P.reference(spark.createDataFrame([(1, n)], "run_id int, n bigint"), BOX, WIDTH, BINS).collect()}
    np.testing.assert_allclose([got[b] for b in range(BINS)], generate.uniform_reference(n, BOX, EDGES))


def test_curves_of_runs(spark):
    rng = np.random.default_rng(1)
    runs = {0: rng.uniform(0, BOX, (60, 3)), 1: rng.uniform(0, BOX, (25, 3)), 2: rng.uniform(0, BOX, (1, 3)), 3: np.array([[1.0, 1, 1], [1.0, 1, 11.9]])}
    got = P.pair_curve(points_of(spark, runs), BOX, WIDTH, BINS).orderBy("run_id", "bin").toPandas()
    for r, ps in runs.items():
        reference = generate.uniform_reference(len(ps), BOX, EDGES)
        want = generate.pair_curve(ps, BOX, EDGES, reference)
        np.testing.assert_allclose(got[got["run_id"] == r]["g"], want)
    assert P.pair_curve(points_of(spark, runs).limit(0), BOX, WIDTH, BINS).count() == 0


def test_losses_and_peaks(spark):
    rows = [(0, b, n, float(n) / 3) for b, n in enumerate([0, 6, 3, 3, 9, 0])] + [(1, b, 0, 0.0) for b in range(6)]
    curve = spark.createDataFrame(rows, "run_id int, bin int, n bigint, g double")
    got = {r["run_id"]: r for r in P.losses(curve.withColumn("target", F.lit(1.0))).collect()}
    assert got[0]["loss"] == pytest.approx(np.mean([(g / 3 - 1) ** 2 for g in (0, 6, 3, 3, 9, 0)])) and got[0]["peaks"] == [1, 4]
    assert math.isinf(got[1]["loss"]) and got[1]["peaks"] == []
    bare = {r["bin"]: r["g"] for r in P.bare_curve(curve).where("run_id = 0").collect()}
    assert [bare[b] for b in range(6)] == pytest.approx([n / (21 / 4) for n in (0, 6, 3, 3, 9, 0)])
