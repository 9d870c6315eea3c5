"""Curves as rows: facts against the array kernels, claims against facts, altered bundles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.functions import shapes
from voxlake.operators import curves as C

ROWS = "unit_id string, idx int, x double, y double, z double, radius double"


def rows_of(spark, tubes):
    rows = [(n, i, *map(float, p), float(r)) for n, t in tubes.items() for i, (p, r) in enumerate(zip(t.points, t.radius, strict=True))]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture(scope="module")
def tubes():
    return {f"u{i}": shapes.winding(f"u{i}", 900.0 + 50 * i, 5.0 + i / 2, 1.15 + i / 20, 40 + i) for i in range(4)}


@pytest.fixture(scope="module")
def records(spark, tubes):
    found = {n: shapes.radius_record(t) | {"volume": t.volume()} for n, t in tubes.items()}
    rows = [(n, "channel", f["volume"], f["radius_cv"], f["radius_ratio"], f["bend_count"], f["nonplanarity"], float(tubes[n].arc[-1] / np.linalg.norm(tubes[n].points[-1] - tubes[n].points[0]))) for n, f in found.items()]
    rows.append(("ball", "compact", 10.0, None, None, None, None, None))
    return spark.createDataFrame(rows, "unit_id string, kind string, volume double, radius_cv double, radius_ratio double, bend_count int, nonplanarity double, tau double")


def test_facts_of_channels(spark, tubes):
    got = {r["unit_id"]: r for r in C.facts(rows_of(spark, tubes), ["unit_id"]).collect()}
    for n, t in tubes.items():
        want = shapes.radius_record(t)
        for key in ("radius_cv", "radius_ratio", "nonplanarity"):
            assert got[n][key] == pytest.approx(want[key], abs=1e-9)
        assert got[n]["bend_count"] == want["bend_count"] and got[n]["points"] == len(t.points)
        assert got[n]["arc"] == pytest.approx(t.arc[-1]) and got[n]["volume"] == pytest.approx(t.volume())


def test_flatness_of_any_points(spark):
    rng = np.random.default_rng(1)
    sets = {"cloud": rng.normal(size=(50, 3)) * [3, 2, 1], "plane": np.c_[rng.normal(size=(20, 2)), np.zeros(20)], "line": np.outer(np.arange(9.0), [1, 2, 3]), "ball": np.concatenate([np.eye(3), -np.eye(3)]), "point": np.ones((5, 3)), "pair": np.array([[0, 0, 0], [1.0, 1, 1]]), "one": np.zeros((1, 3)), "far": rng.normal(size=(30, 3)) + 1e6}
    rows = [(n, i, *map(float, p), 1.0) for n, ps in sets.items() for i, p in enumerate(ps)]
    got = {r["unit_id"]: r["nonplanarity"] for r in C.facts(spark.createDataFrame(rows, ROWS), ["unit_id"]).collect()}
    for n, ps in sets.items():
        assert got[n] == pytest.approx(K.nonplanarity(ps), abs=1e-7), n


def test_true_records_have_no_issues(spark, tubes, records):
    assert C.record_issues(records, rows_of(spark, tubes), ["unit_id"]).count() == 0


def test_altered_curves_and_records(spark, tubes, records):
    curves = rows_of(spark, tubes)
    codes = lambda r, c: {(i["unit_id"], i["code"]) for i in C.record_issues(r, c, ["unit_id"]).collect()}
    here = F.col("unit_id") == "u1"
    wide = curves.withColumn("radius", F.col("radius") * F.when(here, 1.05).otherwise(1.0))
    assert codes(records, wide) == {("u1", "volume_mismatch")}  # all radii alike: spread and shape stay
    one = curves.withColumn("radius", F.col("radius") * F.when(here & (F.col("idx") == 10), 1.001).otherwise(1.0))
    assert ("u1", "radius_cv_mismatch") in codes(records, one) and all(u == "u1" for u, _ in codes(records, one))
    even = curves.withColumn("radius", F.when(here, F.lit(3.0)).otherwise(F.col("radius")))
    assert ("u1", "radius_cv_limits") in codes(records, even)
    bent = curves.withColumn("x", F.col("x") + F.when(here & (F.col("idx") == 12), 2.0).otherwise(0.0))
    assert {("u1", "tau_mismatch"), ("u1", "nonplanarity_mismatch")} <= codes(records, bent)
    claimed = records.withColumn("bend_count", F.col("bend_count") + F.when(here, 1).otherwise(0))
    assert codes(claimed, curves) == {("u1", "bend_count_mismatch")}
    assert codes(records, curves.where(~here)) == {("u1", "missing_curve")}
    assert codes(records.where(~here), curves) == {("u1", "curve_without_unit")}
    silent = records.withColumn("tau", F.lit(None).cast("double")).withColumn("nonplanarity", F.lit(None).cast("double"))
    assert codes(silent, bent) >= set() and ("u1", "tau_mismatch") not in codes(silent, bent)
    assert codes(records.limit(0), curves.limit(0)) == set()
