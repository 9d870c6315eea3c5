"""Units as rows: draws meet their targets, geometry gives what was drawn, and nothing depends on how rows are dealt."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import distributions as D
from voxlake.operators import units as U
from voxlake.operators.ordered import ranked
from voxlake.plans import units as plan

CENTERS = "run_id int, unit_id bigint, seed bigint, x double, y double, z double"


def centers(spark, runs, each, null=False):
    rows = [(r, u, 100 + r, float(u % 7), float(u % 5), float(u % 3)) for r in range(runs) for u in range(each)]
    rows += [(None, 1, 1, 0.0, 0.0, 0.0), (0, None, 1, 0.0, 0.0, 0.0), (0, 10**6, None, 0.0, 0.0, 0.0)] if null else []
    return spark.createDataFrame(rows, CENTERS)


def test_ranked_against_a_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(i), float(v)) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 0, 1, 2], 500), rng.integers(0, 20, 500), strict=True))]
    got = ranked(spark.createDataFrame(rows, "g int, i int, v double").repartition(5), ["g"], ["v", "i"]).collect()
    assert len(got) == 500
    for g in range(3):
        mine = sorted((v, i) for h, i, v in rows if h == g)
        assert {r["i"]: (r["rank"], r["n"]) for r in got if r["g"] == g} == {i: (k, len(mine)) for k, (_, i) in enumerate(mine)}


@pytest.mark.parametrize("weights,n", [([0.65, 0.35], 43), ([0.5, 0.5], 7), ([1, 1, 1], 10), ([0.2, 0.3, 0.5], 1), ([0.1, 0.1, 0.8], 5)])
def test_components_as_apportioned(spark, weights, n):
    got = Counter(r[0] for r in spark.range(n).select(U.component(weights, F.col("id"), F.lit(n))).collect())
    assert [got.get(i, 0) for i in range(len(weights))] == D.apportioned(weights, n)


@pytest.mark.parametrize(
    "spec",
    [
        {"family": "constant", "value": 2.5}, {"family": "weibull", "shape": 2.0, "scale": 3.0, "loc": 1.0}, {"family": "beta", "alpha": 1.0, "beta": 2.0, "lower": 1.0, "upper": 4.0}, {"family": "beta", "alpha": 3.0, "beta": 1.0},
        {"family": "beta", "alpha": 2.2, "beta": 2.8, "lower": 2.0, "upper": 4.0}, {"family": "gamma", "shape": 2.0, "scale": 1.5}, {"family": "lognormal", "mu": 0.3, "sigma": 0.4},
    ],
)
def test_quantiles_as_columns(spark, spec):
    levels = np.linspace(0.01, 0.99, 25)
    got = spark.createDataFrame([(float(x),) for x in levels], "l double").select("l", U.quantile(spec, F.col("l")).alias("q")).orderBy("l").toPandas()
    np.testing.assert_allclose(got["q"], D.quantile(spec, levels), rtol=1e-6)


def test_a_mixture_draws_each_component_in_its_share(spark):
    spec = {"family": "mixture", "components": [{"weight": 1.0, "family": "beta", "alpha": 1, "beta": 1, "lower": 0.0, "upper": 1.0}, {"weight": 3.0, "family": "beta", "alpha": 1, "beta": 1, "lower": 10.0, "upper": 11.0}]}
    got = [r[0] for r in spark.range(100).select(U.quantile(spec, (F.col("id") + 0.5) / 100)).collect()]
    assert sum(v <= 1 for v in got) == 25 and sum(10 <= v <= 11 for v in got) == 75


def test_units_meet_their_targets_in_every_run(spark):
    made = U.assembled(centers(spark, 3, 60, null=True), plan.CONFIG).cache()
    assert made.count() == 180
    assert {(r["run_id"], r["kind"]): r["count"] for r in made.groupBy("run_id", "kind").count().collect()} == {(r, k): n for r in range(3) for k, n in (("compact", 39), ("channel", 21))}
    rows = plan.audit(made, plan.CONFIG).collect()
    assert len(rows) == 3 * 8 and all(r["passed"] and r["ks"] <= 1.000001 / r["n"] for r in rows)  # one value in each stratum
    drawn = {(r["run_id"], r["unit_id"]): r for r in made.collect()}
    for r in U.remeasured(made, U.centerlines(made)).collect():
        d = drawn[r["run_id"], r["unit_id"]]
        for q in ("diameter", "eta", "theta_xz", "theta_xy"):
            assert math.isclose(r[q], d[q], rel_tol=1e-9), q
        assert r["tau"] is d["tau"] is None or math.isclose(r["tau"], d["tau"], rel_tol=1e-9)


def test_an_altered_unit_fails_its_audit(spark):
    made = U.assembled(centers(spark, 1, 40), plan.CONFIG)
    bent = made.withColumn("coil_radius", F.col("coil_radius") * 3)
    failed = {r["quantity"] for r in plan.audit(bent, plan.CONFIG).collect() if not r["passed"]}
    assert "channel_tau" in failed and "theta_xz_0" not in failed


def test_rows_do_not_depend_on_how_they_are_dealt(spark):
    base = centers(spark, 2, 30)
    first = sorted(map(tuple, U.assembled(base, plan.CONFIG).collect()), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        again = sorted(map(tuple, U.assembled(base.repartition(7), plan.CONFIG).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    close = lambda a, b: a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-12))  # noqa: E731 sums add in any order
    assert all(close(a, b) for x, y in zip(first, again, strict=True) for a, b in zip(x, y, strict=True))


def test_volumes_share_the_pore_volume(spark):
    config = plan.CONFIG | {"channel": {k: v for k, v in plan.CONFIG["channel"].items() if k != "diameter"}, "orientation": {"polar": {"family": "beta", "alpha": 1.0, "beta": 1.0}}}
    got = U.assembled(centers(spark, 2, 50), config).groupBy("run_id").agg(F.sum("volume").alias("v"), (F.avg(F.when(F.col("kind") == "channel", F.col("volume"))) / F.avg(F.when(F.col("kind") == "compact", F.col("volume")))).alias("ratio")).collect()
    for r in got:
        assert math.isclose(r["v"], 0.28 * 1e6, rel_tol=1e-9)
        assert math.isclose(r["ratio"], 1.6 / 0.8862, rel_tol=0.1)  # over the mean of the compact ones' relative volumes


def test_directions_from_a_polar_distribution(spark):
    config = plan.CONFIG | {"orientation": {"polar": {"family": "constant", "value": 0.0}}}
    got = U.assembled(centers(spark, 1, 20), config).collect()
    assert all(r["dx"] > 0.9999 and r["theta_xz"] < 1e-6 and r["component"] is None for r in got)


def test_no_units(spark):
    assert U.assembled(centers(spark, 1, 1).limit(0), plan.CONFIG).count() == 0
    one = U.assembled(centers(spark, 1, 1), plan.CONFIG).collect()
    assert len(one) == 1 and one[0]["kind"] == "compact"


SHAPE, SPACING = (12, 10, 8), 2.0
BOX = tuple(n * SPACING for n in SHAPE)
SMALL = plan.CONFIG | {"box": list(BOX), "channel": {k: v for k, v in plan.CONFIG["channel"].items() if k != "diameter"}}


def inside_any(units, lines):
    """Plain numpy over all voxels, all periodic images and all pieces."""
    at = np.stack(np.meshgrid(*[(np.arange(n) + 0.5) * SPACING for n in SHAPE], indexing="ij"), axis=-1).reshape(-1, 3)
    out = np.zeros(len(at), bool)
    shifts = [(i * BOX[0], j * BOX[1], 0) for i in range(-2, 3) for j in range(-2, 3)]
    for u in units:
        for s in shifts:
            p = at + s
            if u["kind"] == "compact":
                off = p - [u["x"], u["y"], u["z"]]
                along = off @ [u["dx"], u["dy"], u["dz"]]
                out |= ((off**2).sum(1) - along**2) / u["minor_radius"] ** 2 + along**2 / u["major_radius"] ** 2 < 1
            else:
                points = np.array([(r["x"], r["y"], r["z"]) for r in sorted(lines[u["unit_id"]], key=lambda r: r["place"])])
                for a, b in zip(points, points[1:], strict=False):
                    t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
                    out |= ((p - a - t[:, None] * (b - a)) ** 2).sum(1) < (u["diameter"] / 2) ** 2
    return {tuple(int(c) for c in np.round(v / SPACING - 0.5)) for v in at[out]}


def test_units_drawn_into_voxels(spark):
    made = U.assembled(centers(spark, 2, 9), SMALL).cache()
    lines = U.centerlines(made)
    got = {}
    for r in U.covered(made, lines, SHAPE, SPACING).collect():
        got.setdefault(r["run_id"], set()).add((r["x"], r["y"], r["z"]))
    points = {}
    for r in lines.collect():
        points.setdefault((r["run_id"], r["unit_id"]), []).append(r)
    for run in range(2):
        mine = [u for u in made.collect() if u["run_id"] == run]
        assert got[run] == inside_any(mine, {u: rows for (r, u), rows in points.items() if r == run})


def test_scales_that_give_a_porosity(spark):
    made = U.assembled(centers(spark, 2, 9), SMALL).cache()
    got = {r["run_id"]: r for r in U.solved_scales(made, 0.28, SHAPE, SPACING, each=6, rounds=3).collect()}
    for run in range(2):
        assert abs(got[run]["porosity"] - 0.28) <= 0.01
        again = U.porosities(made, spark.createDataFrame([(run, got[run]["scale"])], "run_id int, scale double"), SHAPE, SPACING).first()
        assert again["porosity"] == got[run]["porosity"]
    larger = U.scaled(made, F.lit(2.0))
    assert math.isclose(larger.agg(F.sum("volume")).first()[0], 8 * made.agg(F.sum("volume")).first()[0])
