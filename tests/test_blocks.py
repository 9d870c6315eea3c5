"""Labels in two levels, totals and ranks over one global order, even samples, fields of many units."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions.kernels import block_components
from voxlake.operators import graph, ordered, pairs, statistics, voxels


def lattice_of(spark, mask):
    nz, ny, nx = mask.shape
    rows = [(int(x + nx * (y + ny * z)), int(x), int(y), int(z), bool(mask[z, y, x])) for z in range(nz) for y in range(ny) for x in range(nx)]
    return spark.createDataFrame(rows, "id bigint, x int, y int, z int, pore boolean")


def flooded(mask, periodic):
    nz, ny, nx = mask.shape
    label = {}
    for z, y, x in np.argwhere(mask).tolist():
        first = x + nx * (y + ny * z)
        stack = [(x, y, z)] if first not in label else []
        while stack:
            a, b, c = stack.pop()
            a, b = (a % nx if periodic[0] else a), (b % ny if periodic[1] else b)
            if not (0 <= a < nx and 0 <= b < ny and 0 <= c < nz) or not mask[c, b, a]:
                continue
            k = a + nx * (b + ny * c)
            if k in label:
                continue
            label[k] = first
            stack += [(a + 1, b, c), (a - 1, b, c), (a, b + 1, c), (a, b - 1, c), (a, b, c + 1), (a, b, c - 1)]
    return label


@pytest.mark.parametrize("block,periodic", [(2, (True, True)), (3, (False, True)), (32, (True, True))])
def test_labels_for_any_block(spark, block, periodic):
    mask = np.random.default_rng(block).random((6, 7, 8)) < 0.4
    got = {r["id"]: r["label"] for r in graph.labels(lattice_of(spark, mask), (8, 7, 6), periodic, block).collect()}
    assert got == flooded(mask, periodic)


def test_a_winding_way_through_many_blocks(spark):
    """One path of 160 voxels, which single steps along links would need 160 rounds for."""
    mask = np.zeros((1, 19, 16), bool)
    mask[0, ::2, :] = True
    mask[0, 1::4, -1] = mask[0, 3::4, 0] = True
    mask[0, -1] = False  # y doesn't close on itself
    got = graph.labels(lattice_of(spark, mask), (16, 19, 1), (False, False), 4)
    assert got.select("label").distinct().count() == 1 and got.count() == mask.sum()
    assert graph.labels(lattice_of(spark, mask & False), (16, 19, 1)).count() == 0


def test_block_components():
    rng = np.random.default_rng(2)
    for density in (0.2, 0.5, 0.9):
        mask = rng.random((5, 6, 7)) < density
        at = np.flatnonzero(mask)
        want = flooded(mask, (False, False))
        assert at[block_components(mask)].tolist() == [want[i] for i in at.tolist()]


def test_running_totals_and_the_next_value(spark):
    rng = np.random.default_rng(3)
    v = rng.permutation(400).astype(float)
    rows = spark.createDataFrame([(float(x), int(x) % 7, float(x) / 3) for x in v], "v double, a int, b double").repartition(6)
    got = ordered.running_totals(rows, ["v"], {"sa": "a", "sb": "b"}, {"after": "v", "then": "a"}).orderBy("v").collect()
    assert [r["sa"] for r in got] == np.cumsum([i % 7 for i in range(400)]).tolist()
    np.testing.assert_allclose([r["sb"] for r in got], np.cumsum([i / 3 for i in range(400)]))
    assert [r["after"] for r in got] == [*map(float, range(1, 400)), None] and [r["then"] for r in got] == [*(i % 7 for i in range(1, 400)), None]
    assert ordered.running_totals(rows.limit(0), ["v"], {"sa": "a"}, {"after": "v"}).count() == 0


def test_wasserstein_of_two_samples(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=200).round(1), rng.normal(0.5, 2, size=150).round(1)
    every = np.sort(np.concatenate([a, b]))
    want = (np.abs(np.searchsorted(np.sort(a), every[:-1], "right") / 200 - np.searchsorted(np.sort(b), every[:-1], "right") / 150) * np.diff(every)).sum()
    frames = [spark.createDataFrame([(float(x),) for x in s] + [(None,)], "v double") for s in (a, b)]
    assert statistics.wasserstein(*frames, "v").first()["distance"] == pytest.approx(want)


@pytest.mark.parametrize("n,most", [(0, 5), (1, 5), (5, 5), (6, 5), (97, 10), (100, 1), (500, 7)])
def test_even_samples(spark, n, most):
    got = sorted(r["id"] for r in voxels.evenly_sampled(spark.range(n).repartition(3), ["id"], most).collect())
    want = range(n) if n <= most else sorted({int(i * (n - 1) / (most - 1)) for i in range(most)}) if most > 1 else [0]
    assert got == list(want)


def test_strata_of_null_and_hot_groups(spark):
    rows = spark.createDataFrame([(None if i < 10 else "a", i) for i in range(200)], "g string, i int").repartition(5)
    got = {r["i"]: r["level"] for r in statistics.stratified_levels(rows, "g", ["i"], 0.5).collect()}
    assert len(got) == 200
    assert all(got[i] == pytest.approx((i + 0.5) / 10) for i in range(10)) and all(got[10 + i] == pytest.approx((i + 0.5) / 190) for i in range(190))


def test_nearest_centers_with_few_and_far_ones(spark):
    rng = np.random.default_rng(5)
    for n in (0, 1, 30):
        points, centers = rng.uniform(0, 20, (80, 2)), rng.uniform(0, 20, (n, 2))
        frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, x double, y double") for x in (points, centers)]
        got = {r["id"]: r["center"] for r in pairs.nearest_center(*frames, (20, 20), 1.0).collect()}
        d = points[:, None] - centers[None]
        d -= 20 * np.rint(d / 20)
        assert got == (dict(enumerate((d**2).sum(2).argmin(1).tolist())) if n else {})


def test_fields_of_more_units_than_travel_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    units = [(i, *map(float, rng.uniform(0, 10, 3)), float(rng.uniform(0.2, 1))) for i in range(23)]
    frame = spark.createDataFrame(units, "id int, cx double, cy double, cz double, r double").repartition(3)
    points = spark.createDataFrame([(7, *map(float, p)) for p in itertools.product((0.5, 4.0, 9.5), repeat=3)] * 2, "_point int, px double, py double, pz double")
    for sharpness in (None, 4.0):
        once = sorted((tuple(r) for r in voxels.sphere_field(points, frame, (10, 10), sharpness).collect()))
        with monkeypatch.context() as m:
            m.setattr(voxels, "BROADCAST_ROWS", 5)
            blocks = voxels.sphere_field(points.withColumnRenamed("_point", "tag"), frame, (10, 10), sharpness)
            np.testing.assert_allclose(sorted(tuple(r) for r in blocks.collect()), once, rtol=1e-12)
    assert voxels.sphere_field(points, frame.limit(0), (10, 10)).agg(F.min("sdf")).first()[0] == float("inf")


def test_dense_centers_are_searched_in_narrow_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points, centers = rng.uniform(0, 20, (150, 2)), np.concatenate([rng.uniform(0, 20, (400, 2)), np.full((100, 2), 7.0)])
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, x double, y double") for x in (points, centers)]
    met, joined = [], pairs.joined_within
    monkeypatch.setattr(pairs, "joined_within", lambda *args: met.append(joined(*args).count()) or joined(*args))
    got = {r["id"]: r["center"] for r in pairs.nearest_center(*frames, (20, 20), 8.0).collect()}
    d = points[:, None] - centers[None]
    d -= 20 * np.rint(d / 20)
    assert got == dict(enumerate((d**2).sum(2).argmin(1).tolist())) and sum(met) < 20 * len(points)
