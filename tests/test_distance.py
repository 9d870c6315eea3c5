"""Distances and thickness by tiles and blocks against the kernels that hold a run whole."""

import numpy as np
import pandas as pd
import pytest

from voxlake.functions import kernels as K
from voxlake.operators import distance


def slabs_of(spark, masks):
    rows = [(run, z, np.packbits(m[z]).tobytes()) for run, m in masks.items() for z in range(len(m)) if m[z].any()]
    return spark.createDataFrame(rows, "run_id int, z int, mask binary").repartition(3)


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(1)
    at = np.stack(np.meshgrid(np.arange(9), np.arange(11), np.arange(13), indexing="ij"), axis=-1)
    balls = np.zeros((9, 11, 13), bool)
    for c, r in zip(rng.uniform(0, [9, 11, 13], (6, 3)), rng.uniform(1.5, 4, 6), strict=True):
        d = np.abs(at - c)
        d[..., 1:] = np.minimum(d[..., 1:], [11, 13] - d[..., 1:])
        balls |= (d**2).sum(-1) < r * r
    return {0: balls, 1: rng.random((9, 11, 13)) < 0.8, 2: ~(np.arange(9 * 11 * 13).reshape(9, 11, 13) == 700)}


@pytest.mark.parametrize("cells,periodic", [(1 << 21, (True, True)), (9 * 16, (True, True)), (9, (False, True)), (9 * 25, (False, False))])
def test_distances_for_any_tile(spark, masks, cells, periodic):
    got = distance.squared_distances(slabs_of(spark, masks), (13, 11, 9), periodic, cells).toPandas()
    for run, mask in masks.items():
        want = K.squared_distances(mask, (False, periodic[1], periodic[0]))
        mine = got[got["run_id"] == run]
        assert len(mine) == mask.sum()
        assert (want[mine["z"], mine["y"], mine["x"]] == mine["d2"]).all()


@pytest.mark.parametrize("block,periodic", [(4, (True, True)), (5, (False, True)), (32, (True, True))])
def test_thickness_for_any_block(spark, masks, block, periodic):
    got = distance.local_thickness(slabs_of(spark, masks), (13, 11, 9), 0.5, periodic, block).toPandas()
    for run, mask in masks.items():
        want = K.local_thickness(mask, 0.5, (False, periodic[1], periodic[0]))
        mine = got[got["run_id"] == run]
        assert len(mine) == mask.sum()
        np.testing.assert_allclose(want[mine["z"], mine["y"], mine["x"]], mine["diameter"])


def test_balls_inside_others_go(spark):
    """Between two plates the balls about the middle plane hold all others."""
    plates = np.zeros((9, 11, 13), bool)
    plates[1:8] = True
    found = distance.squared_distances(slabs_of(spark, {0: plates}), (13, 11, 9))
    kept = distance.largest_balls(found, (13, 11, 9), block=4).toPandas()
    assert len(kept) == 11 * 13 and (kept["z"] == 4).all() and (kept["d2"] == 16).all()


def test_runs_without_solid_or_pores(spark):
    full = slabs_of(spark, {5: np.ones((2, 3, 4), bool)})
    assert distance.squared_distances(full, (4, 3, 2)).where("d2 is not null").count() == 0
    thick = distance.local_thickness(full, (4, 3, 2)).toPandas()
    assert len(thick) == 24 and (thick["diameter"] == 0).all()
    assert distance.local_thickness(full.limit(0), (4, 3, 2)).count() == 0
    assert distance.squared_distances(full.where("z = 0"), (4, 3, 2)).toPandas()["d2"].tolist() == [1] * 12  # a slice that isn't there is solid
    assert isinstance(thick, pd.DataFrame)
