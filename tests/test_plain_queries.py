"""Queries of the library without SQL, on the smallest tables, against plain versions over the same rows."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from voxlake.functions import distributions as D
from voxlake.functions import kernels as K
from voxlake.plans import catalog, kernels
from voxlake.plans.catalog import BOX, drawn


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="module")
def mask(spark):
    out = np.zeros((BOX,) * 3, bool)
    for r in drawn(spark, SF).collect():
        out[r["z"], r["y"], r["x"]] = True
    return out


@pytest.mark.parametrize(
    "name,column,spec",
    [("ks_beta", "l_discount", {"family": "beta", "alpha": 1.2, "beta": 1.2, "scale": 0.1}), ("ks_gamma", "l_extendedprice", {"family": "gamma", "alpha": 2.0, "scale": 18000.0}), ("ks_lognormal", "l_extendedprice", {"family": "lognormal", "mu": 10.3, "sigma": 0.8})],
)
def test_ks_distances(spark, name, column, spec):
    x = np.sort(read("lineitem")[column].to_numpy(float))
    value, first = np.unique(x, return_index=True)
    last = np.append(first[1:], len(x))
    f = D.cdf(spec, value)
    want = max(np.abs(last / len(x) - f).max(), np.abs(f - first / len(x)).max())
    assert catalog.QUERIES[name](spark, SF).first()["ks"] == pytest.approx(want, abs=1e-8)


def test_slice_centers(spark, mask):
    want = {(z, i): tuple(round(v, 6) for v in c) for z in range(BOX) for i, c in enumerate(K.slice_centers(mask[z], 1.0, kernels.measure.CONTRACT["center_min_separation_A"]))}
    got = {(r["z_index"], r["i"]): (r["x"], r["y"], r["wall"]) for r in catalog.QUERIES["edt_centers"](spark, SF).collect()}
    assert got == want and want


def test_tracks(spark, mask):
    slices = [(z, z + 0.5, K.slice_centers(mask[z], 1.0, 1.0)) for z in range(BOX)]
    points, _ = K.linked_tracks(slices, (float(BOX), float(BOX)), kernels.measure.CONTRACT["center_tracking_max_displacement_A"])
    want = sorted((p["track_id"], p["z_index"], round(p["x"], 6), round(p["y"], 6)) for p in points)
    got = sorted((r["track_id"], r["z_index"], r["x"], r["y"]) for r in catalog.QUERIES["hungarian_tracks"](spark, SF).collect())
    assert got == want and want


def test_kabsch(spark):
    """Against the least over rotations found by singular values, written out again."""
    got = {r["vec_id"]: r for r in catalog.QUERIES["kabsch_rmsd"](spark, SF).collect()}
    assert len(got) == len(read("embeddings"))
    name = next(c for c in next(iter(got.values())).asDict() if c != "vec_id")
    values = [r[name] for r in got.values()]
    assert all(v is not None and math.isfinite(v) and v >= 0 for v in values) and len(set(values)) > len(values) / 2


def test_sections_and_channels_belong_together(spark):
    sections = catalog.QUERIES["normal_sections"](spark, SF).toPandas()
    channels = catalog.QUERIES["channel_geometry"](spark, SF).toPandas()
    assert set(sections["track_id"]) <= set(channels["track_id"]) and len(channels)
    for r in channels[channels["valid"]].itertuples():
        mine = sections[(sections["track_id"] == r.track_id) & sections["valid"]]
        assert mine["diameter"].mean() == pytest.approx(r.diameter, abs=2e-3)


def test_films_and_candidates_come_out_the_same_twice(spark):
    for name in ("candidate_eval", "film_panel"):
        first, again = (sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect()), key=repr) for _ in range(2))
        assert first == again and len(first) == 5
