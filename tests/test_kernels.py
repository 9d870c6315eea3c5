import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxlake.functions import distributions as D
from voxlake.functions import fields, kernels as K


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31))
def test_distances_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random(tuple(rng.integers(2, 8, 2))) < 0.7
    got, solid = K.squared_distances(mask, (True, True)), np.argwhere(~mask)
    for y, x in np.argwhere(mask):
        if len(solid):
            d = np.abs(solid - [y, x])
            d = np.minimum(d, np.array(mask.shape) - d)
            assert got[y, x] == (d**2).sum(axis=1).min()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 6, tuple(rng.integers(1, 6, 2))).astype(float)
    wide = cost if cost.shape[0] <= cost.shape[1] else cost.T
    best = min(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
    pairs = K.assignment(cost)
    assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == min(cost.shape)


def cylinder():
    y, x = np.mgrid[0:10, 0:10]
    return (x - 3.5) ** 2 + (y - 5.5) ** 2 <= 1.8**2


def test_cylinder_center_and_section():
    mask = np.repeat(cylinder()[None], 10, 0)
    assert mask.mean() == 0.12
    assert K.slice_centers(mask[0], 1.0, 1.0) == [(4.0, 6.0, pytest.approx(math.sqrt(2)))]
    contract = {"boundary_resample_spacing_A": 0.5, "center_min_separation_A": 1.0, "curvature_smoothing_length_A": 1.0}
    got = K.normal_section(mask, np.array([4.0, 6.0, 5.0]), np.array([0, 0, 1.0]), 1.4, contract, 1.0, np.zeros(3))
    assert got["valid"] and got["diameter"] == pytest.approx(3.888, rel=0.2)  # sample points on the border make it sensitive


def test_centers_follow_a_periodic_shift():
    base = K.slice_centers(cylinder(), 1.0, 1.0)[0]
    moved = K.slice_centers(np.roll(cylinder(), 7, axis=1), 1.0, 1.0)[0]
    assert (moved[0] - base[0] - 7) % 10 == pytest.approx(0, abs=1e-9) and moved[1] == pytest.approx(base[1])


def test_section_outside_and_unbounded():
    contract = {"boundary_resample_spacing_A": 0.5, "center_min_separation_A": 1.0, "curvature_smoothing_length_A": 1.0}
    solid = np.zeros((6, 6, 6), bool)
    assert K.normal_section(solid, np.array([3.0, 3, 3]), np.array([0, 0, 1.0]), 1, contract, 1.0, np.zeros(3))["invalid_reason"] == "center_not_in_pore"
    assert K.normal_section(~solid, np.array([3.0, 3, 3]), np.array([0, 0, 1.0]), 1, contract, 1.0, np.zeros(3))["invalid_reason"] == "cross_section_not_bounded"


def test_contour_area_of_a_disc():
    disc = np.hypot(*(np.mgrid[0:61, 0:61] - 30.0)) < 20
    rings = K.contours(disc.astype(float))
    assert len(rings) == 1 and abs(K.polygon_area(rings[0])) == pytest.approx(math.pi * 400, rel=0.03)
    assert K.curvature_fluctuation(np.stack([np.cos(t := np.linspace(0, 2 * np.pi, 90, endpoint=False)), np.sin(t)], 1) * 10, 0.5, 1.0) < 0.02


def test_surface_is_closed_and_encloses():
    mask = np.repeat(cylinder()[None], 10, 0)
    v, f = K.surface(mask)
    edges = np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), axis=1)
    assert (np.unique(edges, axis=0, return_counts=True)[1] == 2).all()
    assert K.mesh_volume(v, f) == pytest.approx(120, rel=0.05)
    centres = np.argwhere(np.ones_like(mask))[:, ::-1] + 0.5
    assert (K.inside_mesh(v, f, centres) == mask.ravel()).mean() > 0.99


def test_glb_round_trip_and_occupancy():
    from voxlake.sources import files

    mask = np.repeat(cylinder()[None], 10, 0)
    v, f = K.surface(mask)
    v2, f2 = files.read_glb(files.glb(v, f, {"name": "x"}))
    assert np.allclose(v, v2, atol=1e-5) and (f == f2).all()
    assert files.mesh_occupancy_mismatch(v2, f2, mask, 1.0) < 0.01
    assert files.ply(v, f).splitlines()[2] == f"element vertex {len(v)}"
    v3, f3 = files.cleaned_mesh(np.concatenate([v, v]), np.concatenate([f, f + len(v), [[0, 0, 1]]]))
    assert len(f3) <= len(f) and len(v3) <= len(v)


def test_local_thickness_of_a_ball_and_a_slab():
    z, y, x = np.mgrid[0:15, 0:15, 0:15] - 7
    ball = x * x + y * y + z * z <= 25
    got = K.local_thickness(ball, periodic=(False, False, False))
    assert got[7, 7, 7] == got.max() and got[ball].min() > 0
    slab = np.zeros((9, 6, 6), bool)
    slab[2:7] = True
    assert (K.local_thickness(slab)[slab] == 6).all()  # distances are between cell centres


def test_tracks_branch_and_end():
    box = (10.0, 10.0)
    slices = [(0, 0.5, [(9.5, 5, 1)]), (1, 1.5, [(0.4, 5, 1)]), (2, 2.5, [(0.0, 5, 1), (1.2, 5, 1)]), (3, 3.5, []), (4, 4.5, [(0.5, 5, 1)])]
    points, events = K.linked_tracks(slices, box, 1.5)
    first = [p for p in points if p["track_id"] == 0]
    assert [p["z_index"] for p in first] == [0, 1, 2] and first[1]["x"] == pytest.approx(10.4)
    assert events == 1 and first[2]["branch"] and {p["track_id"] for p in points} == {0, 1, 2}


def test_spline_smoothing_and_segments():
    x = np.linspace(0, 1, 6)
    t = np.linspace(0, 1, 40)
    assert np.allclose(K.cubic_spline(x, np.stack([x**3 - x, x**2], 1), t), np.stack([t**3 - t, t**2], 1))
    line = np.stack([t, 2 * t, 3 * t], 1)
    assert np.allclose(K.smoothed(line)[5:-5], line[5:-5])
    assert K.segment_distance(np.array([0.0, 0, 0]), np.array([1.0, 0, 0]), np.array([0.5, -1, 1]), np.array([0.5, 1, 1])) == pytest.approx(1)
    assert K.kabsch_rmsd(line, line[:, [1, 2, 0]]) < 1.0 and K.nonplanarity(np.random.default_rng(0).random((9, 3)) * [1, 1, 0]) < 1e-9


@pytest.mark.parametrize("a, b", [(2.0, 3.0), (0.7, 1.4), (9.0, 2.0)])
def test_special_functions_by_integration(a, b):
    t = np.linspace(0, 0.4, 200001)[1:]
    density = t ** (a - 1) * (1 - t) ** (b - 1) * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    assert D.beta_cdf(np.array([0.4]), a, b)[0] == pytest.approx(np.trapezoid(density, t), abs=2e-3)
    assert D.gamma_cdf(np.array([0.5, 3.0]), 1.0) == pytest.approx([1 - math.exp(-0.5), 1 - math.exp(-3)])
    q = np.array([0.01, 0.3, 0.99])
    assert D.beta_cdf(D.quantile({"family": "beta", "alpha": a, "beta": b}, q), a, b) == pytest.approx(q, abs=1e-12)
    assert D.gamma_cdf(D.quantile({"family": "gamma", "alpha": a}, q), a) == pytest.approx(q, abs=1e-12)


def test_mixture_apportionment_and_readings():
    assert D.apportioned([0.6, 0.3, 0.1], 17) == [10, 5, 2]
    mixture = {"family": "mixture", "components": [{"family": "constant", "value": 1, "weight": 1}, {"family": "constant", "value": 3, "weight": 3}]}
    assert D.cdf(mixture, np.array([0.0, 1, 2, 3])).tolist() == [0, 0.25, 0.25, 1]
    assert D.target_values(mixture, 4).tolist() == [1, 3, 3, 3]
    assert D.cdf({"family": "weibull", "shape": 1.5, "value": 2.0}, np.array([1.0, 3.0]), "validator").tolist() == [0, 1]
    with pytest.raises(ValueError):
        D.cdf({"family": "uniform", "low": 0, "high": 1}, np.array([0.5]))
    assert D.compared(np.array([]), mixture, 1, 1) == {"ks": math.inf, "distance": math.inf, "passed": False}
    sample = D.stratified_sample({"family": "weibull", "shape": 2.0, "scale": 1.0}, 400, np.random.default_rng(0))
    assert D.compared(sample, {"family": "weibull", "shape": 2.0, "scale": 1.0}, 0.02, 0.02)["passed"]


def test_fields():
    rng = np.random.default_rng(1)
    points = rng.random((400, 3)) * 12 - 2
    tube = fields.Channel("u", np.array([[0, 0, 0], [2, 1, 3], [3, 3, 6], [3, 2, 9.0]]), np.array([1, 0.8, 0.9, 1.0]), 0.05)
    assert np.abs(tube.field(points) - tube.brute_field(points)).max() <= 1e-9
    ball = fields.Compact("s", np.array([5.0, 5, 5]), np.array([2.0, 2, 2]))
    assert ball.field(np.array([[5.0, 5, 5], [9, 5, 5]])) == pytest.approx([-2, 2])
    for unit in (tube, ball, fields.Compact("e", np.array([5.0, 5, 5]), np.array([1.0, 1, 3]), 4.0, rough=0.02)):
        step = rng.normal(size=points.shape) * 1e-5
        slope = np.abs(unit.field(points + step) - unit.field(points)) / np.linalg.norm(step, axis=1)
        assert np.nanquantile(slope, 0.97) <= unit.slope() * 1.01
    box = (6.0, 6.0, 6.0)
    edge = fields.Compact("p", np.array([0.1, 3, 3]), np.array([1.0, 1, 1]))
    assert fields.periodic_field(edge, np.array([[5.9, 3, 3], [3.0, 3, 3]]), box)[0] < 0
    lobes = fields.Compact("m", np.zeros(3), np.ones(3), lobes=np.array([[-0.5, 0, 0], [0.5, 0, 0]]), lobe_radii=np.ones((2, 3)), blend=0.1)
    assert lobes.field(np.zeros((1, 3)))[0] <= -0.5


def test_candidate_phase_has_its_porosity_and_batches_do_not_matter():
    from voxlake.plans import generate
    from voxlake.plans.kernels import CONFIG

    units, mask = generate.evaluate(CONFIG, 5)
    assert abs(mask.mean() - CONFIG["porosity"]) <= 0.01
    assert (generate.voxelised(units, (10, 10, 10), 1.0, 37) == mask).all()
    assert (generate.evaluate(CONFIG, 5)[1] == mask).all()
    box = (10.0, 10.0, 10.0)
    edges = np.linspace(0, 5, 6)
    start = generate.lattice_centers(12, box, "fcc", 0.4, np.random.default_rng(0))
    assert len(start) == 12 and (start[:, 2] <= 10).all()
    reference = generate.uniform_reference(12, box, edges)
    loss = lambda p: ((generate.pair_curve(p, box, edges, reference) - np.ones(5)) ** 2).mean()
    assert loss(generate.annealed_centers(start, box, edges, np.ones(5), np.random.default_rng(0), 6)) <= loss(start)


def test_triplet_queries_use_whole_vectors(spark, tmp_path):
    from voxlake.plans import kernels as plans

    rng = np.random.default_rng(1)
    whole = {i: rng.normal(size=64).tolist() for i in range(3)}
    whole[3] = rng.normal(size=13).tolist()
    odd = {10: None, 11: [], 12: [1.0, 2.0], 13: [None] + [1.0] * 63, 14: [float("nan")] * 64}
    spark.createDataFrame([*whole.items(), *odd.items()], "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    rmsd = {r["vec_id"]: r["rmsd"] for r in plans.kabsch_rmsd(spark, str(tmp_path)).collect()}
    flat = {r["vec_id"]: r["nonplanarity"] for r in plans.nonplanarity(spark, str(tmp_path)).collect()}
    for i, v in whole.items():
        p = np.array(v[: len(v) // 3 * 3]).reshape(-1, 3)
        n = len(p)
        assert rmsd[i] == round(K.kabsch_rmsd(p[: n - n // 2], p[n // 2 :]), 6) and flat[i] == round(K.nonplanarity(p), 6)
    assert all(rmsd[i] is None and flat[i] is None for i in odd) and len(rmsd) == len(flat) == 9
