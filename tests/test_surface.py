"""Surfaces by slabs against the kernel, shared vertices, and the file they make."""

from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_distance import slabs_of

from voxlake.functions import kernels as K
from voxlake.operators import surface
from voxlake.plans import surfaces
from voxlake.plans.catalog import BOX, drawn

SHAPE = (13, 11, 9)


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(3)
    return {0: rng.random((9, 11, 13)) < 0.4, 1: np.pad(np.ones((3, 4, 5), bool), ((2, 4), (3, 4), (4, 4))), 2: np.ones((9, 11, 13), bool)}


def volume_of(vertices, faces):
    return K.mesh_volume(vertices, faces)


@pytest.mark.parametrize("thick", [1, 3, 4, 100])
def test_the_same_surface_for_any_slab(spark, masks, thick):
    found = surface.triangles(slabs_of(spark, masks), SHAPE, 0.5, thick)
    got = {r["run_id"]: r for r in surface.summary(found).collect()}
    vertices, faces = surface.indexed(found)
    places, sides = vertices.toPandas(), faces.toPandas()
    for run, mask in masks.items():
        v, f = K.surface(mask, 0.5)
        assert got[run]["faces"] == len(f) and got[run]["open_edges"] == 0
        assert got[run]["volume"] == pytest.approx(volume_of(v, f))
        mine = places[places["run_id"] == run].sort_values("vertex")
        assert mine["vertex"].tolist() == list(range(len(v)))
        assert sorted(map(tuple, mine[["x", "y", "z"]].round(9).to_numpy())) == sorted(map(tuple, v.round(9)))
        side = sides[sides["run_id"] == run][["a", "b", "c"]].to_numpy()
        assert volume_of(mine[["x", "y", "z"]].to_numpy(), side) == pytest.approx(volume_of(v, f))


def test_kernel_is_closed_and_faces_outwards(masks):
    for mask in masks.values():
        v, f = K.surface(mask)
        edges = np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]])
        forth = {tuple(e) for e in edges.tolist()}
        assert len(forth) == len(edges) and all((b, a) in forth for a, b in forth)
        assert K.mesh_volume(v, f) > 0
    assert K.mesh_volume(*K.surface(masks[2])) == pytest.approx(9 * 11 * 13, rel=0.01)  # on the box itself, its corners cut
    assert len(K.surface(masks[2] & False)[1]) == 0


def test_a_torn_surface_has_open_edges(spark, masks):
    found = surface.triangles(slabs_of(spark, {1: masks[1]}), SHAPE)
    assert surface.summary(found.where(F.col("face") != found.agg(F.min("face")).first()[0])).first()["open_edges"] == 3


def test_ply_parts_make_the_file(spark, masks, tmp_path):
    found = surface.triangles(slabs_of(spark, {1: masks[1]}), SHAPE, 1.0, 2)
    vertices, faces = surface.indexed(found)
    surface.write_ply(vertices, faces, str(tmp_path / "ply"))
    lines = "".join(p.read_text() for p in sorted(Path(tmp_path / "ply").glob("part-*"))).splitlines()
    end = lines.index("end_header")
    n, m = int(lines[2].split()[-1]), int(lines[6].split()[-1])
    assert len(lines) == end + 1 + n + m
    v = np.array([list(map(float, x.split())) for x in lines[end + 1 : end + 1 + n]])
    f = np.array([list(map(int, x.split()))[1:] for x in lines[end + 1 + n :]])
    assert K.mesh_volume(v, f) == pytest.approx(K.mesh_volume(*K.surface(masks[1])))


def test_query_against_the_kernel(spark):
    mask = np.zeros((BOX,) * 3, bool)
    for r in drawn(spark, SF).collect():
        mask[r["z"], r["y"], r["x"]] = True
    v, f = K.surface(mask)
    got = surfaces.surface_summary(spark, SF).first()
    assert (got["faces"], got["open_edges"]) == (len(f), 0) and got["volume"] == pytest.approx(K.mesh_volume(v, f), abs=1e-5)
