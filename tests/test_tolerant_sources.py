"""Scenes with placed, scaled and mirrored nodes; configurations with several faults."""

import json
import struct

import numpy as np
import pytest
import yaml
from test_operators import minimal

from voxlake.functions import kernels as K
from voxlake.operators import mesh
from voxlake.sources import config, files


def scene_of(nodes, shown=None, views=None, accessors=None, primitives=None, body=None):
    """A glTF of one unit cube mesh, with interleaved positions (a stride of 16 bytes)."""
    v, f = K.surface(np.ones((1, 1, 1), bool))
    points = np.zeros((len(v), 4), "<f4")
    points[:, :3] = v
    index = f.astype("<u2")
    raw = points.tobytes() + index.tobytes() if body is None else body
    scene = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": shown if shown is not None else [0]}], "nodes": nodes, "buffers": [{"byteLength": len(raw)}],
        "meshes": [{"primitives": primitives or [{"attributes": {"POSITION": 0}, "indices": 1}]}],
        "bufferViews": views or [{"buffer": 0, "byteOffset": 0, "byteLength": points.nbytes, "byteStride": 16}, {"buffer": 0, "byteOffset": points.nbytes, "byteLength": index.nbytes}],
        "accessors": accessors or [{"bufferView": 0, "componentType": 5126, "count": len(v), "type": "VEC3"}, {"bufferView": 1, "componentType": 5123, "count": index.size, "type": "SCALAR"}],
    }
    text = json.dumps(scene).encode()
    text += b" " * (-len(text) % 4)
    raw += b"\0" * (-len(raw) % 4)
    chunks = struct.pack("<II", len(text), 0x4E4F534A) + text + struct.pack("<II", len(raw), 0x004E4942) + raw
    return struct.pack("<III", 0x46546C67, 2, 12 + len(chunks)) + chunks


def extent(raw):
    v, f = files.read_glb(raw)
    return v.min(axis=0).round(6).tolist(), v.max(axis=0).round(6).tolist(), K.mesh_volume(v, f)


def test_nodes_place_scale_and_turn():
    size = extent(scene_of([{"mesh": 0}]))
    assert size[0] == [0, 0, 0] and size[1] == [1, 1, 1]
    low, high, volume = extent(scene_of([{"mesh": 0, "translation": [10, 0, -2], "scale": [2, 3, 4]}]))
    assert (low, high) == ([10, 0, -2], [12, 3, 2]) and volume == pytest.approx(24 * size[2])
    half = 2**-0.5
    low, high, _ = extent(scene_of([{"mesh": 0, "rotation": [0, 0, half, half], "translation": [5, 0, 0]}]))  # x to y
    assert (low, high) == ([4, 0, 0], [5, 1, 1])
    nested = [{"children": [1, 2], "translation": [1, 1, 1]}, {"mesh": 0, "scale": [2, 2, 2]}, {"children": [3], "matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 7, 0, 0, 1]}, {"mesh": 0}, {"mesh": 0, "translation": [99, 0, 0]}]
    low, high, volume = extent(scene_of(nested))
    assert (low, high) == ([1, 1, 1], [9, 3, 3]) and volume == pytest.approx(9 * size[2])  # the node outside the scene isn't shown


def test_mirrored_nodes_face_outwards():
    assert extent(scene_of([{"mesh": 0, "scale": [-1, 1, 1]}]))[2] > 0


def test_strips_fans_and_missing_indices():
    square = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], "<f4").tobytes()
    views, accessors = [{"buffer": 0, "byteLength": 48}], [{"bufferView": 0, "componentType": 5126, "count": 4, "type": "VEC3"}]
    for mode, n in ((4, 1), (5, 2), (6, 2), (0, 0)):
        v, f = files.read_glb(scene_of([{"mesh": 0}], None, views, accessors, [{"attributes": {"POSITION": 0}, "mode": mode}], square))
        assert len(f) == n
        if mode == 5:
            assert (np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])[:, 2] > 0).all()


def test_scenes_as_rows(spark, tmp_path):
    (tmp_path / "good.glb").write_bytes(scene_of([{"mesh": 0, "translation": [3, 0, 0]}]))
    (tmp_path / "loop.glb").write_bytes(scene_of([{"mesh": 0, "children": [0]}]))
    (tmp_path / "bad.glb").write_bytes(b"nothing of the kind")
    (tmp_path / "short.glb").write_bytes(scene_of([{"mesh": 0}], None, [{"buffer": 0, "byteLength": 8}], [{"bufferView": 0, "componentType": 5126, "count": 400, "type": "VEC3"}], [{"attributes": {"POSITION": 0}}]))
    rows = files.scene_triangles(spark, str(tmp_path)).cache()
    assert {r["file"].split("/")[-1] for r in rows.where("error is not null").collect()} == {"loop.glb", "bad.glb", "short.glb"}
    good = rows.where("error is null")
    points = spark.createDataFrame([(0, 3.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5)], "id int, x double, y double, z double")
    assert {r["id"]: r["inside"] for r in mesh.inside(points, good).collect()} == {0: True, 1: False}


def test_two_faults_give_two_rows_and_the_good_values(spark, tmp_path):
    raw = minimal()
    raw["task"]["colour"] = "red"
    raw["audit"] = {"fine_spacing_A": {"x": "wide"}} if isinstance(raw.get("audit", {}).get("fine_spacing_A"), dict) else {"fine_spacing_A": "wide"}
    got, good, issues = config.collected(raw)
    assert len(issues) == 2 and {p.split(".")[0] for p, _ in issues} == {"task", "audit"}
    assert good["task"] == minimal()["task"] and (got is None or got["task"]["name"] == minimal()["task"]["name"])
    assert config.collected(minimal()) == (config.checked(minimal()), minimal(), [])
    assert config.collected([1])[2] and config.collected({})[0] is None
    (tmp_path / "two.yaml").write_text(yaml.safe_dump(raw))
    (tmp_path / "good.yaml").write_text(yaml.safe_dump(minimal()))
    (tmp_path / "torn.yaml").write_text(yaml.safe_dump(minimal()) + "\nbroken: [1, 2\nlast: {a: 1}\n")
    rows = {}
    for r in config.scanned(spark, str(tmp_path)).collect():
        rows.setdefault(r["file"].split("/")[-1], []).append(r["place"])
    assert len(rows["two.yaml"]) == 2 and "good.yaml" not in rows and "broken" in rows["torn.yaml"]


def test_missing_without_a_default_is_said_once():
    raw = minimal()
    del raw["task"]["name"]
    got, _, issues = config.collected(raw)
    assert got is None and [p for p, _ in issues] == ["task.name"]
