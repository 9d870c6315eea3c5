import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.functions import fields, shapes
from voxlake.functions.fields import Channel



def test_nearest_on_mesh_has_no_cap():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(15000, 3))
    f = np.arange(15000).reshape(-1, 3)
    p = rng.normal(size=(2100, 3))
    where, d = shapes.nearest_on_mesh(v, f, p)
    parts = [shapes.nearest_on_mesh(v, f[k : k + 1000], p[:40]) for k in range(0, 5000, 1000)]
    assert np.allclose(d[:40], np.min([q for _, q in parts], axis=0)) and np.allclose(np.linalg.norm(where - p, axis=1), d)


def test_roughness_stays_in_its_bounds():
    at = np.random.default_rng(2).normal(size=(20000, 3))
    step = 1e-5 * np.array([0.6, 0.0, 0.8])
    one, other = fields.roughness("u", 0.1, 5.0, at), fields.roughness("u", 0.1, 5.0, at + step)
    assert np.abs(one).max() <= 0.5 and one.std() > 0.05 and (fields.roughness("u", 0.1, 5.0, at) == one).all()
    assert np.abs(other - one).max() / 1e-5 <= fields.roughness_slope(0.1, 5.0, 1.0)
    assert not np.allclose(one, fields.roughness("v", 0.1, 5.0, at)) and not fields.roughness("u", 0.0, 5.0, at).any()


def test_shapes_keep_their_limits():
    body = shapes.lobed("a", 500.0, 1.6, 3)
    assert shapes.sampled_volume(body, shapes.envelope(body)) == pytest.approx(500, rel=0.03) and shapes.lobes_connected(body.lobes, body.lobe_radii)
    assert not shapes.shape_issues({"volume": 500.0}, body=body) and shapes.shape_issues({"volume": 900.0}, body=body)
    tube = shapes.winding("b", 300.0, 6.0, 1.2, 5)
    assert tube.volume() == pytest.approx(300) and tube.arc[-1] / np.linalg.norm(tube.points[-1] - tube.points[0]) == pytest.approx(1.2, rel=1e-3)
    record = {"volume": 300.0} | shapes.radius_record(tube)
    assert not shapes.shape_issues(record, tube=tube) and shapes.shape_issues(record | {"bend_count": 99}, tube=tube)
    assert (shapes.winding("b", 300.0, 6.0, 1.2, 5).points == tube.points).all()


def test_monotone_cubic_and_mesh_distance():
    x, y = np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 1, 5])
    t = np.linspace(0, 3, 200)
    v = shapes.monotone_cubic(x, y, t)
    assert (np.diff(v) >= -1e-12).all() and shapes.monotone_cubic(x, y, x) == pytest.approx(y)
    v, f = K.surface(np.ones((4, 4, 4), bool))
    where, d = shapes.nearest_on_mesh(v, f, np.array([[2.0, 2, 7.0], [2.0, 2, 2.0]]))
    assert d == pytest.approx([3, 2]) and where[0] == pytest.approx([2, 2, 4])
    with pytest.raises(ValueError):
        shapes.nearest_on_mesh(v, f, np.zeros((10, 3)), 5)


def test_phase_round_trip_and_command_line(spark, tmp_path, capsys):
    from voxlake.__main__ import main
    from voxlake.sources import phase

    at = spark.range(1000).select((F.col("id") % 10).cast("int").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("int").alias("y"), F.floor(F.col("id") / 100).cast("int").alias("z"))
    voxels = at.withColumn("pore", (F.col("x") - 3.5) * (F.col("x") - 3.5) + (F.col("y") - 5.5) * (F.col("y") - 5.5) <= 1.8**2)
    path = str(tmp_path / "phase")
    phase.write_phase(voxels, path, (10, 10, 10), 1.0)
    back, meta = phase.read_phase(spark, path)
    assert back.where("pore").count() == 120 and meta["shape"] == [10, 10, 10]
    assert {r["code"] for r in phase.phase_issues(voxels.union(voxels.limit(1)), meta).collect()} == {"voxel_count", "voxel_repeated"}
    assert main(["measure", path]) == 0 and main(["validate", path]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["status"] == "PASS"


def test_validate_reads_what_is_there_and_by_its_contract(spark, tmp_path, capsys):
    import shutil

    from voxlake.__main__ import main
    from voxlake.plans import measure
    from voxlake.sources import phase

    at = spark.range(1000).select((F.col("id") % 10).cast("int").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("int").alias("y"), F.floor(F.col("id") / 100).cast("int").alias("z"))
    voxels = at.withColumn("pore", (F.col("x") - 3.5) * (F.col("x") - 3.5) + (F.col("y") - 5.5) * (F.col("y") - 5.5) <= 1.8**2)
    path = str(tmp_path / "phase")
    phase.write_phase(voxels, path, (10, 10, 10), 1.0, contract={"cross_section_spacing_A": 2.0})

    def report():
        code = main(["validate", path])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert main(["measure", path]) == 0
    plain = measure.measure(voxels.withColumn("run_id", F.lit(0)), (10, 10, 10))["sections"].count()
    assert 0 < spark.read.parquet(f"{path}/measurement/sections").count() < plain
    assert report()[0] == 0
    altered = spark.read.parquet(f"{path}/measurement/porosity").withColumn("porosity", F.lit(0.5))
    altered.write.parquet(str(tmp_path / "altered"))
    shutil.move(f"{path}/measurement/porosity", str(tmp_path / "porosity"))
    shutil.copytree(str(tmp_path / "altered"), f"{path}/measurement/porosity")
    assert report()[1]["status"] == "FAIL"
    for n, (table, entry) in enumerate([("porosity", "measurements"), ("sections", "cross_sections"), ("contract", "contract")], 1):
        shutil.move(f"{path}/measurement/{table}", str(tmp_path / f"away-{table}"))
        code, got = report()
        assert code == 1 and got["status"] == "NOT_EVALUABLE" and entry in got["missing"] and len(got["missing"]) == n


def test_curves(spark):
    from voxlake.sources import phase

    units = spark.createDataFrame([("a", "channel"), ("b", "channel"), ("c", "compact")], "unit_id string, kind string")
    tube = Channel("a", np.array([[0, 0, 0], [0, 0, 2.0], [0, 1.0, 4]]), np.array([1, 2, 1.0]))
    rows = [("a", i, *map(float, p), float(r)) for i, (p, r) in enumerate(zip(tube.points, tube.radius, strict=True))] + [("z", 0, 0.0, 0.0, 0.0, -1.0), ("z", 1, 0.0, 0.0, 0.0, 1.0)]
    curves = spark.createDataFrame(rows, "unit_id string, idx int, x double, y double, z double, radius double")
    assert {(r["unit_id"], r["code"]) for r in phase.curve_issues(units, curves).collect()} == {("b", "missing_curve"), ("z", "curve_without_unit")}
    assert {r["unit_id"]: r["volume"] for r in phase.curve_volumes(curves).collect()}["a"] == pytest.approx(tube.volume())
    other = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "unit_id string, v double")
    assert {r["unit_id"]: r["v"] for r in phase.with_fallback(other.where("unit_id = 'a'"), other, ["unit_id"], "v").collect()} == {"a": 1.0, "b": 2.0}
    assert phase.unit_rows(other).orderBy("unit_id").first()["v"] == "1.0000000000"
