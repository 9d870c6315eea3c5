import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import kernels
from voxlake.operators import graph, molecules, ordered, pairs, reconcile, scaling, statistics, tracks, voxels
from voxlake.plans import audit, catalog, generate, measure, validate
from voxlake.sources import config, files, text


def cylinder_voxels(spark):
    rows = spark.range(1000).select(F.lit(0).alias("run_id"), (F.col("id") % 10).cast("int").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("int").alias("y"), F.floor(F.col("id") / 100).cast("int").alias("z"))
    return rows.withColumn("pore", (F.col("x") - 3.5) * (F.col("x") - 3.5) + (F.col("y") - 5.5) * (F.col("y") - 5.5) <= 1.8**2)


def test_golden_cylinder(spark):
    out = measure.measure(cylinder_voxels(spark), (10, 10, 10))
    assert out["porosity"].collect()[0]["porosity"] == pytest.approx(0.12)
    assert out["through"].count() == 1
    cuts = out["sections"].collect()
    assert len(cuts) == 8 and all(r["valid"] for r in cuts)
    channel = out["channels"].collect()[0]
    assert channel["valid"] and channel["tau"] == pytest.approx(1.0) and channel["eta"] == pytest.approx(2.31, rel=0.1)
    angle = out["orientations"].collect()[0]
    assert angle["theta_xz"] == pytest.approx(90) and angle["theta_xy"] is None


def test_validation_finds_tampering(spark):
    v = cylinder_voxels(spark)
    good = measure.measure(v, (10, 10, 10))
    present = spark.createDataFrame([(0, m) for m in validate.MANDATORY], "run_id int, entry string")
    ok = validate.validate(v, good["sections"], good["porosity"], present, (10, 10, 10)).collect()[0]
    assert ok["status"] == "PASS" and not ok["errors"]
    bad = good["sections"].withColumn("area", F.when(F.col("arc") > 4, F.col("area") + 1).otherwise(F.col("area")))
    got = validate.validate(v, bad, good["porosity"].withColumn("porosity", F.lit(0.3)), present, (10, 10, 10)).collect()[0]
    assert got["status"] == "FAIL" and any("section_mismatch" in e for e in got["errors"]) and any("porosity_mismatch" in e for e in got["errors"])
    assert validate.validate(v, good["sections"], good["porosity"], present.where("entry <> 'contract'"), (10, 10, 10)).collect()[0]["status"] == "NOT_EVALUABLE"


def test_components_against_flood(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((5, 6, 7)) < 0.35
    rows = [(int(x + 7 * (y + 6 * z)), int(x), int(y), int(z), bool(mask[z, y, x])) for z in range(5) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "id bigint, x int, y int, z int, pore boolean")
    label = {}
    for i, x, y, z, on in rows:
        if on and i not in label:
            stack = [(x, y, z)]
            while stack:
                a, b, c = stack.pop()
                k = a + 7 * (b + 6 * c)
                if k in label or not mask[c, b, a]:
                    continue
                label[k] = i
                stack += [((a + 1) % 7, b, c), ((a - 1) % 7, b, c), (a, (b + 1) % 6, c), (a, (b - 1) % 6, c)] + [(a, b, d) for d in (c - 1, c + 1) if 0 <= d < 5]
    assert {r["id"]: r["label"] for r in graph.labels(df, (7, 6, 5)).collect()} == label
    assert graph.through_networks(graph.labels(df, (7, 6, 5)), 5).collect()[0][0] >= 0
    tube = df.withColumn("pore", (F.col("y") == 2) & (F.col("z") == 2))
    assert graph.percolates_x(tube, (7, 6, 5)).collect()[0]["percolates"] and graph.winds_x(tube, (7, 6, 5)).collect()[0]["winds"]
    gap = tube.withColumn("pore", F.col("pore") & (F.col("x") != 3))
    assert not graph.percolates_x(gap, (7, 6, 5)).collect()[0]["percolates"] and not graph.winds_x(gap, (7, 6, 5)).collect()[0]["winds"]
    assert graph.components(df.select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_nearest_center_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((80, 2)) * 50)], "id bigint, x double, y double")
    centres = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((9, 2)) * 50)], "id bigint, x double, y double")
    near = {r["id"]: r["center"] for r in pairs.nearest_center(points, centres, (50, 50), 3.0).collect()}
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 0)
    assert near == {r["id"]: r["center"] for r in pairs.nearest_center(points, centres, (50, 50), 3.0).collect()}


def test_running_total_and_distances(spark):
    df = spark.createDataFrame([(i, (i * 7) % 11) for i in range(200)], "k int, v int")
    got = [r["running"] for r in ordered.running_total(df, ["k"], "v").orderBy("k").collect()]
    assert got == np.cumsum([(i * 7) % 11 for i in range(200)]).tolist()
    a, b = spark.createDataFrame([(float(i),) for i in (1, 2, 4)], "v double"), spark.createDataFrame([(float(i),) for i in (1, 3)], "v double")
    from voxlake.functions import distributions as D

    assert statistics.wasserstein(a, b, "v").collect()[0][0] == pytest.approx(D.wasserstein(np.array([1, 2, 4.0]), np.array([1, 3.0])))
    assert statistics.ks_to_constant(a, "v", 2.0).collect()[0][0] == 1.0
    uniform = {"family": "uniform", "low": 0.0, "high": 5.0}
    assert statistics.ks_distance(a, "v", D.cdf_udf(uniform, "validator")).collect()[0][0] == pytest.approx(D.ks(np.array([1, 2, 4.0]), uniform, "validator"))


def test_histogram_edges_and_empty_loss(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.99, 1.0, 4.0, 4.01, -0.1)], "d double")
    assert {r["bin"]: r["n"] for r in pairs.histogram(df, "d", 1.0, 4).collect()} == {0: 2, 1: 1, 3: 1}
    empty = spark.createDataFrame([(0, 0, 0.0, 1.0)], "bin int, n int, g double, t double")
    assert math.isinf(pairs.curve_loss(empty, "g", "t").collect()[0][0])


def test_reconcile_nulls_and_status(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0000001), (2, 2.0), (3, None), (5, 1.0)], "k int, v double")
    got = {r["k"]: r["status"] for r in reconcile.reconciled(a, b, ["k"], "v", 1e-6).collect()}
    assert got == {1: "ok", 2: "mismatch", 3: "mismatch", 4: "unexpected", 5: "missing"}
    tasks, done = spark.range(3).select(F.col("id").cast("int").alias("sequence_index")), spark.createDataFrame([(1, "ok", "")], "sequence_index int, status string, message string")
    assert [r["status"] for r in reconcile.completed(tasks, done, "stopped").collect()] == ["cancelled", "ok", "cancelled"]
    w = spark.createDataFrame([(False, ["small sample"], []), (False, ["overlap too large"], ["x"])], "p boolean, w array<string>, e array<string>")
    assert [r[0] for r in w.select(reconcile.accepted(F.col("p"), F.col("w"), ["overlap"])).collect()] == [True, False]
    assert [r[0] for r in w.select(reconcile.report_status(F.col("e"), F.col("w"), F.array().cast("array<string>"))).collect()] == ["WARNING", "FAIL"]


def test_scale_for_porosity(spark):
    units = spark.createDataFrame([(0, 5.13, 4.71, 5.37, 1.0)], "id int, cx double, cy double, cz double, r double")
    scale, porosity = scaling.solve_scale(units, (10, 10, 10), 0.1, 0.01)
    assert abs(porosity - 0.1) <= 0.01 and 2.4 < scale < 3.4
    with pytest.raises(ValueError):
        scaling.solve_scale(units, (10, 10, 10), 0.5, 1e-9, rounds=2)


def test_channel_rows_and_trapezoid(spark):
    t = spark.createDataFrame([(0, 10.0, 8.0, 5, False), (1, 1.0, 1.0, 1, False), (2, 5.0, 5.0, 5, True), (3, 5.0, 5.0, 5, False)], "track_id int, arc double, chord double, points int, branched boolean")
    s = spark.createDataFrame([(0, True, 2.0, 0.1), (0, True, 3.0, 0.3), (0, False, None, None), (2, True, 1.0, 0.0)], "track_id int, valid boolean, diameter double, fluctuation double")
    got = {r["track_id"]: r for r in tracks.channel_rows(t, s).collect()}
    assert got[0]["eta"] == 4.0 and got[0]["tau"] == 1.25
    assert [got[i]["invalid_reason"] for i in (1, 2, 3)] == ["insufficient_centerline_points", "branch_neighborhood", "no_valid_cross_sections"]
    line = spark.createDataFrame([(0, 0.0, 1.0), (0, 2.0, 3.0)], "k int, s double, v double")
    assert tracks.trapezoid(line, "k", ["s"], "s", "v").collect()[0]["integral"] == 4.0


def test_molecules(spark, tmp_path):
    from voxlake.functions import fields

    lines = ["HETATM   11 CL1  LIG A   1       0.000   0.000   0.000  1.00  0.00          CL", "HETATM   12 SE   LIG A   1       2.000   0.000   0.000", "CONECT   11   12", "CONECT   12   11", "ENDMDL", "HETATM   13 F    LIG A   1       9.000   0.000   0.000"]
    path = tmp_path / "m.pdb"
    path.write_text("\n".join(lines) + "\n")
    atoms = text.atoms(spark, str(path)).orderBy("serial").collect()
    assert [a["element"] for a in atoms] == ["CL", "SE"] and atoms[1]["x"] == 2.0
    assert text.bonds(spark, str(path)).select("a", "b").collect() == [(11, 12)]
    t = text.template(spark, str(path))
    assert t.agg(F.sum(F.col("mass") * F.col("x"))).collect()[0][0] == pytest.approx(0, abs=1e-9)
    ball = [fields.Compact("b", np.array([5.0, 5, 5]), np.array([4.5, 4.5, 4.5]))]
    shape = np.array([[0.0, 0, 0], [1.0, 0, 0]])
    placed = molecules.packed(shape, np.array([0.3, 0.3]), ball, (10.0, 10.0, 10.0), 4, np.random.default_rng(0), apart=1.5)
    assert placed.shape == (4, 7)
    inst = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(placed)], "instance int, x double, y double, z double, qx double, qy double, qz double, qw double")
    frame = spark.createDataFrame([(k, *map(float, p), 0.3) for k, p in enumerate(shape)], "serial int, x double, y double, z double, radius double")
    all_atoms = molecules.placed_atoms(inst, frame)
    assert all_atoms.count() == 8 and molecules.collisions(all_atoms, 1.5, (10, 10)).count() == 0
    assert molecules.template_deviation(all_atoms, frame).agg(F.max("rmsd")).collect()[0][0] < 1e-9
    with pytest.raises(molecules.PackingError):
        molecules.packed(shape, np.array([3.0, 3.0]), ball, (10.0, 10.0, 10.0), 30, np.random.default_rng(0), tries=5)
    assert molecules.agreeing_counts({"a": inst, "b": all_atoms}).agg(F.bool_and("agree")).collect()[0][0]
    pore = spark.createDataFrame([(5, 5, 5)], "x int, y int, z int")
    got = molecules.intrusion(spark.createDataFrame([(5.5, 15.5, 5.2), (1.0, 1.0, 1.0), (1.0, 1.0, 99.0)], "x double, y double, z double"), pore, (10, 10, 10), 1.0).collect()[0]
    assert (got["in_pore"], got["in_solid"], got["outside"]) == (1, 1, 1)


def test_text_sources(spark, tmp_path):
    (tmp_path / "g.ndx").write_text("[ pore ]\n1 2 x 3\n3 4\n")
    assert sorted(r[0] for r in text.index_group(spark, str(tmp_path / "g.ndx")).collect()) == [1, 2, 3, 4]
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n[1]\nbad\n')
    good, issues = text.json_lines(spark, str(tmp_path / "c.jsonl"))
    assert good.count() == 1 and issues.count() == 2
    folder = tmp_path / "qa"
    folder.mkdir()
    (folder / "a.txt").write_text("a")
    sums = files.checksums(spark, str(folder)).collect()
    listed = spark.createDataFrame([(sums[0]["sha"], "a.txt"), ("0", "../x"), ("0", "b.txt"), ("0", "b.txt")], "sha string, relative string")
    present = spark.createDataFrame([(sums[0]["sha"], "a.txt")], "sha string, relative string").select("relative", "sha")
    required = spark.createDataFrame([("a.txt",), ("c.txt",)], "relative string")
    codes = sorted({r["code"] for r in text.manifest_issues(listed, present, required).collect()})
    assert codes == ["duplicate", "missing_file", "not_listed", "unsafe_path"]


def test_run_folders_and_reports(tmp_path):
    now = datetime.datetime(2026, 1, 1, 20, tzinfo=datetime.UTC)
    first, second = files.run_folder(str(tmp_path), "My Run!", now), files.run_folder(str(tmp_path), "My Run!", now)
    assert first.name == "2026-01-02-my-run" and second.name == "2026-01-02-my-run-02" and (first / "geometry").is_dir()
    assert "Status: FAIL" in files.markdown_report("t", False, {"errors": ["x"], "values": {"b": 1}})
    with pytest.raises(ValueError):
        files.contract({"target_box_A": [1, 0, 1], "voxel_spacing_A": 1})
    assert files.contract({"target_box_A": [1, 1, 1], "voxel_spacing_A": 1})["axis_order"] == "z,y,x"


def minimal():
    one = {"family": "constant", "value": 1.0}
    return {"task": {"name": "n", "random_seed": 1}, "film": {"target_box_A": {"x": 20, "y": 20, "z": 20}, "packing_box_A": {"x": 20, "y": 20, "z": 30}}, "pores": {"seed_number_density_A3": 1.25e-4, "target_porosity": 0.1, "channel_fraction_by_count": 0.0}, "compact": {"relative_volume": one, "aspect_ratio": one, "roughness": {"family": "constant", "value": 0.0}}}


def test_config(spark):
    got = config.checked(minimal())
    assert config.derived(got)["seed_count"] == 1 and config.derived(got)["target_origin_in_packing_A"]["z"] == 5
    assert got["formal_targets"]["proportion"]["porosity"] == 0.1 and not config.preflight(got)
    assert config.table(spark, [got]).select(F.expr("variant_get(config, '$.task.name', 'string')")).collect()[0][0] == "n"
    for path, value in ((("task", "extra"), 1), (("pores", "target_porosity"), 1.0), (("compact", "aspect_ratio"), {"family": "constant", "value": 0.5}), (("compact", "roughness"), {"family": "tabulated"})):
        raw = minimal()
        raw[path[0]][path[1]] = value
        with pytest.raises(config.ConfigError):
            config.checked(raw)
    v3 = {"task": {"name": "n", "random_seed": 1}, "film": {"target_box_A": {"x": 10, "y": 10, "z": 10}}, "generation_controls": {"seed_number_density_A3": 8e-3}, "formal_targets": {"position_quantity": {"center_distance_xy": {"components": [{"center_A": 10.0, "width_A": 5.0}]}}, "shape": {"orientation": {"components": [{"weight": 1.0, "theta_xz_deg": {"family": "beta", "alpha": 2, "beta": 2, "lower": 0, "upper": 18}, "theta_xy_deg": {"family": "beta", "alpha": 2, "beta": 2, "lower": 0, "upper": 90}}]}}, "proportion": {"porosity": 0.2}}}
    got = config.checked(v3)
    assert got["center_distribution"]["rdf"][0]["center_xi"] == pytest.approx(2.0) and got["orientation"]["distribution"]["upper"] == pytest.approx(0.1)
    assert config.plan(4, 9, 8, 1 << 34, 1 << 30, got["parallel"]) == {"strategy": "seeds", "workers": 4, "tasks": 4}


def test_audit_and_selection(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in np.linspace(0.01, 0.99, 200)] + [("b", 3.0)], "quantity string, value double")
    beta = {"family": "beta", "alpha": 1.0, "beta": 1.0}
    got = {r["quantity"]: r for r in audit.audit_quantities(rows, {"a": beta, "b": beta, "c": beta}, 0.05, 0.05).collect()}
    assert got["a"]["passed"] and not got["b"]["passed"] and got["c"]["warning"] and math.isinf(got["c"]["ks"])
    assert not audit.rollup(audit.audit_quantities(rows, {"a": beta}, 0.05, 0.05), 0.2, 0.1, 1000).collect()[0]["passed"]
    c = generate.candidates(spark, 7, 2, 3)
    assert c.count() == 6 and c.select("seed").distinct().count() == 6
    results = spark.createDataFrame([(0, True, 0.5, False), (1, True, 0.11, False), (2, False, None, False)], "sequence_index int, succeeded boolean, porosity double, audit_passed boolean")
    assert generate.chosen(results, 0.1).collect()[0]["sequence_index"] == 1
    bad = generate.evaluated(c.limit(1), {"box": [4, 4, 4], "spacing": 1.0, "count": 1, "porosity": 0.1, "diameter": {"family": "nonsense"}}).collect()[0]
    assert not bad["succeeded"] and bad["failure_type"] == "ValueError"


def test_candidates_are_audited(spark):
    """Every candidate has the porosity asked for; only what meets its distributions passes, also where an earlier one doesn't."""
    from voxlake.plans.kernels import CONFIG

    tasks = spark.createDataFrame([(0, 7936), (1, 17)], "sequence_index int, seed bigint")
    results = generate.evaluated(tasks, CONFIG)
    got = {r["sequence_index"]: r for r in results.collect()}
    assert all(r["succeeded"] and abs(r["porosity"] - CONFIG["porosity"]) <= 0.01 and r["components"] >= 1 for r in got.values())
    assert not got[0]["audit_passed"] and got[0]["warnings"] == ["distribution mismatch: diameter"] and got[0]["scale"] > 1.05
    assert got[1]["audit_passed"] and got[1]["warnings"] == [] and got[1]["scale"] == pytest.approx(1)
    assert generate.chosen(results, CONFIG["porosity"]).collect()[0]["sequence_index"] == 1
    one = tasks.where("sequence_index = 1")
    low = CONFIG | {"eta": {"family": "beta", "alpha": 2.0, "beta": 2.0, "lower": 0.2, "upper": 0.9}, "theta_xz": {"family": "constant", "value": 0.0}, "sized": False}
    assert set(generate.evaluated(one, low).collect()[0]["warnings"]) == {"distribution mismatch: compact_eta", "distribution mismatch: channel_eta", "distribution mismatch: theta_xz"}
    far = generate.evaluated(one, CONFIG | {"pair_target": {"edges": [0.0, 1.0, 20.0], "values": [50.0, 0.0]}}).collect()[0]
    assert not far["audit_passed"] and "pair distances exceed audit limit" in far["warnings"]
    formal = generate.evaluated(one, CONFIG | {"measured": {"equivalent_diameter": {"family": "constant", "value": 4.0}}}).collect()[0]
    assert formal["succeeded"] and not formal["audit_passed"] and formal["warnings"][0].endswith("equivalent_diameter")


def test_audit_of_measured_through_tracks(spark):
    z, y, x = np.mgrid[:10, :10, :10]
    discs = ((x - 5) ** 2 + (y - 5) ** 2 <= 4, np.zeros((10, 10, 10), bool))
    slabs = spark.createDataFrame([(k, i, bytearray(np.packbits(m[i]).tobytes())) for k, m in enumerate(discs) for i in range(10)], "run_id int, z int, mask binary")
    m = measure.measure_slabs(slabs, (10, 10, 10))
    wide = {"family": "beta", "alpha": 1.0, "beta": 1.0, "lower": 0.0}
    got = {r["run_id"]: r["missed"] for r in audit.measured_warnings(m, {"channel_tau": {"family": "constant", "value": 1.0}, "equivalent_diameter": wide | {"upper": 100.0}}).collect()}
    assert got == {0: ["distribution mismatch: equivalent_diameter"], 1: ["no formal samples for channel_tau", "no formal samples for equivalent_diameter"]}


def test_pore_components():
    mask = np.zeros((3, 4, 4), bool)
    mask[0, 0, 0] = mask[0, 3, 0] = mask[0, 0, 3] = mask[2, 0, 0] = mask[0, 2, 2] = True
    assert kernels.pore_components(mask) == 3 and kernels.pore_components(np.zeros((2, 2, 2), bool)) == 0


def test_voxel_fields_agree(spark):
    units = spark.createDataFrame([(0, 0.5, 5.0, 5.0, 2.0), (1, 7.0, 7.0, 1.0, 1.5)], "id int, cx double, cy double, cz double, r double")
    cover = voxels.covered(units, (10, 10, 10))
    field = voxels.sphere_field(voxels.lattice(spark, 10, 10, 10), units, (10, 10))
    assert cover.count() == field.where("sdf < 0").count()
    soft = voxels.sphere_field(voxels.lattice(spark, 10, 10, 10), units, (10, 10), 32.0)
    assert soft.join(field.select("id", F.col("sdf").alias("hard")), "id").where("sdf > hard + 1e-12").count() == 0


def test_field_of_many_units(spark):
    """More units than one array may hold, the least and the smooth minimum against numpy; equal points stay apart."""
    rng = np.random.default_rng(5)
    n = 2 * voxels.BROADCAST_ROWS + 10
    at = np.column_stack([rng.uniform(0, 100, (n, 2)), rng.uniform(0, 10, n), rng.uniform(0.1, 0.5, n)])
    units = spark.createDataFrame([(i, *map(float, u)) for i, u in enumerate(at)], "id int, cx double, cy double, cz double, r double").repartition(3)
    spots = rng.uniform(0, 10, (40, 3)) * (10, 10, 1)
    points = spark.createDataFrame([(i % 39, *map(float, spots[i % 39])) for i in range(40)], "id int, px double, py double, pz double")
    d = spots[:, None] - at[None, :, :3]
    d[..., :2] -= 100 * np.rint(d[..., :2] / 100)
    d = np.sqrt((d**2).sum(axis=2)) - at[:, 3]
    for sharpness, want in ((None, d.min(axis=1)), (4.0, -np.log(np.exp(-4 * d).sum(axis=1)) / 4)):
        out = voxels.sphere_field(points, units, (100, 100), sharpness)
        assert out.columns == ["id", "px", "py", "pz", "sdf"]
        got = [(r["id"], r["sdf"]) for r in out.collect()]
        assert sorted(i for i, _ in got) == sorted([*range(39), 0]) and all(s == pytest.approx(want[i], abs=1e-9) for i, s in got)


def test_stream_of_slices(spark, tmp_path):
    from voxlake.streaming.tracking import tracked

    schema = "run_id int, z_index int, centers array<struct<x:double,y:double,wall:double>>"
    rows = [(0, 0, [(1.0, 1.0, 1.0)]), (0, 1, [(1.2, 1.0, 1.0), (6.0, 6.0, 1.0)]), (0, 2, [(1.4, 1.0, 1.0)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = tracked(stream, (10.0, 10.0), 1.0).writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["track_id"], r["z_index"]) for r in spark.sql("select * from tracks order by track_id, z_index").collect()] == [(0, 0), (0, 1), (0, 2), (1, 1)]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), np.round(rng.normal(size=500), 1), strict=True)]
    got = {r["g"]: r for r in statistics.quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0, 0.1, 0.5, 0.95, 1], "g").collect()}
    for g in range(3):
        mine = np.array([v for k, v in rows if k == g])
        assert [got[g][c] for c in ("q0", "q10", "q50", "q95", "q100")] == pytest.approx(np.quantile(mine, [0, 0.1, 0.5, 0.95, 1])) and got[g]["mean"] == pytest.approx(mine.mean())


def test_pairs_counted_by_distance_without_rows(spark, monkeypatch):
    """Copies of a place, edges of bins, several packs of a cell, rows without a place: as by pairs one by one."""
    monkeypatch.setattr(pairs, "PACK", 50)
    rng = np.random.default_rng(3)
    at = np.concatenate([rng.integers(0, 12, (150, 3)).astype(float), rng.uniform(0, 12, (700, 3)), np.full((40, 3), 3.0)])
    rows = [(i, i % 2, *map(float, p)) for i, p in enumerate(at)]
    df = spark.createDataFrame([*rows, (-1, 0, None, 1.0, 1.0), (-2, 1, float("nan"), 1.0, 1.0), (-3, None, 1.0, 1.0, 1.0)], "id int, g int, x double, y double, z double")
    for axes, bins in ((["x", "y", "z"], 4), (["x", "y"], 6)):
        for by in ("g", None):
            some = df.select("id", *([by] if by else []), *axes).where("id >= 0 or g is not null" if by else "id >= 0")
            key = [by] if by else []
            want = pairs.histogram(pairs.pairs_within(some.where("id >= 0"), float(bins), (12, 12), by), "distance", 1.0, bins, key)
            got = pairs.pair_histogram(some, 1.0, bins, (12, 12), by)
            assert sorted(tuple(r) for r in got.select(*key, "bin", "n").collect()) == sorted(tuple(r) for r in want.select(*key, "bin", "n").collect())
    assert pairs.pair_histogram(df.where("id < -5"), 1.0, 4, (12, 12)).count() == 0


def test_points_that_share_an_id_are_no_pair(spark, duck, tmp_path):
    """Repeated ids in one place and in several, hot ones and null ones; and tables whose keys are repeated, as by their SQL."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.integers(0, 12, (200, 3)), np.full((30, 3), 3)]).astype(float)
    rows = [(int(rng.integers(0, 90)) if i % 3 else 7, i % 2, *map(float, p)) for i, p in enumerate(at)] + [(500 + i // 3, 0, 5.0, 5.0, float(i // 6)) for i in range(12)]
    df = spark.createDataFrame([*rows, (None, 0, 3.0, 3.0, 3.0), (None, 0, 3.0, 3.0, 3.0)], "id int, g int, x double, y double, z double")
    for by in ("g", None):
        key = [by] if by else []
        want = pairs.histogram(pairs.pairs_within(df, 5.0, (12, 12), by), "distance", 1.0, 5, key)
        got = pairs.pair_histogram(df.select("id", *key, "x", "y", "z"), 1.0, 5, (12, 12), by)
        assert sorted(tuple(r) for r in got.select(*key, "bin", "n").collect()) == sorted(tuple(r) for r in want.select(*key, "bin", "n").collect())
    own = duck.cursor()
    for t, key in (("supplier", "s_suppkey"), ("customer", "c_custkey")):
        own.execute(f"copy (select * from {t} union all select * from {t} where {key} % 3 = 0) to '{tmp_path}/{t}.parquet'")
        own.execute(f"create temp view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("pair_distance_hist", "gxy_by_slice", "pair_curve"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = own.execute(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall()
        assert sorted(tuple(r) for r in got.collect()) == [pytest.approx(r) for r in sorted(want)]


def test_blocks_of_pairs_counted_by_edges(monkeypatch):
    """Blocks by float32 products count as pairs one by one do: places on a lattice (distances on bins' edges), either image, far from the middle."""
    rng, calls, plain = np.random.default_rng(5), [], pairs._edge_counts
    monkeypatch.setattr(pairs, "_edge_counts", lambda *a: calls.append(1) or plain(*a))
    for axes, off in ((3, 0.0), (3, 40.0), (2, 0.0)):
        a, b = (np.concatenate([rng.integers(0, 1000, (axes, 700)) / 10.0 + off, np.ones((1, 700))]) for _ in range(2))
        d = a[:-1, :, None] - b[:-1, None]
        for k in range(2):
            d[k] -= 100.0 * np.rint(d[k] / 100.0)
        d2 = d[0] * d[0] + d[1] * d[1]
        r = np.sqrt(d2 + d[2] * d[2] if axes == 3 else d2)
        at = np.where(r == 50.0, 9, np.floor(r / 5.0))[r <= 50.0].astype(int)
        assert pairs._pair_counts(a, b, False, 5.0, 10, (100.0, 100.0)).tolist() == np.bincount(at, minlength=10)[:10].tolist()
    assert calls


def test_blocks_of_places_of_one_weight_are_counted_by_edges(monkeypatch):
    """A few repeated places among single ones don't send their blocks back to pairs one by one; rare weights go together."""
    rng, calls, plain = np.random.default_rng(8), [], pairs._edge_counts
    monkeypatch.setattr(pairs, "_edge_counts", lambda p, o, *rest: calls.append(p.shape[1] * o.shape[1]) or plain(p, o, *rest))
    for off in (0.0, 30.0):
        weight = lambda: np.concatenate([np.ones(900), np.full(150, 2.0), np.full(110, 5.0), np.arange(7.0, 47.0)])[None]
        a, b = (np.concatenate([rng.permuted(rng.integers(0, 1000, (2, 1200)) / 10.0 + off, axis=1), weight()])[:, rng.permutation(1200)] for _ in range(2))
        for other, same in ((b, False), (a, True)):
            calls.clear()
            d = a[:-1, :, None] - other[:-1, None]
            d -= 100.0 * np.rint(d / 100.0)
            r = np.sqrt(d[0] * d[0] + d[1] * d[1])
            w = a[-1][:, None] * other[-1]
            if same:  # each pair of places once, and the pairs within a place
                w = np.triu(w, 1) + np.diag(a[-1] * (a[-1] - 1) / 2)
            at = np.where(r == 50.0, 9, np.floor(r / 5.0))
            want = np.bincount(at[r <= 50.0].astype(int), w[r <= 50.0], minlength=10)[:10].astype(int)
            assert pairs._pair_counts(a, other, same, 5.0, 10, (100.0, 100.0)).tolist() == want.tolist()
            assert sum(calls) > 400_000  # of 1.44 million, or half as many


def test_pairs_within_come_from_many_tasks_once_each(spark):
    rng = np.random.default_rng(4)
    for box, axes in (((10, 10), 2), ((3, 10), 3), ((1, 1), 2)):  # many cells, two or three along an axis, one
        at = rng.uniform(0, (*box, 5)[:axes], (120, axes))
        df = spark.createDataFrame([(i * 7 % 120, *map(float, p)) for i, p in enumerate(at)], "id int, " + ", ".join(f"{c} double" for c in "xyz"[:axes])).coalesce(1)
        got = pairs.pairs_within(df, 1.2, box).withColumn("_task", F.spark_partition_id()).collect()
        d = at[:, None] - at[None]
        d[..., :2] -= np.array(box) * np.rint(d[..., :2] / box)
        near = np.argwhere(np.sqrt((d**2).sum(2)) <= 1.2)
        assert sorted((r["a"], r["b"]) for r in got) == sorted((i * 7 % 120, j * 7 % 120) for i, j in near.tolist() if i * 7 % 120 < j * 7 % 120)
        assert box == (1, 1) or len({r["_task"] for r in got}) > 1
