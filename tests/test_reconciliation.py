"""One-to-one matching, and reported geometry against geometry measured anew."""

import json
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from voxlake.operators import matching
from voxlake.plans import measure, validate

SHAPE = (16, 16, 10)


def greedy(pairs):
    out, used = [], (set(), set())
    for cost, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            out.append((a, b, cost))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_mutual_rounds_give_the_greedy_matching(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(6))) for _ in range(150)]
    pairs = list({(a, b): (a, b, c) for a, b, c in pairs}.values())
    chain = [(100 + i, 100 + i, 2.0 - i / 100) for i in range(8)] + [(100 + i, 101 + i, 2.0 - i / 100 - 0.005) for i in range(7)]  # settles from one end
    got = matching.mutual(spark.createDataFrame(pairs + chain, "a int, b int, cost double"), "cost").collect()
    assert sorted((r["a"], r["b"], r["cost"]) for r in got) == greedy(pairs + chain)
    assert matching.mutual(spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "a int, b int, cost double"), "cost").count() == 0


def test_points_matched_one_to_one_across_the_border(spark):
    rng = random.Random(4)
    left = [(g, i, rng.uniform(0, 30), rng.uniform(0, 30)) for g in range(2) for i in range(60)]
    right = [(g, 500 + i, (x + rng.uniform(-0.6, 0.6)) % 30, (y + rng.uniform(-0.6, 0.6)) % 30) for g, i, x, y in left if i % 9] + [(0, 900, 1.0, 1.0)]
    got = matching.matched_points(spark.createDataFrame(left, "g int, id int, x double, y double"), spark.createDataFrame(right, "g int, id int, x double, y double"), 1.5, (30, 30), ["g"]).collect()
    apart = lambda a, b: math.hypot(*(abs((p - q + 15) % 30 - 15) for p, q in zip(a, b, strict=True)))
    for g in range(2):
        pairs = [(i, j, apart((x, y), (u, v))) for h, i, x, y in left if h == g for k, j, u, v in right if k == g]
        want = {(a, b) for a, b, _ in greedy([p for p in pairs if p[2] <= 1.5])}
        mine = [r for r in got if r["g"] == g]
        assert {(r["reported"], r["expected"]) for r in mine if r["status"] == "ok"} == want
        assert {r["reported"] for r in mine if r["status"] == "unexpected"} == {i for h, i, *_ in left if h == g} - {a for a, _ in want}
        assert {r["expected"] for r in mine if r["status"] == "missing"} == {j for h, j, *_ in right if h == g} - {b for _, b in want}


@pytest.fixture(scope="module")
def bundle(spark):
    """Two oblique channels that cross the film, and what is measured of them."""
    at = spark.range(math.prod(SHAPE)).select((F.col("id") % 16).cast("int").alias("x"), (F.floor(F.col("id") / 16) % 16).cast("int").alias("y"), F.floor(F.col("id") / 256).cast("int").alias("z"))
    near = lambda cx, cy: (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy) <= 6.5
    voxels = at.withColumn("pore", near(3.5 + F.col("z") * 0.2, F.lit(4.5)) | near(F.lit(10.5), 8.5 + F.col("z") * 0.1)).withColumn("run_id", F.lit(0)).cache()
    return voxels, measure.measure(voxels, SHAPE)


def judged(spark, bundle, **altered):
    voxels, good = bundle
    present = spark.createDataFrame([(0, m) for m in validate.MANDATORY], "run_id int, entry string")
    tables = {t: altered.get(t, good[t]) for t in ("centers", "points", "orientations", "channels", "distances")}
    got = validate.validate(voxels, altered.get("sections", good["sections"]), good["porosity"], present, SHAPE, reported=tables).collect()[0]
    return got["status"], {e.split(":")[0] for e in got["errors"]}


def test_what_was_measured_passes(spark, bundle):
    assert bundle[1]["through"].count() == 2 and bundle[1]["sections"].where("valid").count() > 0
    assert bundle[1]["distances"].agg(F.sum("n")).first()[0] > 0
    assert judged(spark, bundle) == ("PASS", set())


def test_order_and_numbers_of_tracks_do_not_matter(spark, bundle):
    _, good = bundle
    other = {t: good[t].withColumn("track_id", 7 - F.col("track_id")) for t in ("points", "orientations", "channels", "sections")}
    assert judged(spark, bundle, centers=good["centers"].withColumn("centers", F.reverse("centers")), **other) == ("PASS", set())


def test_one_moved_centre_fails(spark, bundle):
    moved = F.transform("centers", lambda c, i: F.when((i == 0) & (F.col("z_index") == 4), c.withField("x", c["x"] + 0.3)).otherwise(c))
    assert judged(spark, bundle, centers=bundle[1]["centers"].withColumn("centers", moved)) == ("FAIL", {"center_moved"})
    far = F.transform("centers", lambda c, i: F.when((i == 0) & (F.col("z_index") == 4), c.withField("x", c["x"] + 5.0)).otherwise(c))
    assert judged(spark, bundle, centers=bundle[1]["centers"].withColumn("centers", far)) == ("FAIL", {"center_missing", "center_unexpected"})
    wall = F.transform("centers", lambda c, i: F.when((i == 1) & (F.col("z_index") == 2), c.withField("wall", c["wall"] + 0.1)).otherwise(c))
    assert judged(spark, bundle, centers=bundle[1]["centers"].withColumn("centers", wall)) == ("FAIL", {"center_wall"})


def test_one_altered_track_fails(spark, bundle):
    points = bundle[1]["points"]
    here = (F.col("track_id") == 0) & (F.col("z_index") == 5)
    assert judged(spark, bundle, points=points.withColumn("wrapped_x", F.col("wrapped_x") + F.when(here, 0.2).otherwise(0.0))) == ("FAIL", {"track_moved"})
    assert judged(spark, bundle, points=points.where(~here)) == ("FAIL", {"track_points"})
    assert judged(spark, bundle, points=points.withColumn("branch", F.col("branch") != here)) == ("FAIL", {"track_branches"})
    assert judged(spark, bundle, points=points.where("track_id = 0"))[1] >= {"track_missing"}


def test_one_altered_angle_or_channel_fails(spark, bundle):
    first = F.col("track_id") == 0
    angles = bundle[1]["orientations"].withColumn("theta_xz", F.col("theta_xz") + F.when(first, 0.5).otherwise(0.0))
    assert judged(spark, bundle, orientations=angles) == ("FAIL", {"orientation_mismatch"})
    assert judged(spark, bundle, orientations=bundle[1]["orientations"].where(~first)) == ("FAIL", {"orientation_missing"})
    channels = bundle[1]["channels"].withColumn("tau", F.col("tau") * F.when(first, 1.01).otherwise(1.0))
    assert judged(spark, bundle, channels=channels) == ("FAIL", {"channel_mismatch"})


def test_one_altered_pair_distance_fails(spark, bundle):
    g = bundle[1]["distances"]
    some = g.where("n > 0").first()["bin"]
    assert judged(spark, bundle, distances=g.withColumn("g", F.col("g") + F.when(F.col("bin") == some, 0.01).otherwise(0.0))) == ("FAIL", {"g_xy_mismatch"})
    assert judged(spark, bundle, distances=g.where(F.col("bin") != some)) == ("FAIL", {"g_xy_missing"})


def test_command_line_on_altered_bundles(spark, bundle, tmp_path, capsys):
    from voxlake.__main__ import main
    from voxlake.sources import phase

    path = str(tmp_path / "phase")
    phase.write_phase(bundle[0].drop("run_id"), path, SHAPE, 1.0, contract={"cross_section_spacing_A": 2.0})

    def report():
        code = main(["validate", path])
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert main(["measure", path]) == 0 and report()[1] == {"run_id": 0, "status": "PASS", "errors": [], "missing": []}
    points = spark.read.parquet(f"{path}/measurement/points")
    points.withColumn("wrapped_y", F.col("wrapped_y") + F.when((F.col("track_id") == 1) & (F.col("z_index") == 3), 0.25).otherwise(0.0)).write.parquet(str(tmp_path / "altered"))
    shutil.move(f"{path}/measurement/points", str(tmp_path / "points"))
    shutil.copytree(str(tmp_path / "altered"), f"{path}/measurement/points")
    assert report()[1]["errors"] == ["track_moved: track 1"]
    shutil.rmtree(f"{path}/measurement/points")
    shutil.move(str(tmp_path / "points"), f"{path}/measurement/points")
    loose = json.loads(spark.read.parquet(f"{path}/measurement/contract").first()[0]) | {"cross_section_spacing_A": 5.0}
    shutil.rmtree(f"{path}/measurement/contract")
    spark.createDataFrame([(json.dumps(loose),)], "contract string").write.parquet(f"{path}/measurement/contract")
    assert report()[1]["errors"] == ["contract_mismatch: cross_section_spacing_A"]
    shutil.move(f"{path}/voxels", str(tmp_path / "voxels"))
    code, got = report()
    assert code == 1 and got["status"] == "NOT_EVALUABLE" and got["missing"] == ["voxels"]


def test_dense_points_matched_by_bands_of_distance(spark, monkeypatch):
    """Pairs are never all met at once, and are those of the greedy matching all the same."""
    rng = random.Random(8)
    left = [(i, rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(150)]
    right = [(500 + i, rng.uniform(0, 6), rng.uniform(0, 6)) for i in range(140)] + [(900 + i, 1.0, 1.0) for i in range(5)]
    met, joined = [], matching.joined_within
    monkeypatch.setattr(matching, "joined_within", lambda *args: met.append(joined(*args).count()) or joined(*args))
    got = matching.matched_points(spark.createDataFrame(left, "id int, x double, y double"), spark.createDataFrame(right, "id int, x double, y double"), 2.5, (6, 6)).where("status = 'ok'").collect()
    apart = lambda a, b: math.hypot(*(abs((p - q + 3) % 6 - 3) for p, q in zip(a, b, strict=True)))
    pairs = [(i, j, apart((x, y), (u, v))) for i, x, y in left for j, u, v in right]
    pairs = [p for p in pairs if p[2] <= 2.5]
    assert {(r["reported"], r["expected"]) for r in got} == {(a, b) for a, b, _ in greedy(pairs)}
    assert len(met) > 1 and sum(met) < len(pairs) / 4
