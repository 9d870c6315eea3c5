"""Triangles as rows against the array kernels, on closed surfaces, ties, far points and awkward triangles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.functions.shapes import nearest_on_mesh
from voxlake.operators import mesh
from voxlake.plans import catalog


def faces_of(spark, vertices, faces):
    rows = [(i, *map(float, vertices[list(f)].ravel())) for i, f in enumerate(faces)]
    return spark.createDataFrame(rows, "face bigint, " + ", ".join(f"{c} double" for c in mesh.CORNERS))


def points_of(spark, points):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, x double, y double, z double").repartition(3)


@pytest.fixture(scope="module")
def blob():
    rng = np.random.default_rng(1)
    at = np.stack(np.meshgrid(*[np.arange(9)] * 3, indexing="ij"), axis=-1)
    mask = np.zeros((9, 9, 9), bool)
    for c, r in zip(rng.uniform(2.5, 5.5, (4, 3)), rng.uniform(1.2, 2.2, 4), strict=True):
        mask |= ((at - c) ** 2).sum(-1) < r * r
    return mask, *K.surface(mask, 1.0)


def test_sides_of_a_closed_surface(spark, blob):
    _, vertices, faces = blob
    points = np.concatenate([np.random.default_rng(2).uniform(-1, 10, (300, 3)), vertices.mean(axis=0)[None]])
    want = K.inside_mesh(vertices, faces, points)
    for cell in (None, 0.7, 50.0):
        got = {r["id"]: r["inside"] for r in mesh.inside(points_of(spark, points), faces_of(spark, vertices, faces), cell).collect()}
        assert [got[i] for i in range(len(points))] == want.tolist()
    assert 0 < want.sum() < len(points)


def test_points_under_corners_and_edges(spark):
    """Rays through shared corners and edges, and along upright faces, count once or not at all."""
    box = np.array([(x, y, z) for x in (0, 2) for y in (0, 2) for z in (0, 2)], float)
    faces = [(0, 1, 3), (0, 3, 2), (4, 7, 5), (4, 6, 7), (0, 5, 1), (0, 4, 5), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 7, 3), (1, 5, 7)]
    inner = [(x, y, 1.0) for x in (0.5, 1.0, 1.5) for y in (0.5, 1.0, 1.5)]  # some on the diagonals of top and bottom
    outer = [(x, y, z) for x in (-1.0, 3.0) for y in (0.0, 1.0, 2.0) for z in (-1.0, 1.0)] + [(x, y, 3.0) for x, y, _ in inner] + [(x, y, -1.0) for x, y, _ in inner]
    got = {r["id"]: r["inside"] for r in mesh.inside(points_of(spark, inner + outer), faces_of(spark, box, faces)).collect()}
    assert [got[i] for i in range(len(inner) + len(outer))] == [True] * len(inner) + [False] * len(outer)


def test_nearest_faces(spark, blob):
    _, vertices, faces = blob
    points = np.concatenate([np.random.default_rng(3).uniform(-1, 10, (120, 3)), [[400.0, -300.0, 20.0]], vertices[:5]])
    _, want = nearest_on_mesh(vertices, faces, points)
    for cell in (None, 0.5):
        got = {r["id"]: r["distance"] for r in mesh.nearest_face(points_of(spark, points), faces_of(spark, vertices, faces), cell).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(points))], want, atol=1e-9)


def test_awkward_triangles_and_points(spark):
    rows = [(1, *[0.0] * 9), (2, 0.0, 0, 0, 1, 0, 0, 3, 0, 0), (3, *[None] * 9), (4, float("nan"), *[1.0] * 8)]  # a point, a line, nothing, not a number
    faces = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k else v for k, v in enumerate(r)) for r in rows], "face bigint, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    points = points_of(spark, [(2.0, 1.0, 0.0), (-1.0, 0.0, 0.0)]).union(spark.createDataFrame([(7, None, 0.0, 0.0), (8, float("inf"), 0.0, 0.0)], "id int, x double, y double, z double"))
    got = {r["id"]: (r["face"], r["distance"]) for r in mesh.nearest_face(points, faces).collect()}
    assert got == {0: (2, 1.0), 1: (1, 1.0)}  # the smaller face on a tie
    assert mesh.inside(points, faces).where("inside").count() == 0 and mesh.inside(points, faces).count() == 4
    for none in (faces.limit(0), faces.where("face = 3")):
        assert mesh.nearest_face(points, none).count() == 0 and mesh.inside(points, none).count() == 4
    assert mesh.nearest_face(points.limit(0), faces).count() == 0


def test_a_mesh_against_its_voxels(spark, blob):
    mask, vertices, faces = blob
    rows = [(int(x), int(y), int(z), bool(mask[z, y, x])) for z in range(9) for y in range(9) for x in range(9)]
    voxels = spark.createDataFrame(rows, "x int, y int, z int, pore boolean")
    held = faces_of(spark, vertices, faces)
    assert tuple(mesh.occupancy_mismatch(voxels, held).first()) == (729, 0.0)
    wrong = voxels.withColumn("pore", F.when(F.col("z") == 4, ~F.col("pore")).otherwise(F.col("pore")))
    assert tuple(mesh.occupancy_mismatch(wrong, held).first()) == (729, 81 / 729)
    n, off = mesh.occupancy_mismatch(voxels, held, most=100).first()
    assert n == 100 and off == 0.0
    assert mesh.occupancy_mismatch(voxels.limit(0), held).first()["mismatch"] is None


def test_octahedra_are_closed_and_inside_their_spheres(spark):
    spheres = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 1.0), (1, 5.0, 5.0, 5.0, 0.5)], "id bigint, cx double, cy double, cz double, r double")
    faces = mesh.octahedra(spheres)
    assert faces.count() == 16
    points = points_of(spark, [(1.0, 2.0, 3.0), (1.3, 2.3, 3.3), (1.4, 2.4, 3.4), (5.1, 5.1, 5.1), (1.0, 2.0, 1.0)])
    assert {r["id"]: r["inside"] for r in mesh.inside(points, faces).collect()} == {0: True, 1: True, 2: False, 3: True, 4: False}


def test_copies_are_met_once_and_counted(spark):
    """Copies of a surface don't lengthen the join, and a cell's points go to several tasks."""
    spheres = spark.range(40).selectExpr("id", "2.0D cx", "2.0D cy", "2.0D cz", "case when id % 2 = 0 then 1.0D else 0.5D end r")
    faces = mesh.octahedra(spheres)
    assert mesh._sound(faces).agg(F.count("*"), F.sum("copies")).first() == (16, 320)
    points = points_of(spark, [(2.2, 2.1, 0.0), (2.2, 2.1, 1.9), (9.0, 9.0, 9.0)] * 40)
    got = {r["id"]: r["n"] for r in mesh.crossings(points, faces).collect()}
    assert all(got.get(i) == (80, 40, None)[i % 3] for i in range(120))
    ends = {c: (0.0, 1.0) for c in "xyz"}
    met = mesh._met(points, mesh._sound(faces), 50.0, ends, "xy").select("id", F.spark_partition_id().alias("p")).distinct()
    assert met.select("p").distinct().count() > 1


def test_terms_worked_out_once_give_the_same_as_the_expressions(spark):
    rng = np.random.default_rng(7)
    at = np.concatenate([rng.integers(0, 4, (60, 9)).astype(float), rng.uniform(0, 4, (60, 9))])
    faces = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], "face bigint, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    points = points_of(spark, np.concatenate([rng.integers(0, 4, (20, 3)).astype(float), rng.uniform(0, 4, (20, 3))]))
    every = points.crossJoin(faces)
    want = {tuple(r) for r in every.where(F.expr(mesh.CROSSED)).select("id", "face").collect()}
    assert {tuple(r) for r in mesh._crossed(points.crossJoin(mesh._sides(faces))).select("id", "face").collect()} == want and want
    want = {(r["id"], r["face"]): r["s"] for r in every.select("id", "face", F.expr(mesh.SQUARED).alias("s")).collect()}
    assert {(r["id"], r["face"]): r["_s"] for r in mesh._squared(every).collect()} == want


def test_occupancy_of_repeated_and_awkward_spheres(spark, duck, tmp_path):
    """Spheres of many radii in one place, repeated ones, and ones without a key or a balance: as by the SQL, each set of corners met once."""
    own = duck.cursor()
    rows = "select (s_suppkey + 20 * i)::bigint s_suppkey, s_name, s_nationkey, s_acctbal + 37.5 * i s_acctbal from supplier, range(8) r(i)"
    odd = "select s_suppkey, s_name, s_nationkey, null from supplier union all select null, s_name, s_nationkey, s_acctbal from supplier"
    own.execute(f"copy ({rows} union all select * from supplier where s_suppkey % 2 = 0 union all {odd}) to '{tmp_path}/supplier.parquet'")
    own.execute(f"create temp view supplier as select * from '{tmp_path}/supplier.parquet'")
    got = catalog.QUERIES["mesh_occupancy"](spark, str(tmp_path))
    assert tuple(got.first()) == own.execute(f"select {', '.join(got.columns)} from ({catalog.SQL['mesh_occupancy']})").fetchone()
    faces = mesh.octahedra(catalog.spheres(spark, str(tmp_path))).where("x1 is not null")
    assert mesh._sound(faces).count() == faces.select(mesh.CORNERS).distinct().count() < faces.count()


def test_points_of_one_x_and_y_are_tried_at_once(spark):
    """A triangle is tried on packs of points above each other, which stay small in a crowded column; counts are those of CROSSED."""
    points = points_of(spark, [(x + 0.25, 1.5, z / 100) for x in range(3) for z in range(400 if x else 5)] * 2)
    packs = [(r["x"], len(r["held"])) for r in mesh._packs(points).collect()]
    assert sum(n for _, n in packs) == 1610 and max(n for _, n in packs) <= 3 * mesh.PACK
    assert [n for x, n in packs if x == 0.25] == [10] and len(packs) <= 2 * 800 / mesh.PACK + 3
    faces = mesh.octahedra(spark.range(30).selectExpr("id", "id % 3 + 0.5D cx", "1.5D cy", "id % 5 + 0.0D cz", "1.0D + id % 2 r"))
    want = {r["id"]: r["count"] for r in points.join(faces, F.expr(mesh.CROSSED)).groupBy("id").count().collect()}
    assert {r["id"]: r["n"] for r in mesh.crossings(points, faces).collect()} == want and len(want) > 800


def test_rows_of_one_file_are_dealt_before_they_grow(spark):
    spheres = spark.range(64).selectExpr("id", "2.0D cx", "2.0D cy", "2.0D cz", "1.0D r").coalesce(1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mesh.octahedra(spheres).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _measured(spark, since):
    """The largest broadcast in bytes and the rows sent to Python of the executions after `since`, and the last one."""
    store, most, rows, last = spark._jsparkSession.sharedState().statusStore(), 0.0, 0, since
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    for e in seq(store.executionsList()):
        if e.executionId() <= since:
            continue
        last = max(last, e.executionId())
        metrics = store.executionMetrics(e.executionId())
        for node in seq(store.planGraph(e.executionId()).allNodes()):
            for m in seq(node.metrics()):
                found = metrics.get(m.accumulatorId())
                if found.isDefined() and (node.name(), m.name()) == ("BroadcastExchange", "data size"):
                    size, unit = found.get().split("\n")[-1].split(" (")[0].split()[:2]
                    most = max(most, float(size) * 1024 ** ["B", "KiB", "MiB", "GiB"].index(unit))
                elif found.isDefined() and (node.name(), m.name()) == ("ArrowEvalPython", "number of output rows"):
                    rows += int(found.get().replace(",", ""))
    return most, rows, last


def test_nested_faces_are_neither_broadcast_nor_all_measured(spark):
    """Faces about one place, whose boxes hold each other: they must not grow by the cells in the driver, nor each meet half of the points."""
    spheres = spark.range(400).selectExpr("id", "3.0D cx", "3.0D cy", "3.0D cz", "0.5D + 0.005D * id r")
    points = np.random.default_rng(11).uniform(0, 6, (2000, 3))
    _, _, since = _measured(spark, -1)
    got = {r["id"]: (r["face"], r["distance"]) for r in mesh.nearest_face(points_of(spark, points), mesh.octahedra(spheres)).collect()}
    most, rows, _ = _measured(spark, since)
    assert most < 4e6 and rows < 2000 * 3200 / 10, (most, rows)
    faces = mesh.octahedra(spheres).orderBy("face").toPandas()
    for i in range(0, 2000, 20):
        s = mesh._squares(*[faces["x1"] * 0 + v for v in points[i]], *[faces[c] for c in mesh.CORNERS])
        assert got[i] == (faces["face"][int(s.argmin())], float(np.sqrt(s.min())))
    assert len(got) == 2000


@pytest.mark.parametrize("far", [None, 3e7])
def test_descent_to_nearest_faces_on_awkward_input(spark, monkeypatch, far):
    """Ties, slivers, points and lines for triangles, repeated places and keys, minus zero, and a point and a face far away: faces and distances are those of all pairs."""
    rng = np.random.default_rng(5)
    at = np.concatenate([rng.integers(0, 4, (150, 9)).astype(float), rng.uniform(0, 4, (150, 9)), np.repeat(rng.uniform(0, 4, (20, 3)), 3, 0).reshape(20, 9) + np.tile([0, 0, 0, 3, 3, 3, 1, 1, 1 + 1e-9], (20, 1))])
    spots = np.concatenate([rng.integers(0, 4, (60, 3)).astype(float), rng.uniform(-1, 5, (200, 3)), np.full((40, 3), 1.25), [[-0.0, 0.0, 1.0], [0.0, -0.0, 1.0]]])
    if far:
        at, spots = np.concatenate([at, at[:3] + far]), np.concatenate([spots, [[far, 0.0, -far]]])
    faces = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], "face bigint, " + ", ".join(f"{c} double" for c in mesh.CORNERS))
    points = points_of(spark, spots)
    points = points.union(points.where("id < 5").selectExpr("id", "x + 2", "y", "z"))
    want = {r["id"]: (r["m"]["face"], r["m"]["distance"]) for r in mesh._nearest(points.crossJoin(faces), "id").collect()}
    monkeypatch.setattr(mesh, "FEW", 0)
    for cell in (None, 0.7):
        got = mesh.nearest_face(points, faces, cell).collect()
        assert {r["id"]: (r["face"], r["distance"]) for r in got} == want and len(got) == len(want)


def test_nearest_faces_of_copies_as_by_the_sql(spark, duck, tmp_path, monkeypatch):
    """Copies with shifted keys, some of the same balance, by broadcast and by shuffled groups."""
    own = duck.cursor()
    own.execute(f"copy (select (s_suppkey + 20 * i)::bigint s_suppkey, s_name, s_nationkey, s_acctbal + 37.5 * (i % 5) s_acctbal from supplier, range(8) r(i)) to '{tmp_path}/supplier.parquet'")
    own.execute(f"copy (select c_custkey + 1000 * i c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer, range(3) r(i)) to '{tmp_path}/customer.parquet'")
    for t in ("supplier", "customer"):
        own.execute(f"create temp view {t} as select * from '{tmp_path}/{t}.parquet'")
    want = {}
    monkeypatch.setattr(mesh, "FEW", 0)
    for grouped in (mesh.GROUPS, 40):
        monkeypatch.setattr(mesh, "GROUPS", grouped)
        got = catalog.QUERIES["nearest_face"](spark, str(tmp_path))
        want = want or dict(own.execute(f"select id, distance from ({catalog.SQL['nearest_face']})").fetchall())
        rows = [tuple(r) for r in got.select("id", "distance").collect()]
        assert dict(rows) == want and len(rows) == len(want)


def test_faces_repeated_by_column_are_not_broadcast(spark):
    """Sides: faces go to every column of cells they meet, which their file doesn't tell."""
    faces = mesh.octahedra(spark.range(400).selectExpr("id", "3.0D cx", "3.0D cy", "3.0D cz", "0.5D + 0.005D * id r"))
    points = points_of(spark, np.random.default_rng(12).uniform(0, 6, (500, 3)))
    _, _, since = _measured(spark, -1)
    got = {r["id"]: r["n"] for r in mesh.crossings(points, faces).collect()}
    assert _measured(spark, since)[0] < 1e6
    assert got == {r["id"]: r["count"] for r in points.join(faces, F.expr(mesh.CROSSED)).groupBy("id").count().collect()} and got
