"""Queries on triangles: sides, nearest faces, and surfaces against voxels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import mesh, surface
from voxlake.plans.catalog import _COVER, _UNITS, BOX, SHAPE, _phase, drawn, query, spheres
from voxlake.plans.measure import packed
from voxlake.tables import table

_FACES = """f as (select id * 8 + k face, cx + case when a = 0 then va * r else 0 end x1, cy + case when a = 1 then va * r else 0 end y1, cz + case when a = 2 then va * r else 0 end z1,
  cx + case when b = 0 then vb * r else 0 end x2, cy + case when b = 1 then vb * r else 0 end y2, cz + case when b = 2 then vb * r else 0 end z2,
  cx + case when c = 0 then vc * r else 0 end x3, cy + case when c = 1 then vc * r else 0 end y3, cz + case when c = 2 then vc * r else 0 end z3
  from s, (select k, 0 a, case when up then 1 else 2 end b, case when up then 2 else 1 end c, sx va, case when up then sy else sz end vb, case when up then sz else sy end vc
    from (select k, sx, sy, sz, sx * sy * sz > 0 up from (select k, case when k & 1 > 0 then 1 else -1 end sx, case when k & 2 > 0 then 1 else -1 end sy, case when k & 4 > 0 then 1 else -1 end sz from range(8) t(k)))))"""
_AT = "q as (select c_custkey id, ((c_custkey*37)%1000)/50.0::double x, ((c_custkey*61)%997)/50.0::double y, ((c_custkey*29)%1013)/50.0::double z from customer)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), *[((k * m) % n / 50.0).alias(c) for c, m, n in (("x", 37, 1000), ("y", 61, 997), ("z", 29, 1013))])


@query(
    "inside_mesh",
    f"with {_UNITS}, {_FACES}, {_AT}, n as (select id, count(*) n from q join f on {mesh.CROSSED} group by id) select id, coalesce(n, 0)::bigint crossings, coalesce(n % 2 = 1, false) inside from q left join n using (id)",
)
def inside_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' points against the octahedra of the supplier spheres: faces over each, and whether that makes it inside."""
    points, faces = _points(spark, sf_dir), mesh.octahedra(spheres(spark, sf_dir))
    n = mesh.crossings(points, faces)
    return points.join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("crossings"), F.coalesce(F.col("n") % 2 == 1, F.lit(False)).alias("inside"))


@query(
    "nearest_face",
    f"with {_UNITS}, {_FACES}, {_AT}, d as (select id, face, sqrt({mesh.SQUARED}) d from q, f) select id, round(min(d), 8) distance from d group by id",
)
def nearest_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each point to the octahedra's faces. Corners are shared, so which face it is may be chance; the distance isn't."""
    return mesh.nearest_face(_points(spark, sf_dir), mesh.octahedra(spheres(spark, sf_dir))).select("id", F.round("distance", 8).alias("distance"))


@query(
    "mesh_occupancy",
    f"""{_COVER}, {_FACES}, w as (select v.id, v.x + 0.5::double x, v.y + 0.5::double y, v.z + 0.5::double z, c.n is not null pore from v left join c on c.x = v.x and c.y = v.y and c.z = v.z),
n as (select id, count(*) n from w join f on {mesh.CROSSED} group by id)
select count(*) n, round(count(*) filter (coalesce(n % 2 = 1, false) <> pore) / count(*)::double, 9) mismatch from w left join n using (id)""",
)
def mesh_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the spheres' phase that the octahedra's surface puts on the other side."""
    out = mesh.occupancy_mismatch(_phase(spark, sf_dir), mesh.octahedra(spheres(spark, sf_dir)))
    return out.select("n", F.round("mismatch", 9).alias("mismatch"))


@query("surface_summary")
def surface_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces, area and volume of the supplier phase's surface, by slabs of three layers; tests hold it against the kernel that takes the phase whole."""
    voxels = drawn(spark, sf_dir).select(F.lit(0).alias("run_id"), "x", "y", "z", F.lit(True).alias("pore"))
    out = surface.summary(surface.triangles(packed(voxels, SHAPE), SHAPE, 1.0, 3))
    return out.select("run_id", "faces", F.round("area", 6).alias("area"), F.round("volume", 6).alias("volume"), "open_edges")
