"""The closed surface of a phase, slab by slab: triangles as rows, shared vertices numbered over all of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import kernels as K
from voxlake.operators.mesh import CORNERS
from voxlake.operators.ordered import ranked
from voxlake.tables import written

#: Voxels of a slab that a task holds.
CELLS = 1 << 24
KEYS = [f"k{c}" for c in CORNERS]


def triangles(slabs: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0, thick: int | None = None) -> DataFrame:
    """run_id, face, the corners x1 .. z3 (see operators.mesh), and k<corner>, their places in whole half voxels before they are moved onto the box, of slab(run_id, z, mask).

    A slab holds so many layers of cubes between slices, and the one slice more that its last layer needs; each cube is
    cut in one slab only, so that the triangles are the same whatever a slab holds. Outside the box all is solid.
    """
    nx, ny, nz = shape
    kind = dict(slabs.dtypes)["run_id"]
    thick = thick or max(1, CELLS // (nx * ny))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        run_id, slab = key
        first = slab * thick  # the layer of cubes k lies between the slices k - 1 and k
        layers = min(thick, nz + 1 - first)
        inside = np.zeros((layers + 1, ny + 2, nx + 2), bool)
        for z, raw in zip(frame["z"], frame["mask"], strict=True):
            inside[int(z) - first + 1, 1:-1, 1:-1] = np.unpackbits(np.frombuffer(raw, np.uint8))[: nx * ny].reshape(ny, nx)
        found = K.surface_triangles(inside) + np.array([0, 0, 2 * first])
        place = np.clip(found / 2 - 0.5, 0, np.array(shape, float)) * spacing
        out = pd.DataFrame(place.reshape(-1, 9), columns=CORNERS)
        out.insert(0, "run_id", run_id)
        out.insert(1, "face", np.int64(slab << 40) + np.arange(len(found)))
        return pd.concat([out, pd.DataFrame(found.reshape(-1, 9), columns=KEYS)], axis=1)

    needed = F.array_distinct(F.array(F.floor(F.col("z") / thick), F.floor((F.col("z") + 1) / thick)))
    dealt = slabs.select("run_id", "z", "mask", F.explode(needed).alias("slab"))
    return dealt.groupBy("run_id", "slab").applyInPandas(run, f"run_id {kind}, face bigint, " + ", ".join(f"{c} double" for c in CORNERS) + ", " + ", ".join(f"{c} int" for c in KEYS))


def indexed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run_id, vertex, x, y, z) and (run_id, face, a, b, c) of triangles(): every vertex once, numbered from 0 in the order of its place, over all slabs of a run."""
    corners = [F.struct(*[F.col(f"k{c}{v}").alias(f"k{c}") for c in "xyz"], *[F.col(f"{c}{v}").alias(c) for c in "xyz"]) for v in "123"]
    each = found.select("run_id", F.explode(F.array(*corners)).alias("p")).select("run_id", "p.*")
    vertices = written(ranked(each.distinct(), ["run_id"], ["kz", "ky", "kx"]).drop("n").withColumnRenamed("rank", "vertex"), "vertices")
    faces = found.select("run_id", "face", *KEYS)
    for v, name in zip("123", "abc", strict=True):
        number = vertices.select("run_id", *[F.col(f"k{c}").alias(f"k{c}{v}") for c in "xyz"], F.col("vertex").alias(name))
        faces = faces.join(number, ["run_id", *[f"k{c}{v}" for c in "xyz"]])
    return vertices.select("run_id", "vertex", "x", "y", "z"), faces.select("run_id", "face", "a", "b", "c")


def summary(found: DataFrame) -> DataFrame:
    """run_id, faces, area, volume and open_edges: edges that aren't gone through as often one way as the other, 0 for a closed surface."""
    def corner(v: str) -> list:
        return [F.col(f"{c}{v}") for c in "xyz"]

    a, b, c = (corner(v) for v in "123")
    u, w = ([q - p for p, q in zip(a, other, strict=True)] for other in (b, c))
    cross = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    six = a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    sizes = found.groupBy("run_id").agg(F.count("*").alias("faces"), F.sum(area).alias("area"), (F.sum(six) / 6).alias("volume"))
    key = {v: F.struct(*[F.col(f"k{c}{v}").alias(c) for c in "xyz"]) for v in "123"}
    edges = found.select("run_id", F.explode(F.array(*[F.struct(key[p].alias("p"), key[q].alias("q")) for p, q in ("12", "23", "31")])).alias("e")).select("run_id", "e.p", "e.q")
    way = F.when(F.col("p") < F.col("q"), 1).otherwise(-1)
    uneven = edges.groupBy("run_id", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.sum(way).alias("n")).groupBy("run_id").agg(F.count_if(F.col("n") != 0).alias("open_edges"))
    return sizes.join(uneven, "run_id")


def ply_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """section, place and value: the lines of an ASCII PLY file of one run, in order of section and place."""
    spark = vertices.sparkSession
    counts = [vertices.count(), faces.count()]
    head = ["ply", "format ascii 1.0", f"element vertex {counts[0]}", *[f"property float {c}" for c in "xyz"], f"element face {counts[1]}", "property list uchar int vertex_indices", "end_header"]
    first = spark.createDataFrame([(0, i, line) for i, line in enumerate(head)], "section int, place bigint, value string")
    points = vertices.select(F.lit(1).alias("section"), F.col("vertex").alias("place"), F.format_string("%.6f %.6f %.6f", "x", "y", "z").alias("value"))
    return first.unionByName(points).unionByName(faces.select(F.lit(2).alias("section"), F.col("face").alias("place"), F.format_string("3 %d %d %d", "a", "b", "c").alias("value")))


def write_ply(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Text parts whose names are in the order of the file, which they are one after another; each is a range of the lines, so no task writes all."""
    ply_lines(vertices, faces).orderBy("section", "place").select("value").write.mode("overwrite").text(path)
