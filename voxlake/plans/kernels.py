"""Queries whose kernels SQL doesn't have; each is held against a plain version in the tests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import distributions as D
from voxlake.functions import kernels as K
from voxlake.operators import curves, distance, statistics
from voxlake.plans import generate, measure
from voxlake.plans.catalog import _COVER, BOX, SHAPE, drawn, query
from voxlake.tables import table


def _ks(name: str, column: str, spec: dict):
    @query(name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statistics.ks_distance(table(spark, sf_dir, "lineitem").select(column), column, D.cdf_udf(spec)).select(F.round("ks", 9).alias("ks"))


_ks("ks_beta", "l_discount", {"family": "beta", "alpha": 1.2, "beta": 1.2, "scale": 0.1})
_ks("ks_gamma", "l_extendedprice", {"family": "gamma", "alpha": 2.0, "scale": 18000.0})
_ks("ks_lognormal", "l_extendedprice", {"family": "lognormal", "mu": 10.3, "sigma": 0.8})


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier phase as one run."""
    return drawn(spark, sf_dir).select(F.lit(0).alias("run_id"), "x", "y", "z", F.lit(True).alias("pore"))


def _slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.packed(_voxels(spark, sf_dir), SHAPE)


@query("edt_centers")
def edt_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.slice_centers(_slabs(spark, sf_dir), SHAPE, 1.0).select("z_index", F.posexplode("centers").alias("i", "c"))
    return found.select("z_index", "i", *[F.round(f"c.{n}", 6).alias(n) for n in ("x", "y", "wall")])


@query("hungarian_tracks")
def hungarian_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = measure.track_points(measure.slice_centers(_slabs(spark, sf_dir), SHAPE, 1.0), SHAPE, 1.0)
    return points.select("track_id", "z_index", *[F.round(c, 6).alias(c) for c in ("x", "y", "wall")], "branch")


@query("normal_sections")
def normal_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure.measure(_voxels(spark, sf_dir), SHAPE)["sections"]
    return out.select("track_id", F.round("arc", 6).alias("arc"), "valid", "invalid_reason", F.round("area", 3).alias("area"), F.round("diameter", 3).alias("diameter"))


@query("channel_geometry")
def channel_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = measure.measure(_voxels(spark, sf_dir), SHAPE)["channels"]
    return out.select("track_id", "valid", "invalid_reason", *[F.round(c, 4).alias(c) for c in ("diameter", "eta", "tau")])


@query("marching_squares")
def marching_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours of each slice: how many, and the areas they enclose."""

    def run(frames):
        for frame in frames:
            rings = [K.contours(np.unpackbits(np.frombuffer(m, np.uint8))[: BOX * BOX].reshape(BOX, BOX).astype(float)) for m in frame["mask"]]
            yield pd.DataFrame({"z": frame["z"], "contours": [len(r) for r in rings], "area": [round(sum(abs(K.polygon_area(c)) for c in r), 6) for r in rings]})

    return _slabs(spark, sf_dir).mapInPandas(run, "z int, contours int, area double")


def _apart(a: str, b: str) -> str:
    """Squared distance of two voxels, x and y around the border."""
    short = " + ".join(f"pow(least(abs({a}.{c} - {b}.{c}), {BOX} - abs({a}.{c} - {b}.{c})), 2)" for c in "xy")
    return f"({short} + pow({a}.z - {b}.z, 2))"


_NEAR = f"""{_COVER}, p as materialized (select v.id, v.x, v.y, v.z from v where exists (select 1 from c where c.x = v.x and c.y = v.y and c.z = v.z)),
q as materialized (select x, y, z from v where not exists (select 1 from c where c.x = v.x and c.y = v.y and c.z = v.z)),
d as materialized (select p.id, p.x, p.y, p.z, min({_apart('p', 'q')}) d2 from p, q group by all)"""


@query("squared_distances", f"{_NEAR} select x, y, z, d2::bigint d2 from d")
def squared_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of every pore voxel to the solid."""
    return distance.squared_distances(_slabs(spark, sf_dir), SHAPE).select("x", "y", "z", "d2")


@query(
    "local_thickness",
    f"{_NEAR}, t as (select a.id, max(b.d2) r2 from d a, d b where {_apart('a', 'b')} < b.d2 group by a.id) select round(2 * sqrt(r2), 6) diameter, count(*) n from t group by 1",
)
def local_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest fitting diameter at every pore voxel, counted."""
    return distance.local_thickness(_slabs(spark, sf_dir), SHAPE).groupBy(F.round("diameter", 6).alias("diameter")).agg(F.count("*").alias("n"))


def _of_triplets(spark: SparkSession, sf_dir: str, name: str, least: int, measured: Callable[[np.ndarray], float]) -> DataFrame:
    """vec_id and `measured` of all whole triplets of each vector; null for vectors with fewer than `least` and for those that are null or hold null or non-finite components."""

    def of(v) -> float | None:
        x = np.array([] if v is None else v, float)  # nulls are NaN
        points = x[: len(x) // 3 * 3].reshape(-1, 3)
        return round(measured(points), 6) if len(points) >= least and np.isfinite(x).all() else None

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], name: pd.Series([of(v) for v in frame["embedding"]], dtype=float)})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, f"vec_id bigint, {name} double")


@query("kabsch_rmsd")
def kabsch_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of the first half of each vector's triplets from the second, as point sets; the middle one of an odd number is in both."""
    return _of_triplets(spark, sf_dir, "rmsd", 2, lambda p: K.kabsch_rmsd(p[: (len(p) + 1) // 2], p[len(p) // 2 :]))


@query(
    "nonplanarity",
    """with e as (select row_number() over () rid, vec_id, len(embedding) n, list_transform(embedding, lambda x: x::double) v, len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))) sound from embeddings),
p as (select rid, v[3 * i + 1] x, v[3 * i + 2] y, v[3 * i + 3] z from (select rid, v, unnest(range(n // 3)) i from e where sound)),
c as (select rid, count(*) n, covar_pop(x, x) xx, covar_pop(y, y) yy, covar_pop(z, z) zz, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, z) yz from p group by 1),
q as (select *, (xx + yy + zz) / 3 q from c), a as (select *, xx - q a, yy - q b, zz - q d from q),
r as (select *, sqrt((a * a + b * b + d * d + 2 * (xy * xy + xz * xz + yz * yz)) / 6) p from a),
f as (select *, acos(greatest(-1, least(1, (a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)) / (2 * p * p * p)))) / 3 phi from r)
select vec_id, round(case when f.n is null then null when f.n < 3 or q <= 0 then 0 when p <= 0 then 1 else sqrt(greatest(q + 2 * p * cos(phi + 2 * pi() / 3), 0) / (q + 2 * p * cos(phi))) end, 6) nonplanarity from e left join f using (rid)""",
)
def nonplanarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all whole triplets of each vector; null for vectors without one and those that hold null or non-finite components."""
    v = F.col("v")
    n = F.floor(F.size(v) / 3).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(v) >= 3)
    at = F.sequence(F.lit(0), n - 1)
    parts = rows.withColumn("n", F.when(sound, n))
    add = lambda acc, x: acc + x
    for k, c in enumerate("xyz"):
        parts = parts.withColumn(c, F.when(sound, F.transform(at, lambda i: F.get(v, 3 * i + k))))  # noqa: B023
        parts = parts.withColumn(f"m{c}", F.aggregate(c, F.lit(0.0), add) / F.col("n"))
        parts = parts.withColumn(c, F.transform(c, lambda x: x - F.col(f"m{c}")))  # noqa: B023
    spreads = [F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), add) / F.col("n") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    held = parts.select("vec_id", "n", *[s.alias(f"s{i}") for i, s in enumerate(spreads)])
    flat = F.when(F.col("n") < 3, 0.0).when(F.col("n").isNotNull(), curves.flatness(*[F.col(f"s{i}") for i in range(6)]))
    return held.select("vec_id", F.round(flat, 6).alias("nonplanarity"))


#: A small film for the candidate query.
CONFIG = {"box": [10, 10, 10], "spacing": 1.0, "count": 3, "porosity": 0.15, "lattice": "bcc", "jitter": 0.3, "diameter": {"family": "constant", "value": 4.0}, "channel_fraction": 0.34}


@query("candidate_eval")
def candidate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per region, seeded by its key: one task each, audited against CONFIG, failures as rows."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("sequence_index"), (F.col("r_regionkey").cast("bigint") * 7919 + 17).alias("seed"))
    out = generate.evaluated(seeds, CONFIG)
    return out.select("sequence_index", "seed", "succeeded", F.round("porosity", 6).alias("porosity"), "audit_passed", "units", "failure_type", F.round("scale", 6).alias("scale"), "components", "warnings")
