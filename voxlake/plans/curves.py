"""Queries on pair distance curves and on channels' curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.functions.kernels import SOBOL_BITS, sobol_directions
from voxlake.operators import curves as C
from voxlake.operators import pair_curve as P
from voxlake.plans.catalog import _TRACKS, _image, _tracks, centers, query
from voxlake.tables import written

BOX, WIDTH, BINS = (100.0, 100.0, 100.0), 5.0, 10
_WANTED = [{"kind": "peak", "amplitude": 0.6, "center": 22.0, "width": 6.0}, {"kind": "exclusion", "amplitude": 0.8, "center": 0.0, "width": 8.0}]


def _sobol_sql(d: int) -> str:
    out = "0"
    for i, v in enumerate(sobol_directions(d)[: P.MOST_PAIRS.bit_length() - 1]):
        out = f"xor({out}, case when g & {1 << i} > 0 then {v} else 0 end)"
    return f"{out} / {float(1 << SOBOL_BITS)}::double * {BOX[d % 3]}::double"


def _distance(a: str, b: str) -> str:
    dx, dy = (_image(f"{a.format(c=c)} - {b.format(c=c)}", side) for c, side in zip("xy", BOX, strict=False))
    dz = f"({a.format(c='z')} - {b.format(c='z')})"
    return f"sqrt({dx} * {dx} + {dy} * {dy} + {dz} * {dz})"


_BIN = f"(case when d = {WIDTH * BINS} then {BINS - 1} else floor(d / {WIDTH}::double) end)::int"
_CURVE = f"""p as (select c_nationkey run_id, c_custkey id, ((c_custkey*37)%1000)/10.0::double x, ((c_custkey*61)%997)/10.0::double y, ((c_custkey*29)%991)/10.0::double z from customer),
e as (select i, {', '.join(f"{_sobol_sql(k)} {n}" for k, n in enumerate(('x1', 'y1', 'z1', 'x2', 'y2', 'z2')))} from (select i, xor(i, i >> 1) g from range({P.MOST_PAIRS}) t(i))),
h as (select level, {_BIN} bin, count(*) c from (select greatest({P.FEWEST_PAIRS}, case when i = 0 then 2 else 2 << floor(log2(i + 0.5))::int end) level, {_distance('{c}1', '{c}2')} d from e) where d <= {WIDTH * BINS} group by all),
o as (select run_id, {_BIN} bin, count(*) n from (select a.run_id, {_distance('a.{c}', 'b.{c}')} d from p a join p b on a.run_id = b.run_id and a.id < b.id) where d <= {WIDTH * BINS} group by all),
s as (select run_id, n * (n - 1) / 2.0::double pairs from (select run_id, count(*) n from p group by 1)),
t as (select run_id, pairs, least(greatest(pow(2, floor(log2(greatest(pairs, 1) + 0.5))), {P.FEWEST_PAIRS}), {P.MOST_PAIRS})::bigint take from s),
r as (select run_id, b::int bin, coalesce((select sum(c) from h where h.bin = b and h.level <= take), 0) * pairs / take reference from t, range({BINS}) x(b)),
q as (select run_id, bin, coalesce(n, 0) n, reference, case when reference > 0 then coalesce(n, 0) / reference end ratio from r left join o using (run_id, bin)),
g as (select run_id, bin, n, reference, coalesce(ratio, 0) / case when avg(ratio) over (partition by run_id) > 0 then avg(ratio) over (partition by run_id) else 1 end g from q)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = centers(spark, sf_dir).select("run_id", F.col("unit_id").alias("id"), "x", "y", "z")
    return P.pair_curve(points, BOX, WIDTH, BINS)


@query("pair_curve", f"with {_CURVE} select run_id, bin, n::bigint n, round(reference, 6) reference, round(g, 8) g from g")
def pair_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair curves of the nations' films over Sobol pairs, with a mean of 1."""
    return _curve(spark, sf_dir).select("run_id", "bin", F.col("n").cast("bigint").alias("n"), F.round("reference", 6).alias("reference"), F.round("g", 8).alias("g"))


_TARGET = "greatest(0, 1 + 0.6::double * exp(-0.5 * pow((5.0 * bin + 2.5 - 22) / 6.0::double, 2)) - 0.8::double * exp(-0.5 * pow((5.0 * bin + 2.5) / 8.0::double, 2)))"


def _loss_sql(g: str) -> str:
    return f"(select run_id, case when sum(n) > 0 then sum(greatest(w, 1e-12) * ({g} - w) * ({g} - w)) / sum(greatest(w, 1e-12)) else 'inf'::double end loss from w group by 1)"


@query(
    "pair_curve_loss",
    f"""with {_CURVE}, b as (select *, coalesce(n / avg(case when n > 0 then n end) over (partition by run_id), 0) bare from g),
w as (select *, {_TARGET} w, lag(g) over u a, lead(g) over u z from b window u as (partition by run_id order by bin)),
k as (select run_id, coalesce(list(bin order by bin) filter (g > 0 and g >= coalesce(a, 0) and g >= coalesce(z, 0)), []) peaks from w group by 1)
select run_id, round(l.loss, 7) loss, round(m.loss, 7) bare_loss, peaks from k join {_loss_sql('g')} l using (run_id) join {_loss_sql('bare')} m using (run_id)""",
)
def pair_curve_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each film's curve is from a wanted one, with and without the reference, and where its peaks are."""
    curve = written(_curve(spark, sf_dir), "curve")
    target = G.target_curve(WIDTH * F.col("bin") + WIDTH / 2, _WANTED)
    full, bare = (P.losses(c.withColumn("target", target)) for c in (curve, P.bare_curve(curve)))
    return full.join(bare.select("run_id", F.col("loss").alias("bare_loss")), "run_id").select("run_id", F.round("loss", 7).alias("loss"), F.round("bare_loss", 7).alias("bare_loss"), "peaks")


@query(
    "curve_facts",
    f"""with {_TRACKS}, p as (select user_id, t, event_id, t / 3600.0::double x, value y, (event_id % 100)::double z, 1 + (event_id % 7) / 10.0::double r from e),
a as (select *, row_number() over w i, lead(x) over w - x dx, lead(y) over w - y dy, lead(z) over w - z dz, lead(r) over w r1 from p window w as (partition by user_id order by t, event_id)),
s as (select *, sqrt(dx * dx + dy * dy + dz * dz) step from a),
b as (select *, lag(dx) over w bx, lag(dy) over w by_, lag(dz) over w bz, lag(step) over w bs from s window w as (partition by user_id order by i)),
f as (select user_id, count(*) points, sum(step) arc, sum(pi() * step * (r * r + r1 * r1) / 2) volume, stddev_pop(r) / avg(r) radius_cv, min(r) / max(r) radius_ratio,
  count(*) filter (step * bs > 0 and acos(greatest(-1, least(1, (dx * bx + dy * by_ + dz * bz) / nullif(step * bs, 0)))) > {C.BEND}) bend_count,
  sqrt(pow(arg_max(x, i) - arg_min(x, i), 2) + pow(arg_max(y, i) - arg_min(y, i), 2) + pow(arg_max(z, i) - arg_min(z, i), 2)) chord,
  covar_pop(x, x) xx, covar_pop(y, y) yy, covar_pop(z, z) zz, covar_pop(x, y) xy, covar_pop(x, z) xz, covar_pop(y, z) yz from b group by 1),
q as (select *, (xx + yy + zz) / 3 q from f), c as (select *, xx - q a, yy - q b, zz - q d from q),
g as (select *, sqrt((a * a + b * b + d * d + 2 * (xy * xy + xz * xz + yz * yz)) / 6) p from c),
h as (select *, acos(greatest(-1, least(1, (a * (b * d - yz * yz) - xy * (xy * d - yz * xz) + xz * (xy * yz - b * xz)) / (2 * p * p * p)))) / 3 phi from g)
select user_id, points, round(coalesce(arc, 0), 5) arc, round(chord, 5) chord, round(coalesce(volume, 0), 3) volume, round(radius_cv, 9) radius_cv, round(radius_ratio, 9) radius_ratio, bend_count,
  round(case when points < 3 or q <= 0 then 0 when p <= 0 then 1 else sqrt(greatest(q + 2 * p * cos(phi + 2 * pi() / 3), 0) / (q + 2 * p * cos(phi))) end, 6) nonplanarity from h""",
)
def curve_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as curves in time, value and place, with a radius: length, swept volume, bends and flatness."""
    rows = _tracks(spark, sf_dir).select("user_id", F.struct("t", "event_id").alias("idx"), (F.col("t") / 3600.0).alias("x"), F.col("value").alias("y"), (F.col("event_id") % 100).cast("double").alias("z"), (1 + (F.col("event_id") % 7) / 10.0).alias("radius"))
    digits = {"arc": 5, "chord": 5, "volume": 3, "radius_cv": 9, "radius_ratio": 9, "nonplanarity": 6}
    return C.facts(rows, ["user_id"]).select("user_id", "points", "bend_count", *[F.round(c, d).alias(c) for c, d in digits.items()])
