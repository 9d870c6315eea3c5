"""Every query of the library outside the optional subpackage, with its DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.operators import graph, ordered, pairs, reconcile, statistics, voxels
from voxlake.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BOX = 20  # voxels a side of the lattice that supplier spheres are drawn in
SHAPE = (BOX, BOX, BOX)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows as spheres: centres by key arithmetic, radii from the clamped balance."""
    k = F.col("s_suppkey")
    centre = [((k * m) % BOX + 0.5).cast("double").alias(c) for c, m in (("cx", 7), ("cy", 11), ("cz", 13))]
    radius = F.greatest(F.lit(0.5), F.least(F.lit(2.5), F.col("s_acctbal") / 4000.0)).alias("r")
    return table(spark, sf_dir, "supplier").select(k.alias("id"), *centre, radius)


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as centres of their nations' films."""
    k = F.col("c_custkey")
    place = [((k * m) % q / 10.0).alias(c) for c, m, q in (("x", 37, 1000), ("y", 61, 997), ("z", 29, 991))]
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("run_id"), k.alias("unit_id"), (F.col("c_nationkey") + 20260000).cast("bigint").alias("seed"), *place)


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.covered(spheres(spark, sf_dir), SHAPE)


_UNITS = f"s as (select s_suppkey id, (s_suppkey*7)%{BOX}+0.5::double cx, (s_suppkey*11)%{BOX}+0.5::double cy, (s_suppkey*13)%{BOX}+0.5::double cz, greatest(0.5::double, least(2.5::double, s_acctbal/4000.0::double)) r from supplier)"
_V = f"v as (select i id, (i%{BOX})::int x, ((i//{BOX})%{BOX})::int y, (i//{BOX * BOX})::int z from range({BOX**3}) t(i))"


def _image(d: str, side: float) -> str:
    return f"(({d}) - {side}::double * round_even(({d}) / {side}::double, 0))"


_D2 = f"(pow({_image('x+0.5::double-cx', BOX)},2) + pow({_image('y+0.5::double-cy', BOX)},2) + pow(z+0.5::double-cz,2))"
_COVER = f"with {_UNITS}, {_V}, c as (select x, y, z, count(*) n from v join s on {_D2} < r*r group by all)"


@query(
    "porosity_and_sections",
    f"""{_COVER}, sec as (select i::int x, 1.0::double - (select count(*) from c where c.x = i) / {float(BOX * BOX)}::double solid from range({BOX}) t(i))
select round((select count(*) from c) / {float(BOX**3)}::double, 9) porosity, round(min(solid), 9) min_section, arg_min(x, (solid, x)) min_section_x from sec""",
)
def porosity_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voxels.porosity_and_sections(drawn(spark, sf_dir), SHAPE)
    return out.select(F.round("porosity", 9).alias("porosity"), F.round("min_section", 9).alias("min_section"), "min_section_x")


@query(
    "surface_openings",
    f"""{_COVER} select {', '.join(f"round(count(*) filter ({c} = {at}) / {float(BOX * BOX)}::double, 9) {c}_{side}" for c in 'xyz' for side, at in (('low', 0), ('high', BOX - 1)))} from c""",
)
def surface_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = voxels.surface_openings(drawn(spark, sf_dir), SHAPE)
    return out.select([F.round(c, 9).alias(c) for c in out.columns])


@query(
    "overlap_fraction",
    f"""{_COVER} select round(count(*) filter (n > 1) / {float(BOX**3)}::double, 9) overlap_fraction, round(count(*) filter (n > 1) / count(*)::double, 9) overlap_of_pore, max(n) most_units from c""",
)
def overlap_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.overlap_fraction(drawn(spark, sf_dir), SHAPE).select(F.round("overlap_fraction", 9).alias("overlap_fraction"), F.round("overlap_of_pore", 9).alias("overlap_of_pore"), "most_units")


@query("coverage_by_voxel", f"{_COVER} select x::int x, y::int y, z::int z, n from c")
def coverage_by_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir).select("x", "y", "z", "n")


@query(
    "sphere_field_slab",
    f"""with {_UNITS}, {_V} select id::bigint id, round(min(sqrt({_D2}) - r), 8) sdf from v cross join (select cx, cy, cz, r from s) group by id""",
)
def sphere_field_slab(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = voxels.lattice(spark, BOX, BOX, BOX)
    return voxels.sphere_field(points, spheres(spark, sf_dir), (BOX, BOX)).select("id", F.round("sdf", 8).alias("sdf"))


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer points in a plane of 100 x 100, slice by nation."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_nationkey").alias("slice"), ((k * 37) % 1000 / 10.0).alias("x"), ((k * 61) % 997 / 10.0).alias("y"), "c_acctbal")


_SPOTS = "p as (select c_custkey id, c_nationkey slice, ((c_custkey*37)%1000)/10.0::double x, ((c_custkey*61)%997)/10.0::double y, c_acctbal from customer)"
_PLANE = f"sqrt({_image('a.x-b.x', 100)}*{_image('a.x-b.x', 100)} + {_image('a.y-b.y', 100)}*{_image('a.y-b.y', 100)})"


@query(
    "pair_distance_hist",
    f"""with {_UNITS}, d as (select sqrt({_image('a.cx-b.cx', BOX)}*{_image('a.cx-b.cx', BOX)} + {_image('a.cy-b.cy', BOX)}*{_image('a.cy-b.cy', BOX)} + (a.cz-b.cz)*(a.cz-b.cz)) d from s a join s b on a.id < b.id)
select (case when d = 8 then 7 else floor(d) end)::int bin, count(*) n from d where d <= 8 group by all""",
)
def pair_distance_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spheres(spark, sf_dir).select("id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return pairs.pair_histogram(points, 1.0, 8, (BOX, BOX))


@query(
    "gxy_by_slice",
    f"""with {_SPOTS}, d as (select {_PLANE} d from p a join p b on a.slice = b.slice and a.id < b.id),
h as (select (case when d = 30 then 5 else floor(d / 5.0::double) end)::int bin, count(*) n from d where d <= 30 group by all),
t as (select sum(n * (n - 1) / 2)::double pairs from (select count(*)::double n from p group by slice)),
r as (select i::int bin, pairs * pi() * (pow(5.0*(i+1), 2) - pow(5.0*i, 2)) / 10000.0::double reference from range(6) x(i), t)
select bin, coalesce(n, 0)::bigint n, round(reference, 6) reference, round(case when reference > 0 then coalesce(n, 0) / reference else 0 end, 9) g from r left join h using (bin)""",
)
def gxy_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _spots(spark, sf_dir)
    counts = pairs.pair_histogram(points.select("id", "slice", "x", "y"), 5.0, 6, (100, 100), "slice").groupBy("bin").agg(F.sum("n").alias("n"))
    n = F.count("*").cast("double")
    total = points.groupBy("slice").agg((n * (n - 1) / 2).alias("pairs")).agg(F.sum("pairs").alias("pairs"))
    k = F.col("bin").cast("double")
    ring = (F.pow(5.0 * (k + 1), F.lit(2.0)) - F.pow(5.0 * k, F.lit(2.0))) / 10000.0
    reference = spark.range(6).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(total)).select("bin", (F.col("pairs") * F.pi() * ring).alias("reference"))  # one row
    return pairs.normalised_counts(counts, reference).select("bin", F.col("n").cast("bigint").alias("n"), F.round("reference", 6).alias("reference"), F.round("g", 9).alias("g"))


@query("range_join_cells", f"with {_SPOTS} select a.id a, b.id b, round({_PLANE}, 9) distance from p a join p b on a.id < b.id where {_PLANE} <= 2.0")
def range_join_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pairs_within(_spots(spark, sf_dir).select("id", "x", "y"), 2.0, (100, 100)).select("a", "b", F.round("distance", 9).alias("distance"))


_CENTRES = "c as (select s_suppkey id, ((s_suppkey*53)%1000)/10.0::double x, ((s_suppkey*71)%991)/10.0::double y from supplier)"


@query(
    "nearest_center_weighted_mean",
    f"""with {_SPOTS}, {_CENTRES}, n as (select a.id, a.x, a.y, a.c_acctbal, arg_min(b.id, ({_PLANE}, b.id)) center from p a, c b group by all)
select center, count(*) n, round(sum(c_acctbal*c_acctbal*x)/sum(c_acctbal*c_acctbal), 6) x, round(sum(c_acctbal*c_acctbal*y)/sum(c_acctbal*c_acctbal), 6) y from n group by center""",
)
def nearest_center_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    centres = table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 53) % 1000 / 10.0).alias("x"), ((k * 71) % 991 / 10.0).alias("y"))
    near = pairs.nearest_center(_spots(spark, sf_dir), centres, (100, 100), 4.0)
    means = pairs.weighted_centroids(near, "center", F.col("c_acctbal") * F.col("c_acctbal"), ["x", "y"])
    return near.groupBy("center").agg(F.count("*").alias("n")).join(means, "center").select("center", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of a track per user: t in seconds since 2024, value and place in order."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ((ts - 1704067200000000) / 1000000.0).alias("t"))


_TRACKS = "e as (select event_id, user_id, event_type, value, (epoch_us(ts) - 1704067200000000) / 1000000.0::double t from events)"


@query(
    "asof_interpolate",
    f"""with {_TRACKS}, w as (select *, lead(t) over q t1, lead(value) over q v1 from e window q as (partition by user_id order by t, event_id)),
g as (select *, unnest(generate_series(ceil(t / 21600.0::double)::bigint, (case when t1 is null then floor(t / 21600.0::double) else ceil(t1 / 21600.0::double) - 1 end)::bigint)) k from w)
select user_id, k * 21600.0::double s, round(case when t1 is null then value else value + (v1 - value) * (k * 21600.0::double - t) / (t1 - t) end, 6) as value from g""",
)
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.interpolated(_tracks(spark, sf_dir), "user_id", ["t", "event_id"], "t", "value", 21600.0)
    return out.select("user_id", "s", F.round("value", 6).alias("value"))


@query(
    "interval_exclusion",
    f"""with {_TRACKS} select a.event_id, a.user_id, exists (select 1 from e b where b.user_id = a.user_id and b.event_type = 'error' and abs(a.t - b.t) <= 3600) excluded from e a""",
)
def interval_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.near_event(_tracks(spark, sf_dir), "user_id", "t", ["t", "event_id"], F.col("event_type") == "error", 3600.0)
    return out.select("event_id", "user_id", "excluded")


@query(
    "semi_through_tracks",
    """with d as (select user_id, min(ts::date) a, max(ts::date) b from events group by 1), m as (select min(ts::date) a, max(ts::date) b from events)
select event_id, user_id from events where user_id in (select user_id from d, m where d.a = m.a and d.b = m.b)""",
)
def semi_through_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    ends = events.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    through = events.groupBy("user_id").agg(F.min("day").alias("a"), F.max("day").alias("b")).crossJoin(F.broadcast(ends)).where("a = first and b = last")  # one row
    return reconcile.with_key(events, through, "user_id").select("event_id", "user_id")


@query("anti_non_pore", "select p_partkey, p_brand from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 48)")
def anti_non_pore(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return reconcile.without_key(table(spark, sf_dir, "part"), full, "p_partkey").select("p_partkey", "p_brand")


@query(
    "reconcile_tolerance",
    """with l as (select l_orderkey k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 6) e from lineitem group by 1), o as (select o_orderkey k, o_totalprice r from orders)
select k as orderkey, r as reported, e as expected, case when o.k is null then 'missing' when l.k is null then 'unexpected' when abs(r - e) > 0.01 + 0.5 * abs(e) then 'mismatch' else 'ok' end status from o full join l using (k)""",
)
def reconcile_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.round(F.sum(price), 6).alias("total"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("total"))
    return reconcile.reconciled(orders, lines, ["orderkey"], "total", 0.01, 0.5)


@query(
    "point_in_cell",
    f"""{_COVER}, q as (select c_custkey id, ((c_custkey*37)%1000)/50.0::double px, ((c_custkey*61)%997)/50.0::double py, ((c_custkey*29)%1013)/50.0::double pz from customer),
i as (select id, floor(px)::int % {BOX} x, floor(py)::int % {BOX} y, floor(pz)::int z from q where pz < {BOX})
select id, i.x, i.y, i.z, n is not null as inside from i left join c on c.x = i.x and c.y = i.y and c.z = i.z""",
)
def point_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), *[((k * m) % q / 50.0).alias(c) for c, m, q in (("px", 37, 1000), ("py", 61, 997), ("pz", 29, 1013))])
    at = points.select("id", *[G.voxel_index(f"p{c}", 0.0, 1.0, BOX, c != "z").cast("int").alias(c) for c in "xyz"]).where("z is not null")
    return at.join(drawn(spark, sf_dir), ["x", "y", "z"], "left").select("id", "x", "y", "z", F.col("n").isNotNull().alias("inside"))


@query(
    "segment_clearance",
    f"""with {_TRACKS}, o as (select user_id, row_number() over (partition by user_id order by t, event_id) i, t / 86400.0::double x, value / 10.0::double y from e)
select a.user_id, round(min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))), 9) clearance from o a join o b on a.user_id = b.user_id and b.i >= a.i + 2 group by 1""",
)
def segment_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.operators.tracks import vertex_clearance

    points = _tracks(spark, sf_dir).select("user_id", "t", "event_id", (F.col("t") / 86400.0).alias("x"), (F.col("value") / 10.0).alias("y"))
    return vertex_clearance(points, "user_id", ["t", "event_id"], ["x", "y"]).select("user_id", F.round("clearance", 9).alias("clearance"))


_WRAP = f"""{_TRACKS}, m as (select user_id, event_id, t, (value - 100.0::double * floor(value / 100.0::double)) w from e),
s as (select *, coalesce(w - lag(w) over q, 0) d0, first(w) over q f from m window q as (partition by user_id order by t, event_id)),
d as (select *, {_image('d0', 100)} d from s)"""


@query(
    "unwrap_tracks",
    f"""with {_WRAP} select event_id, user_id, round(f + sum(d) over q, 6) unwrapped, round(sum(abs(d)) over q, 6) arc from d window q as (partition by user_id order by t, event_id rows unbounded preceding)""",
)
def unwrap_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracks(spark, sf_dir).withColumn("w", F.col("value") - 100.0 * F.floor(F.col("value") / 100.0))
    out = ordered.unwrapped(rows, "user_id", ["t", "event_id"], "w", 100.0)
    out = ordered.arc_length(out, "user_id", ["t", "event_id"], F.abs("d_w"))
    return out.select("event_id", "user_id", F.round("unwrapped", 6).alias("unwrapped"), F.round("arc", 6).alias("arc"))


@query(
    "track_orientation",
    f"""with {_TRACKS}, f as (select user_id, arg_min(value, (t, event_id)) v0, arg_max(value, (t, event_id)) v1, min(t) t0, max(t) t1, count(*) n from e group by 1),
a as (select user_id, (v1 - v0) ax, (t1 - t0) / 86400.0::double ay, n::double az from f)
select user_id, round(case when sqrt(ax*ax + az*az) / sqrt(ax*ax + ay*ay + az*az) >= 0.2 then degrees(atan2(abs(az), abs(ax))) end, 6) theta_xz,
       round(case when sqrt(ax*ax + ay*ay) / sqrt(ax*ax + ay*ay + az*az) >= 0.2 then degrees(atan2(abs(ay), abs(ax))) end, 6) theta_xy from a""",
)
def track_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.struct("t", "event_id")
    ends = _tracks(spark, sf_dir).groupBy("user_id").agg((F.max_by("value", place) - F.min_by("value", place)).alias("ax"), ((F.max("t") - F.min("t")) / 86400.0).alias("ay"), F.count("*").cast("double").alias("az"))
    return ends.select("user_id", F.round(G.projected_angle("ax", "az", "ay", 0.2), 6).alias("theta_xz"), F.round(G.projected_angle("ax", "ay", "az", 0.2), 6).alias("theta_xy"))


@query(
    "curve_curvature",
    f"""with {_TRACKS}, c as (select user_id, t, event_id, value * cos(t / 86400.0::double) x, value * sin(t / 86400.0::double) y from e),
n as (select user_id, x, y, coalesce(lag(x) over q, last(x) over w) xb, coalesce(lag(y) over q, last(y) over w) yb, coalesce(lead(x) over q, first(x) over w) xa, coalesce(lead(y) over q, first(y) over w) ya
  from c window q as (partition by user_id order by t, event_id), w as (partition by user_id order by t, event_id rows between unbounded preceding and unbounded following)),
k as (select user_id, x, y, xa, ya, sqrt(pow(xa - 2*x + xb, 2) + pow(ya - 2*y + yb, 2)) bend from n)
select user_id, round(abs(sum(x*ya - y*xa)) / 2, 3) area, round(stddev_pop(bend) / avg(bend), 6) fluctuation from k group by 1""",
)
def curve_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.operators.tracks import closed_curves

    day = F.col("t") / 86400.0
    points = _tracks(spark, sf_dir).select("user_id", "t", "event_id", (F.col("value") * F.cos(day)).alias("x"), (F.col("value") * F.sin(day)).alias("y"))
    out = closed_curves(points, "user_id", ["t", "event_id"])
    return out.select("user_id", F.round("area", 3).alias("area"), F.round("fluctuation", 6).alias("fluctuation"))


_TOTAL = sum(math.exp(-0.5 * k * k) for k in range(-4, 5))
_SMOOTH = " + ".join(
    (f"coalesce(lag(value, {-k}) over q, first(value) over w)" if k < 0 else f"coalesce(lead(value, {k}) over q, last(value) over w)" if k else "value") + f" * {math.exp(-0.5 * k * k) / _TOTAL!r}::double" for k in range(-4, 5)
)


@query(
    "gaussian_smooth",
    f"""with {_TRACKS} select event_id, user_id, round(case when lag(value) over q is null or lead(value) over q is null then value else {_SMOOTH} end, 6) smooth
from e window q as (partition by user_id order by t, event_id), w as (partition by user_id order by t, event_id rows between unbounded preceding and unbounded following)""",
)
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.gaussian_smoothed(_tracks(spark, sf_dir), "user_id", ["t", "event_id"], "value")
    return out.select("event_id", "user_id", F.round("smooth", 6).alias("smooth"))


_DAILY = "d as (select event_type, ts::date as dy, count(*) n from events group by all)"


@query(
    "local_maxima",
    f"""with {_DAILY}, w as (select *, lag(n) over q b, lead(n) over q a from d window q as (partition by event_type order by dy)) select event_type, dy::varchar dy, n from w where n >= a and n >= b""",
)
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("dy")).agg(F.count("*").alias("n"))
    return ordered.local_maxima(daily, "event_type", ["dy"], "n").select("event_type", F.col("dy").cast("string").alias("dy"), "n")


@query(
    "longest_runs",
    f"""with {_DAILY}, m as (select event_type, avg(n) a from d group by 1), i as (select d.event_type, d.n > m.a h, row_number() over (partition by d.event_type order by dy) r from d join m using (event_type)),
g as (select event_type, r - row_number() over (partition by event_type order by r) g from i where h), c as (select event_type, g, count(*) n from g group by all)
select t.event_type, coalesce(max(c.n), 0)::bigint longest from (select distinct event_type from d) t left join c using (event_type) group by 1""",
)
def longest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("dy")).agg(F.count("*").alias("n"))
    means = daily.groupBy("event_type").agg(F.avg("n").alias("mean"))
    return ordered.longest_runs(daily.join(means, "event_type"), "event_type", ["dy"], F.col("n") > F.col("mean"))


@query(
    "bend_counts",
    f"""with {_TRACKS}, p as (select user_id, t, event_id, t / 86400.0::double x, value / 100.0::double y from e),
s as (select *, lead(x) over q - x dx, lead(y) over q - y dy from p window q as (partition by user_id order by t, event_id)),
b as (select *, lag(dx) over q ex, lag(dy) over q ey from s window q as (partition by user_id order by t, event_id))
select user_id, count(*) filter (acos(greatest(-1.0::double, least(1.0::double, (dx*ex + dy*ey) / (sqrt(dx*dx + dy*dy) * sqrt(ex*ex + ey*ey))))) > 0.08) bends from b group by 1""",
)
def bend_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _tracks(spark, sf_dir).select("user_id", "t", "event_id", (F.col("t") / 86400.0).alias("x"), (F.col("value") / 100.0).alias("y"))
    return ordered.bend_counts(points, "user_id", ["t", "event_id"], ["x", "y"])


@query(
    "longest_open_run",
    f"""{_COVER}, g as (select x, y, z - row_number() over (partition by x, y order by z) g from c), r as (select x, y, g, count(*) n from g group by all) select max(n)::bigint longest, count(distinct (x, y))::bigint columns from r""",
)
def longest_open_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = voxels.coverage_by_run(drawn(spark, sf_dir).select("x", "y", "z"))
    return runs.agg(F.max("longest").alias("longest"), F.count("*").alias("columns"))


@query(
    "largest_remainder",
    """with w as (select c_mktsegment, count(*)::double n from customer group by 1), s as (select c_mktsegment, n * 17 / sum(n) over () q from w),
b as (select c_mktsegment, floor(q)::bigint base, q - floor(q) rest from s)
select c_mktsegment, base + (case when row_number() over (order by rest desc, c_mktsegment) <= 17 - sum(base) over () then 1 else 0 end)::bigint seats from b""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("n"))
    return statistics.largest_remainder(weights, "c_mktsegment", "n", 17)


@query(
    "stratified_quantiles",
    """select l_orderkey, l_linenumber, round((row_number() over (partition by l_returnflag, l_linestatus, l_quantity order by l_orderkey, l_linenumber) - 1 + 0.5) / count(*) over (partition by l_returnflag, l_linestatus, l_quantity), 9) as level from lineitem""",
)
def stratified_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = table(spark, sf_dir, "lineitem").withColumn("stratum", F.struct("l_returnflag", "l_linestatus", "l_quantity"))
    return statistics.stratified_levels(strata, "stratum", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round("level", 9).alias("level"))


def _ks_sql(column: str, cdf: str, source: str = "lineitem") -> str:
    return f"""with c as (select {column} v, count(*) n from {source} group by 1), u as (select v, n, sum(n) over (order by v) u, sum(n) over () t from c)
select round(max(greatest(abs(u / t::double - ({cdf})), abs(({cdf}) - (u - n) / t::double))), 9) ks from u"""


def _ks(name: str, column: str, cdf: Callable, cdf_sql: str, source: str = "lineitem") -> None:
    @query(name, _ks_sql(column, cdf_sql, source))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statistics.ks_distance(table(spark, sf_dir, source).select(column), column, cdf).select(F.round("ks", 9).alias("ks"))


_ks("ks_uniform", "l_quantity", lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / 50.0)), "least(1.0::double, greatest(0.0::double, v / 50.0::double))")
_ks("ks_weibull", "l_extendedprice", lambda v: 1 - F.exp(-F.pow(v / 40000.0, F.lit(1.5))), "1 - exp(-pow(v / 40000.0::double, 1.5::double))")
_ks(
    "ks_mixture",
    "l_quantity",
    lambda v: 0.3 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - 5) / 20.0)) + 0.7 * (1 - F.exp(-v / 30.0)),
    "0.3::double * least(1.0::double, greatest(0.0::double, (v - 5) / 20.0::double)) + 0.7::double * (1 - exp(-v / 30.0::double))",
)


@query(
    "wasserstein_two_sample",
    """with b as (select l_quantity v, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag = 'R') r from lineitem where l_returnflag in ('A', 'R') group by 1),
u as (select v, sum(a) over (order by v) / sum(a) over ()::double fa, sum(r) over (order by v) / sum(r) over ()::double fr, lead(v) over (order by v) nx from b),
d as (select sum(abs(fa - fr) * (nx - v)) w from u), t as (select max(l_quantity) - min(l_quantity) s, quantile_cont(l_quantity, 0.95) - quantile_cont(l_quantity, 0.05) q from lineitem where l_returnflag = 'R')
select round(w, 9) distance, round(w / s, 9) by_range, round(w / q, 9) by_percentiles from d, t""",
)
def wasserstein_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    a, r = lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'")
    scales = statistics.scale_of(r, "l_quantity", "range").withColumnRenamed("scale", "s").crossJoin(statistics.scale_of(r, "l_quantity", "percentiles").withColumnRenamed("scale", "q"))  # one row each
    out = statistics.wasserstein(a, r, "l_quantity").crossJoin(scales)
    return out.select(F.round("distance", 9).alias("distance"), F.round(F.col("distance") / F.col("s"), 9).alias("by_range"), F.round(F.col("distance") / F.col("q"), 9).alias("by_percentiles"))


@query(
    "quantile_stability",
    """with q as (select 'fine' grid, l_extendedprice v from lineitem union all select 'coarse', l_extendedprice from lineitem where l_linenumber = 1),
s as (select grid, quantile_cont(v, 0) q0, quantile_cont(v, 0.1) q10, quantile_cont(v, 0.5) q50, quantile_cont(v, 0.9) q90, quantile_cont(v, 1) q100, avg(v) mean from q group by 1)
select grid, round(q0, 4) q0, round(q10, 4) q10, round(q50, 4) q50, round(q90, 4) q90, round(q100, 4) q100, round(mean, 4) mean from s""",
)
def quantile_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_linenumber")
    both = lines.select(F.explode(F.when(F.col("l_linenumber") == 1, F.array(F.lit("fine"), F.lit("coarse"))).otherwise(F.array(F.lit("fine")))).alias("grid"), "l_extendedprice")
    out = statistics.quantiles(both, "l_extendedprice", [0, 0.1, 0.5, 0.9, 1], "grid")
    return out.select("grid", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(
    "mixture_assignment",
    """with a as (select case when abs(p_size - 8) <= abs(p_size - 20) and abs(p_size - 8) <= abs(p_size - 41) then 0 when abs(p_size - 20) <= abs(p_size - 41) then 1 else 2 end c from part),
w as (select * from (values (0, 0.3::double), (1, 0.3::double), (2, 0.4::double)) v(c, w)), t as (select count(*) t from a)
select w.c component, count(a.c) n, round(count(a.c) / any_value(t)::double - any_value(w), 9) error from w left join a using (c), t group by 1""",
)
def mixture_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = statistics.nearest_prototype(table(spark, sf_dir, "part").select("p_size"), "p_size", [8, 20, 41])
    return statistics.mixture_errors(assigned, [0.3, 0.3, 0.4]).select("component", "n", F.round("error", 9).alias("error"))


@query(
    "volume_by_kind",
    """select split_part(p_type, ' ', 1) kind, count(*) n, round(avg(p_retailprice), 6) mean, round(min(p_retailprice) / avg(p_retailprice), 9) least_over_mean, round(max(p_retailprice) / avg(p_retailprice), 9) most_over_mean from part group by 1""",
)
def volume_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), "p_retailprice")
    out = statistics.summary_by_kind(parts, "kind", "p_retailprice")
    return out.select("kind", "n", F.round("mean", 6).alias("mean"), F.round("least_over_mean", 9).alias("least_over_mean"), F.round("most_over_mean", 9).alias("most_over_mean"))


@query("group_centroids", f"with {_SPOTS} select slice, count(*) n, round(avg(x), 9) x, round(avg(y), 9) y, round(avg(c_acctbal), 6) z from p group by 1")
def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spots(spark, sf_dir).groupBy("slice").agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("x"), F.round(F.avg("y"), 9).alias("y"), F.round(F.avg("c_acctbal"), 6).alias("z"))


@query(
    "seed_panel_aggregate",
    """select o_orderpriority, count(*) runs, count(*) filter (o_orderstatus = 'F') succeeded, count(*) filter (o_orderstatus <> 'F') failed, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) mean, round(var_pop(o_totalprice) filter (o_orderstatus = 'F'), 1) variance from orders group by 1""",
)
def seed_panel_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.panel_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", F.col("o_orderstatus") == "F")
    return out.select("o_orderpriority", "runs", "succeeded", "failed", F.round("mean", 4).alias("mean"), F.round("variance", 1).alias("variance"))


@query(
    "select_candidate",
    """with a as (select 'strict' panel, * from (select p_partkey, p_retailprice from part order by (p_size = 1 and p_retailprice > 1e9) desc, case when p_size = 1 and p_retailprice > 1e9 then 0 else abs(p_retailprice - 1234.5) end, p_partkey limit 1)),
b as (select 'passing' panel, * from (select p_partkey, p_retailprice from part order by (p_size = 7) desc, case when p_size = 7 then 0 else abs(p_retailprice - 1234.5) end, p_partkey limit 1)) select * from a union all select * from b""",
)
def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    strict = statistics.select_candidate(parts, (F.col("p_size") == 1) & (F.col("p_retailprice") > 1e9), "p_retailprice", 1234.5, "p_partkey")
    passing = statistics.select_candidate(parts, F.col("p_size") == 7, "p_retailprice", 1234.5, "p_partkey")
    return strict.select(F.lit("strict").alias("panel"), "p_partkey", "p_retailprice").union(passing.select(F.lit("passing"), "p_partkey", "p_retailprice"))


_CURVE = [{"kind": "peak", "amplitude": 1.5, "center": 1.0, "width": 0.2}, {"kind": "exclusion", "amplitude": 1.0, "center": 0.0, "width": 0.3}, {"kind": "oscillation", "amplitude": 0.1, "center": 2.0, "width": 0.8}]


@query(
    "rdf_target_curve",
    """with x as (select p_partkey, p_retailprice / 500.0::double x from part)
select p_partkey, round(greatest(0.0::double, 1 + 1.5::double*exp(-0.5*pow((x-1)/0.2::double,2)) - exp(-0.5*pow(x/0.3::double,2)) + 0.1::double*cos(2*pi()*((x-2)/0.8::double))), 9) g from x""",
)
def rdf_target_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve asked for at the distance each part's price stands for."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.target_curve(F.col("p_retailprice") / 500.0, _CURVE), 9).alias("g"))


def _phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.phase(drawn(spark, sf_dir), SHAPE)


_LABELS = f"""{_COVER.replace('with ', 'with recursive ', 1)}, k as materialized (select x + {BOX}*(y + {BOX}*z) id, x, y, z from c),
l as materialized (select a.id a, b.id b from k a join k b on b.z = a.z and b.y = a.y and b.x = (a.x + 1) % {BOX}
 union all select a.id, b.id from k a join k b on b.z = a.z and b.x = a.x and b.y = (a.y + 1) % {BOX}
 union all select a.id, b.id from k a join k b on b.x = a.x and b.y = a.y and b.z = a.z + 1),
m as materialized (select a, b from l union all select b, a from l),
r(root, id) as (select id, id from k union select r.root, m.b from r join m on m.a = r.id where m.b > r.root),
lab as (select id, min(root) label from r group by 1)"""


@query("component_summary", f"{_LABELS}, n as (select label, count(*) n from lab group by 1) select count(*) components, round(max(n) / sum(n)::double, 9) largest_fraction from n")
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.labels(_phase(spark, sf_dir), SHAPE)
    return graph.component_summary(found).select("components", F.round("largest_fraction", 9).alias("largest_fraction"))


@query("open_components", f"{_LABELS} select label::bigint as label, bool_or(z = 0) bottom, bool_or(z = {BOX - 1}) top from lab join k using (id) group by 1")
def open_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.open_faces(graph.labels(_phase(spark, sf_dir), SHAPE), BOX)


@query("through_networks", f"{_LABELS} select count(*) through_networks from (select label from lab join k using (id) group by 1 having bool_or(z = 0) and bool_or(z = {BOX - 1}))")
def through_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.through_networks(graph.labels(_phase(spark, sf_dir), SHAPE), BOX)


@query(
    "percolates_x",
    f"""{_LABELS.replace(f"b.x = (a.x + 1) % {BOX}", "b.x = a.x + 1")} select coalesce(bool_or(lo = 0 and hi = {BOX - 1}), false) percolates from (select min(x) lo, max(x) hi from lab join k using (id) group by label)""",
)
def percolates_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.percolates_x(_phase(spark, sf_dir), SHAPE)


_TILES = "(select i % 3 i, i // 3 j from range(9) t(i))"
_TILED = f"""{_COVER.replace('with ', 'with recursive ', 1)}, k as materialized (select x + {BOX} * i + {3 * BOX} * (y + {BOX} * j + {3 * BOX} * z) id, x + {BOX} * i as x, y + {BOX} * j as y, z from c, {_TILES}),
m as materialized (select a.id a, b.id b from k a join k b on abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1 and b.z between a.z - 1 and a.z + 1 and b.y between a.y - 1 and a.y + 1),
r(root, id) as (select id, id from k union select r.root, m.b from r join m on m.a = r.id where m.b > r.root),
lab as (select id, min(root) label from r group by 1)"""


@query(
    "winds_x",
    f"""{_TILED}, w as (select min(x) lo, max(x) hi, bool_or(x between {BOX} and {2 * BOX - 1} and y between {BOX} and {2 * BOX - 1}) middle from lab join k using (id) group by label)
select coalesce(bool_or(middle and lo < {BOX} and hi >= {2 * BOX}), false) winds from w""",
)
def winds_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.winds_x(_phase(spark, sf_dir), SHAPE)


@query(
    "checksum_manifest",
    """with d as (select doc_id, sha256(text) sha from documents) select doc_id, sha, count(*) over (partition by sha) copies, doc_id = min(doc_id) over (partition by sha) as first_of_its_kind from d""",
)
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    kinds = sums.groupBy("sha").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    return sums.join(kinds, "sha").select("doc_id", "sha", "copies", (F.col("doc_id") == F.col("least")).alias("first_of_its_kind"))


@query(
    "slug_and_fixed_width",
    r"""with p as (select p_partkey, p_name, p_retailprice, 'HETATM' || lpad((p_partkey % 100000)::varchar, 5, ' ') || ' ' || lpad(printf('%.3f', p_retailprice), 12, ' ') line from part)
select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') slug, trim(substr(line, 7, 5))::int serial, trim(substr(line, 13, 12))::double as value from p""",
)
def slug_and_fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.sources.text import fixed_width

    parts = table(spark, sf_dir, "part")
    lines = parts.select("p_partkey", "p_name", F.concat(F.lit("HETATM"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, " "), F.lit(" "), F.lpad(F.format_string("%.3f", "p_retailprice"), 12, " ")).alias("line"))
    read = fixed_width(lines, "line", {"serial": (7, 5, "int"), "value": (13, 12, "double")})
    return read.select("p_partkey", G.slug("p_name").alias("slug"), "serial", "value")


@query("json_getters", """select event_id, (props::json->>'$.k')::int k, coalesce((props::json->>'$.missing')::int, -1) missing from events""")
def json_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.sources.text import json_number

    return table(spark, sf_dir, "events").select("event_id", json_number("props", "k").cast("int").alias("k"), F.coalesce(json_number("props", "missing").cast("int"), F.lit(-1)).alias("missing"))


@query(
    "scale_bisection",
    f"""with {_UNITS}, {_V}, g as (select (10 + i) / 20.0::double f from range(11) t(i)),
c as (select f, count(distinct v.id) n from g, v join s on true where {_D2} < r*f*r*f group by f)
select f as scale, round(n / {float(BOX**3)}::double, 9) porosity from c order by abs(n / {float(BOX**3)}::double - 0.08), f limit 1""",
)
def scale_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scales of a fixed grid in one job, the one whose porosity is nearest the target."""
    units = spheres(spark, sf_dir).withColumn("f", F.explode(F.array(*[F.lit((10 + i) / 20.0) for i in range(11)]))).withColumn("r", F.col("r") * F.col("f"))
    from voxlake.operators.scaling import porosity_by_scale

    out = porosity_by_scale(units, SHAPE)
    best = out.orderBy(F.abs(F.col("porosity") - 0.08), "f").limit(1)
    return best.select(F.col("f").alias("scale"), F.round("porosity", 9).alias("porosity"))


def load() -> None:
    """Queries of the plans beside this module."""
    from voxlake.plans import curves, filling, film, kernels, more, surfaces, units  # noqa: F401


load()
