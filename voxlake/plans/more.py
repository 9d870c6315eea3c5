"""Further queries with SQL: transforms, gates, statuses, integrals, manifests, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import geometry as G
from voxlake.operators import matching, molecules, pairs, reconcile, statistics, tracks, voxels
from voxlake.plans.catalog import _COVER, _PLANE, _TRACKS, BOX, _tracks, drawn, query
from voxlake.sources import phase, text
from voxlake.tables import table


@query(
    "rigid_transform",
    """with s as (select s_suppkey k, s_suppkey % 360 * pi() / 180 a, (s_suppkey*7)%20+0.5::double x, (s_suppkey*11)%20+0.5::double y, (s_suppkey*13)%20+0.5::double z from supplier),
t as (select * from (values (0, 1.0::double, 0.0::double, 0.0::double), (1, 0.0, 2.0, 0.5), (2, -1.0, -1.0, 1.5)) t(serial, tx, ty, tz))
select k as instance, serial, round(x + tx*cos(a) - ty*sin(a), 6) x, round(y + tx*sin(a) + ty*cos(a), 6) y, round(z + tz, 6) z from s, t""",
)
def rigid_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    half = (k % 360) * F.pi() / 360
    places = table(spark, sf_dir, "supplier").select(k.alias("instance"), *[((k * m) % 20 + 0.5).cast("double").alias(c) for c, m in (("x", 7), ("y", 11), ("z", 13))], F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    template = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 1.0), (1, 0.0, 2.0, 0.5, 1.0), (2, -1.0, -1.0, 1.5, 1.0)], "serial int, x double, y double, z double, radius double")
    return molecules.placed_atoms(places, template).select("instance", "serial", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(
    "snap_and_protrude",
    """with p as (select p_partkey, p_retailprice / 100 - 10 v from part)
select p_partkey, round(least(greatest(case when abs(v) <= 0.5 then 0 when abs(v - 8) <= 0.5 then 8 else v end, 0), 8), 9) snapped, round(greatest(-v, 0), 9) below, round(greatest(v - 8, 0), 9) above from p""",
)
def snap_and_protrude(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100 - 10).alias("v"))
    below, above = G.protrusion("v", 8.0)
    return parts.select("p_partkey", F.round(G.snapped("v", 0.0, 8.0, 0.5), 9).alias("snapped"), F.round(below, 9).alias("below"), F.round(above, 9).alias("above"))


@query(
    "gate_rollup",
    """with g as (select c_nationkey, c_mktsegment as name, avg(c_acctbal) as value from customer group by all), o as (select *, coalesce(abs(value) <= 4800, false) ok from g)
select c_nationkey, bool_and(ok) passed, coalesce(list_sort(list(name) filter (not ok)), []) failed from o group by 1""",
)
def gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("name")).agg(F.avg("c_acctbal").alias("value")).withColumn("limit", F.lit(4800.0))
    return statistics.gates(rows, ["c_nationkey"])


@query(
    "report_statuses",
    """with u as (select user_id, list(distinct event_type) filter (event_type = 'error' and value > 40) errors, count(*) filter (value > 95) warnings, max(event_id) % 7 = 0 missing from events group by 1)
select user_id, case when missing then 'NOT_EVALUABLE' when len(coalesce(errors, [])) > 0 then 'FAIL' when warnings > 0 then 'WARNING' else 'PASS' end status from u""",
)
def report_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_set(F.when((F.col("event_type") == "error") & (F.col("value") > 40), F.col("event_type"))).alias("errors"), F.collect_set(F.when(F.col("value") > 95, F.lit("large value"))).alias("warnings"), (F.max("event_id") % 7 == 0).alias("odd")
    )
    missing = F.when(F.col("odd"), F.array(F.lit("contract"))).otherwise(F.array().cast("array<string>"))
    return users.select("user_id", reconcile.report_status(F.col("errors"), F.col("warnings"), missing).alias("status"))


@query(
    "channel_rows",
    f"""with {_TRACKS}, t as (select user_id, max(t) - min(t) arc, (max(t) - min(t)) * 0.8 chord, count(*) points, bool_or(value > 99) branched from e group by 1),
s as (select user_id, count(*) n, avg(value) diameter, avg(value / 100) fluctuation from e where event_type = 'purchase' and value is not null group by 1),
r as (select *, case when branched then 'branch_neighborhood' when points < 2 then 'insufficient_centerline_points' when n is null then 'no_valid_cross_sections' when not (arc > 0 and chord > 0 and diameter > 0) then 'nonpositive_channel_measure' end reason from t left join s using (user_id))
select user_id as track_id, reason is null as valid, reason as invalid_reason, round(case when reason is null then diameter end, 6) diameter, round(case when reason is null then arc / diameter end, 6) eta, round(case when reason is null then arc / chord end, 6) tau from r""",
)
def channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _tracks(spark, sf_dir)
    lines = e.groupBy(F.col("user_id").alias("track_id")).agg((F.max("t") - F.min("t")).alias("arc"), ((F.max("t") - F.min("t")) * 0.8).alias("chord"), F.count("*").alias("points"), F.bool_or(F.col("value") > 99).alias("branched"))
    cuts = e.select(F.col("user_id").alias("track_id"), (F.col("event_type") == "purchase").alias("valid"), F.col("value").alias("diameter"), (F.col("value") / 100).alias("fluctuation"))
    return tracks.channel_rows(lines, cuts).select("track_id", "valid", "invalid_reason", *[F.round(c, 6).alias(c) for c in ("diameter", "eta", "tau")])


@query(
    "trapezoid_integral",
    f"""with {_TRACKS}, w as (select user_id, (value + lag(value) over q) / 2 * (t - lag(t) over q) / 3600.0::double p from e window q as (partition by user_id order by t, event_id)) select user_id, round(coalesce(sum(p), 0), 4) integral from w group by 1""",
)
def trapezoid_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracks(spark, sf_dir).withColumn("h", F.col("t") / 3600.0)
    return tracks.trapezoid(rows, "user_id", ["t", "event_id"], "h", "value").select("user_id", F.round("integral", 4).alias("integral"))


@query(
    "completed_tasks",
    """select p_partkey::int sequence_index, case when n is null then 'cancelled' else 'ok' end status, case when n is null then 'no order' else n::varchar end message
from part left join (select l_partkey, count(*) n from lineitem where l_quantity > 45 group by 1) on p_partkey = l_partkey""",
)
def completed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("sequence_index"))
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").cast("int").alias("sequence_index")).agg(F.count("*").cast("string").alias("message"))
    done = done.join(tasks, "sequence_index", "left_semi").select("sequence_index", F.lit("ok").alias("status"), "message")
    return reconcile.completed(tasks, done, "no order")


@query(
    "manifest_issues",
    """with f as (select case when doc_id % 50 = 0 then '../' || doc_id else 'doc/' || doc_id end p, sha256(text) sha, doc_id from documents),
l as (select p, case when doc_id % 7 = 0 then 'changed' else sha end s from f where doc_id % 11 <> 0 union all select p, sha from f where doc_id % 13 = 0 and doc_id % 11 <> 0),
h as (select p, sha from f where doc_id % 17 <> 0)
select 'unsafe_path' code, p as relative from l where p like '../%' union all select 'duplicate', p from l group by p having count(*) > 1
union all select 'missing_file', l.p from l left join h using (p) where h.sha is null union all select 'checksum_mismatch', l.p from l join h using (p) where lower(s) <> lower(sha)
union all select 'not_listed', p from f where p not in (select p from l)""",
)
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(F.when(i % 50 == 0, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat(F.lit("doc/"), i.cast("string"))).alias("relative"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "doc_id")
    listed = files.where(i % 11 != 0)
    both = listed.select("relative", F.when(i % 7 == 0, F.lit("changed")).otherwise(F.col("sha")).alias("sha")).union(listed.where(i % 13 == 0).select("relative", "sha"))
    return text.manifest_issues(both, files.where(i % 17 != 0).select("relative", "sha"), files.select("relative"))


@query(
    "curve_loss",
    """with h as (select (floor(l_quantity / 10))::int bin, count(*) n from lineitem where l_quantity < 50 group by 1), g as (select bin, n, n / 10000.0::double g, 1 + 0.5 * exp(-0.5 * pow((bin - 2) / 0.8::double, 2)) t from h)
select round(sum(greatest(t, 1e-12) * (g - t) * (g - t)) / sum(greatest(t, 1e-12)), 9) loss from g""",
)
def curve_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = pairs.histogram(table(spark, sf_dir, "lineitem").where("l_quantity < 50").select("l_quantity"), "l_quantity", 10.0, 5)
    curve = counts.select("bin", "n", (F.col("n") / 10000.0).alias("g"), G.target_curve(F.col("bin").cast("double"), [{"kind": "peak", "amplitude": 0.5, "center": 2.0, "width": 0.8}]).alias("t"))
    return pairs.curve_loss(curve, "g", "t").select(F.round("loss", 9).alias("loss"))


@query(
    "sampled_voxels",
    f"""{_COVER}, p as (select x + {BOX} * (y + {BOX} * z) id, n units from c), o as (select *, row_number() over (order by id) - 1 r, count(*) over () n from p),
w as (select distinct floor(i * (greatest(n - 1, 1)) / 499.0::double)::bigint r from range(500) t(i), (select max(n) n from o))
select id::bigint id, units from o where n <= 500 or r in (select r from w)""",
)
def sampled_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pore voxels at even ranks, with the units that cover them."""
    pore = drawn(spark, sf_dir).select((F.col("x") + BOX * (F.col("y") + BOX * F.col("z"))).cast("bigint").alias("id"), F.col("n").alias("units"))
    return voxels.evenly_sampled(pore, ["id"], 500).select("id", "units")


@query("sampled_slices", f"{_COVER} select z::int z, count(*) n, max(n) most from c where z % 3 = 0 or z = {BOX - 1} group by z")
def sampled_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pore voxels, and the most units over one, of every third slice and the last."""
    from voxlake.plans.measure import sampled_slices as sampled

    return sampled(drawn(spark, sf_dir), BOX, 1.0, 3.0).groupBy("z").agg(F.count("*").alias("n"), F.max("n").alias("most"))


@query(
    "density_counts",
    """select p_partkey, round_even(p_retailprice / 100 * 0.5, 0)::bigint half_even, floor(p_retailprice / 100 * 0.5 + 0.5)::bigint half_up, greatest(1, round_even(p_retailprice / 1000, 0))::bigint stride from part""",
)
def density_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds round half to even, molecules half up, strides half to even and at least 1."""
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.rint(v / 100 * 0.5).cast("bigint").alias("half_even"), F.floor(v / 100 * 0.5 + 0.5).alias("half_up"), F.greatest(F.lit(1).cast("double"), F.rint(v / 1000)).cast("bigint").alias("stride"))


@query(
    "fallback_values",
    """with a as (select c_custkey k, c_acctbal v from customer where c_custkey % 3 <> 0), b as (select o_custkey k, min(o_totalprice) v from orders group by 1) select k, coalesce(a.v, b.v) as value from a full join b using (k)""",
)
def fallback_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    second = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("value"))
    return phase.with_fallback(first, second, ["k"], "value")


@query(
    "molecule_intrusion",
    f"""with s as (select (s_suppkey*7)%{BOX}+0.5::double cx, (s_suppkey*11)%{BOX}+0.5::double cy, (s_suppkey*13)%{BOX}+0.5::double cz, greatest(0.5::double, least(2.5::double, s_acctbal/4000.0::double)) r from supplier),
q as (select ((c_custkey*37)%1000)/50.0::double px, ((c_custkey*61)%997)/50.0::double py, ((c_custkey*29)%1013)/50.0::double pz from customer),
i as (select floor(px)::int % {BOX} x, floor(py)::int % {BOX} y, case when pz < {BOX} then floor(pz)::int end z from q),
m as (select z is not null inside, z is not null and exists (select 1 from s where
 pow((x+0.5-cx) - {BOX}.0 * round_even((x+0.5-cx) / {BOX}.0, 0), 2) + pow((y+0.5-cy) - {BOX}.0 * round_even((y+0.5-cy) / {BOX}.0, 0), 2) + pow(z+0.5-cz, 2) < r*r) pore from i)
select count(*) points, count(*) filter (pore) in_pore, count(*) filter (inside and not pore) in_solid, count(*) filter (not inside) outside from m""",
)
def molecule_intrusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxlake.plans.catalog import SHAPE, drawn

    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(*[((k * m) % q / 50.0).alias(c) for c, m, q in (("x", 37, 1000), ("y", 61, 997), ("z", 29, 1013))])
    return molecules.intrusion(points, drawn(spark, sf_dir).select("x", "y", "z"), SHAPE, 1.0)


def _rounds(n: int) -> str:
    """CTEs of n rounds of taking the pairs that are the cheapest of both their ends: taken0, taken1, ..."""
    steps = []
    for r in range(n):
        steps.append(f"""best{r} as (select *, row_number() over (partition by slice, a order by distance, a, b) ra, row_number() over (partition by slice, b order by distance, a, b) rb from pairs{r}),
taken{r} as materialized (select slice, a, b, distance from best{r} where ra = 1 and rb = 1),
pairs{r + 1} as materialized (select * from pairs{r} p where not exists (select 1 from taken{r} t where t.slice = p.slice and t.a = p.a) and not exists (select 1 from taken{r} t where t.slice = p.slice and t.b = p.b))""")
    return ",\n".join(steps)


@query(
    "match_centers",
    f"""with l as (select c_nationkey slice, c_custkey id, ((c_custkey*37)%1000)/10.0::double x, ((c_custkey*61)%997)/10.0::double y from customer),
e as (select slice, id, x + ((id * 17) % 21 - 10) / 10.0::double x, y + ((id * 23) % 19 - 9) / 10.0::double y from l where id % 11 <> 0
      union all select s_nationkey, -1 - s_suppkey, ((s_suppkey*53)%1000)/10.0::double, ((s_suppkey*71)%991)/10.0::double from supplier),
pairs0 as materialized (select a.slice, a.id a, b.id b, {_PLANE} distance from l a join e b on a.slice = b.slice where {_PLANE} <= 1.5),
{_rounds(8)},
taken as (select * from ({' union all '.join(f'select * from taken{r}' for r in range(8))}))
select l.slice, id as reported, b as expected, round(distance, 9) distance, case when b is null then 'unexpected' else 'ok' end status from l left join taken on taken.slice = l.slice and taken.a = l.id
union all select slice, null, id, null, 'missing' from e where not exists (select 1 from taken t where t.slice = e.slice and t.b = e.id)""",
)
def match_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of slices against the same ones moved, some gone and others added: one to one, nearest first."""
    k, s = F.col("id"), F.col("s_suppkey")
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("slice"), F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 37) % 1000 / 10.0).alias("x"), ((F.col("c_custkey") * 61) % 997 / 10.0).alias("y"))
    moved = left.where(k % 11 != 0).select("slice", "id", (F.col("x") + ((k * 17) % 21 - 10) / 10.0).alias("x"), (F.col("y") + ((k * 23) % 19 - 9) / 10.0).alias("y"))
    added = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slice"), (-1 - s).alias("id"), ((s * 53) % 1000 / 10.0).alias("x"), ((s * 71) % 991 / 10.0).alias("y"))
    return matching.matched_points(left, moved.unionByName(added), 1.5, (100, 100), ["slice"]).withColumn("distance", F.round("distance", 9))
