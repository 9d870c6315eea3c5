"""Units assembled for runs, and held against the targets they were drawn for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.operators import units as U
from voxlake.plans.catalog import centers, query
from voxlake.tables import written


def between(low: float, high: float, alpha: float = 1.0, beta: float = 1.0) -> dict:
    return {"family": "beta", "alpha": alpha, "beta": beta, "lower": low, "upper": high}


#: Films of 100 a side; the orientation has two components whose angles belong together.
CONFIG = {
    "porosity": 0.28, "box": [100.0, 100.0, 100.0], "channel_fraction": 0.35, "volume_ratio": 1.6,
    "compact": {"relative_volume": {"family": "weibull", "shape": 2.0, "scale": 1.0}, "eta": between(1.0, 2.5, beta=2.0), "roughness": between(0.0, 0.1)},
    "channel": {"relative_volume": between(0.5, 1.5), "eta": between(2.0, 4.0), "roughness": between(0.0, 0.1), "tau": between(1.05, 1.5, beta=2.0), "diameter": {"family": "weibull", "shape": 3.0, "scale": 4.0, "loc": 1.0}},
    "orientation": {"components": [{"weight": 0.6, "theta_xz": between(5.0, 20.0), "theta_xy": between(10.0, 40.0, beta=2.0)}, {"weight": 0.4, "theta_xz": between(50.0, 70.0), "theta_xy": between(30.0, 60.0)}]},
}
#: Largest KS distance of a run's quantity: stratified draws are within a step of their target.
KS_LIMIT = 0.2


def _beta(level: str, spec: dict) -> str:
    return f"({spec['lower']}::double + {spec['upper'] - spec['lower']}::double * (1 - pow(1 - {level}, {1 / spec['beta']}::double)))"


def _uniform(stream: str) -> str:
    return f"('0x' || substr(sha256(seed || '|' || {stream} || '|' || unit_id), 1, 13))::bigint / 4503599627370496.0::double"


def _drawn(name: str, source: str, streams: dict[str, str]) -> str:
    """CTE of rank, n and level of every stream and unit of `source`, one row each."""
    asked = " union all ".join(f"select run_id, unit_id, seed, '{s}' stream, ({g})::varchar part from {source}" for s, g in streams.items())
    return f"""{name}_long as (select *, {_uniform('stream')} u, {_uniform("stream || '+'")} v from ({asked}) where part is not null),
{name} as materialized (select run_id, unit_id, stream, r, n, (r + v) / n l from (select *, row_number() over (partition by run_id, stream, part order by u, unit_id) - 1 r, count(*) over (partition by run_id, stream, part) n from {name}_long))"""


def _share(weights: list[float], rank: str, n: str) -> str:
    """0 or 1: which of two weights' share the rank falls into."""
    total = sum(weights)
    a, b = (f"{w / total}::double * {n}" for w in weights)
    first = f"floor({a}) + case when {n} - floor({a}) - floor({b}) > (case when {b} - floor({b}) > {a} - floor({a}) then 1 else 0 end) then 1 else 0 end"
    return f"(case when {rank} < {first} then 0 else 1 end)"


def _sql(config: dict) -> str:
    compact, channel, (one, two) = config["compact"], config["channel"], config["orientation"]["components"]
    box = 1.0
    for side in config["box"]:
        box *= side
    weibull = lambda level, s: f"({s.get('loc', 0.0)}::double + {s['scale']}::double * pow(-ln(1 - {level}), {1 / s['shape']}::double))"
    level = lambda s: f"max(case when stream = '{s}' then l end) {s}"
    angle = lambda n: f"case component when 0 then {_beta(n, one[n])} else {_beta(n, two[n])} end"
    sign = lambda c: f"(case when {_uniform(repr('sign-' + c))} < 0.5 then -1.0::double else 1.0::double end)"
    names = ["relative_volume", "eta", "roughness", "tau", "diameter", "theta_xz", "theta_xy"]
    return f"""
with c as (select c_nationkey run_id, c_custkey unit_id, (c_nationkey + 20260000)::bigint seed, ((c_custkey*37)%1000)/10.0::double x, ((c_custkey*61)%997)/10.0::double y, ((c_custkey*29)%991)/10.0::double z from customer),
{_drawn('one', 'c', {'kind': '0', 'orientation': '0'})},
k as materialized (select c.*, (select {_share([1 - config['channel_fraction'], config['channel_fraction']], 'r', 'n')} from one where one.run_id = c.run_id and one.unit_id = c.unit_id and stream = 'kind') channel,
  (select {_share([one['weight'], two['weight']], 'r', 'n')} from one where one.run_id = c.run_id and one.unit_id = c.unit_id and stream = 'orientation') component from c),
{_drawn('two', 'k', {s: 'channel' for s in names[:3]} | {s: 'case when channel = 1 then 1 end' for s in ('tau', 'diameter')} | {s: 'component' for s in ('theta_xz', 'theta_xy')})},
w as (select run_id, unit_id, {', '.join(level(s) for s in names)} from two group by all),
v as (select k.*, case when channel = 1 then {_beta('relative_volume', channel['relative_volume'])} * {config['volume_ratio']}::double else {weibull('relative_volume', compact['relative_volume'])} end rel,
  case when channel = 1 then {_beta('eta', channel['eta'])} else {_beta('eta', compact['eta'])} end eta, case when channel = 1 then {_beta('roughness', channel['roughness'])} else {_beta('roughness', compact['roughness'])} end roughness,
  case when channel = 1 then {_beta('tau', channel['tau'])} end tau, case when channel = 1 then {weibull('diameter', channel['diameter'])} end drawn, {angle('theta_xz')} theta_xz, {angle('theta_xy')} theta_xy from k join w using (run_id, unit_id)),
t as (select *, {config['porosity']}::double * {box}::double * rel / sum(rel) over (partition by run_id) part, {sign('y')} * tan(radians(theta_xy)) ty, {sign('z')} * tan(radians(theta_xz)) tz from v),
u as (select *, case when channel = 1 then drawn else pow(6 * part / pi(), 1 / 3.0::double) end diameter, sqrt(1 + ty * ty + tz * tz) long from t),
f as (select *, case when channel = 1 then pi() / 4 * pow(diameter, 2) * eta * diameter else part end volume, case when channel = 1 then eta * diameter / tau end chord, case when channel = 0 then pow(3 * part / (4 * pi() * eta), 1 / 3.0::double) end minor_radius from u)"""


_OUT = {"volume": 4, "diameter": 6, "eta": 6, "tau": 6, "roughness": 8, "theta_xz": 6, "theta_xy": 6, "dx": 8, "dy": 8, "dz": 8, "chord": 6, "coil_radius": 6, "minor_radius": 6}
_COIL = f"chord * sqrt(tau * tau - 1) / (2 * {U.PIECES} * sin(pi() * {U.TURNS} / {U.PIECES}))"
_FROM = {"dx": "1 / long", "dy": "ty / long", "dz": "tz / long", "coil_radius": _COIL}


@query(
    "units",
    f"{_sql(CONFIG)} select run_id, unit_id, case when channel = 1 then 'channel' else 'compact' end kind, component::int component, {', '.join(f'round({_FROM.get(c, c)}, {d}) as {c}' for c, d in _OUT.items())} from f",
)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = U.assembled(centers(spark, sf_dir), CONFIG)
    return made.select("run_id", "unit_id", "kind", "component", *[F.round(c, d).alias(c) for c, d in _OUT.items()])


def targets(config: dict) -> dict[tuple[str, str, int | None], dict]:
    """Specification of each quantity by kind (or for both kinds) and orientation component."""
    out = {("eta", k, None): config[k]["eta"] for k in (U.COMPACT, U.CHANNEL)}
    out |= {(q, U.CHANNEL, None): config["channel"][q] for q in ("tau", "diameter") if config["channel"].get(q)}
    for i, p in enumerate(config["orientation"].get("components", [])):
        out |= {(q, "", i): p[q] for q in ("theta_xz", "theta_xy")}
    return out


def audit(made: DataFrame, config: dict, limit: float = KS_LIMIT) -> DataFrame:
    """run_id, quantity, n, ks and passed: what the units' own geometry gives, against what they were to be."""
    from voxlake.functions import distributions as D

    found = U.remeasured(made, U.centerlines(made)).join(made.select("run_id", "unit_id", "component"), ["run_id", "unit_id"])
    rows = []
    for (quantity, kind, part), spec in targets(config).items():
        of = F.lit(True) if part is None else F.col("component") == part
        mine = of if not kind else of & (F.col("kind") == kind)
        name = "_".join([*([kind] if kind else []), quantity, *([] if part is None else [str(part)])])
        rows.append(F.when(mine, F.struct(F.lit(name).alias("quantity"), F.col(quantity).alias("value"), D.cdf_udf(spec)(F.col(quantity)).alias("f"))))
    samples = written(found.select("run_id", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("run_id", "s.*"), "unit-samples")
    return U.ks_by_group(samples, ["run_id", "quantity"], "value", F.col("f")).withColumn("passed", F.col("ks") <= limit)


def _ks_sql(config: dict) -> str:
    parts = []
    for (quantity, kind, part), spec in targets(config).items():
        name = "_".join([*([kind] if kind else []), quantity, *([] if part is None else [str(part)])])
        where = " and ".join([*([f"channel = {int(kind == U.CHANNEL)}"] if kind else []), *([] if part is None else [f"component = {part}"])])
        if spec["family"] == "weibull":
            cdf = f"1 - exp(-pow(({quantity} - {spec.get('loc', 0.0)}) / {spec['scale']}::double, {spec['shape']}::double))"
        else:
            cdf = f"1 - pow(1 - ({quantity} - {spec['lower']}::double) / {spec['upper'] - spec['lower']}::double, {spec['beta']}::double)"
        parts.append(f"select run_id, '{name}' quantity, {quantity} as value, {cdf} f from f where {where}")
    return f"""{_sql(config)}, s as ({" union all ".join(parts)}),
p as (select *, row_number() over (partition by run_id, quantity order by value) r, count(*) over (partition by run_id, quantity) n from s)
select run_id, quantity, n, round(max(greatest(abs(r / n - f), abs(f - (r - 1) / n))), 6) ks, max(greatest(abs(r / n - f), abs(f - (r - 1) / n))) <= {KS_LIMIT} passed from p group by run_id, quantity, n"""


@query("units_audit", _ks_sql(CONFIG))
def units_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Films whose units' diameters, shapes and angles, measured again from points and half axes, follow the targets."""
    made = written(U.assembled(centers(spark, sf_dir), CONFIG), "units")
    return audit(made, CONFIG).select("run_id", "quantity", "n", F.round("ks", 6).alias("ks"), "passed")


SHAPE, SPACING = (20, 20, 20), 5.0


def _phase_sql() -> str:
    """Voxels by walking through the same bounding boxes."""
    norm = "sqrt(n1x * n1x + n1y * n1y + n1z * n1z)"
    turn = f"(phase + hand * i * {2 * U.TURNS / U.PIECES}::double * pi())"
    box = lambda low, high, n: f"generate_series({'greatest(0, ' if n else ''}ceil(({low}) / {SPACING}::double - 0.5)::bigint{')' if n else ''}, {'least(19, ' if n else ''}floor(({high}) / {SPACING}::double - 0.5)::bigint{')' if n else ''})"
    tube = ", ".join(f"unnest({box(f'least(s{c}, e{c}) - r', f'greatest(s{c}, e{c}) + r', c == 'z')}) v{c}" for c in "z")
    at = lambda c: f"((v{c} + 0.5) * {SPACING}::double)"
    return f"""{_sql(CONFIG)},
w2 as (select *, 1 / long dx, ty / long dy, tz / long dz, {_COIL} coil, {_uniform("'phase'")} * 2 * pi() phase, case when {_uniform("'hand'")} < 0.5 then -1.0::double else 1.0::double end hand from f),
ch as (select *, case when abs(dz) > 0.85 then 0 else dy end n1x, case when abs(dz) > 0.85 then dz else -dx end n1y, case when abs(dz) > 0.85 then -dy else 0 end n1z from w2 where channel = 1),
ax as (select *, n1x / {norm} ux, n1y / {norm} uy, n1z / {norm} uz from ch),
bx as (select *, dy * uz - dz * uy wx, dz * ux - dx * uz wy, dx * uy - dy * ux wz, unnest(range({U.PIECES + 1})) i from ax),
pt as (select run_id, unit_id, i, diameter / 2 r, {', '.join(f"{c} + (i / {float(U.PIECES)}::double - 0.5) * chord * d{c} + coil * (cos({turn}) - cos(phase)) * u{c} + coil * (sin({turn}) - sin(phase)) * w{c} p{c}" for c in 'xyz')} from bx),
sg as (select run_id, r, {', '.join(f"p{c} s{c}, lead(p{c}) over (partition by run_id, unit_id order by i) e{c}" for c in 'xyz')} from pt),
s1 as (select *, {tube} from sg where ex is not null),
s2 as (select *, unnest({box('least(sy, ey) - r', 'greatest(sy, ey) + r', False)}) vy from s1),
s3 as (select *, unnest({box('least(sx, ex) - r', 'greatest(sx, ex) + r', False)}) vx from s2),
s4 as (select *, {', '.join(f'{at(c)} - s{c} o{c}' for c in 'xyz')}, {', '.join(f'e{c} - s{c} w{c}' for c in 'xyz')} from s3),
s5 as (select *, least(greatest(coalesce((ox * wx + oy * wy + oz * wz) / nullif(wx * wx + wy * wy + wz * wz, 0), 0), 0), 1) t from s4),
tubes as (select run_id, vx, vy, vz from s5 where pow(ox - t * wx, 2) + pow(oy - t * wy, 2) + pow(oz - t * wz, 2) < r * r),
e0 as (select *, minor_radius * eta major from w2 where channel = 0),
e1 as (select *, unnest({box('z - greatest(minor_radius, major)', 'z + greatest(minor_radius, major)', True)}) vz from e0),
e2 as (select *, unnest({box('y - greatest(minor_radius, major)', 'y + greatest(minor_radius, major)', False)}) vy from e1),
e3 as (select *, unnest({box('x - greatest(minor_radius, major)', 'x + greatest(minor_radius, major)', False)}) vx from e2),
e4 as (select *, {', '.join(f'{at(c)} - {c} o{c}' for c in 'xyz')} from e3), e5 as (select *, ox * dx + oy * dy + oz * dz along from e4),
bodies as (select run_id, vx, vy, vz from e5 where (ox * ox + oy * oy + oz * oz - along * along) / (minor_radius * minor_radius) + along * along / (major * major) < 1),
cells as (select distinct run_id, ((vx % 20) + 20) % 20 x, ((vy % 20) + 20) % 20 y, vz z from (select * from tubes union all select * from bodies))
select run_id, count(*) voxels, round(count(*) / 8000.0::double, 9) porosity from cells group by run_id"""


@query("unit_phases", _phase_sql())
def unit_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Porosity of the films that the assembled units make on a lattice of 20 a side."""
    made = written(U.assembled(centers(spark, sf_dir), CONFIG), "units")
    found = U.covered(made, U.centerlines(made), SHAPE, SPACING).groupBy("run_id").agg(F.count("*").alias("voxels"))
    return found.select("run_id", "voxels", F.round(F.col("voxels") / 8000.0, 9).alias("porosity"))
