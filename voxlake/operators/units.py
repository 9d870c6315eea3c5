"""Units assembled as rows: kinds, volumes, shapes and directions drawn so that a run's units meet their targets.

Random numbers are counters: the first 52 bits of the SHA-256 of seed, stream and unit, so that a unit gets the same
ones wherever and however often it is computed. Draws are stratified: in each group the units, in random order, take one
value from each of n equal shares of the distribution. All draws of a step are one table of (quantity, unit) rows, put in
order by one range sort, and no task holds a run.

Kinds and orientation components get whole numbers of units in proportion to their weights. A run's pore volume is split
over its units by relative volumes and the wanted ratio of channels to compact ones. Channels are coils of straight
pieces: the radius of the coil that gives a wanted arc over chord is known in closed form.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import distributions as D
from voxlake.functions import geometry as G
from voxlake.operators.ordered import ranked
from voxlake.tables import written

#: Straight pieces of a channel, and turns of its coil.
PIECES, TURNS = 16, 2
COMPACT, CHANNEL = "compact", "channel"


def uniform(seed: Column, stream: Column | str, key: Column) -> Column:
    """A number from 0 to below 1 of a counter: 52 bits of its SHA-256, the same double everywhere."""
    stream = F.lit(stream) if isinstance(stream, str) else stream
    counter = F.concat_ws("|", seed.cast("string"), stream, key.cast("string"))
    return F.conv(F.substring(F.sha2(counter.cast("binary"), 256), 1, 13), 16, 10).cast("bigint") / F.lit(2.0**52)


def quantile(spec: dict, level: Column) -> Column:
    """A distribution's value at a level: in closed form for constants, Weibull, and beta with an exponent of 1; a pandas UDF for others."""
    family = spec.get("family", "constant")
    if family == "mixture":
        total, low, out = float(sum(c["weight"] for c in spec["components"])), 0.0, None
        for c in spec["components"]:  # each has its share of the levels, so strata give it its number within one
            share = float(c["weight"]) / total
            inside = quantile(c, F.least(F.greatest((level - low) / share, F.lit(0.0)), F.lit(1 - 2.0**-53)))
            out = inside if out is None else F.when(level >= low, inside).otherwise(out)
            low += share
        return out
    if family == "constant":
        return F.lit(float(spec["value"])) + level * 0
    if family in ("weibull", "weibull_min"):
        shape, scale, loc = D._read(spec, "shape", "k", "c"), D._read(spec, "scale", default=1.0), D._read(spec, "loc", default=0.0)
        return loc + scale * F.pow(-F.log(1 - level), F.lit(1 / shape))
    if family == "beta":
        a, b = D._read(spec, "alpha", "a"), D._read(spec, "beta", "b")
        low = D._read(spec, "lower", "loc", default=0.0)
        upper = next((spec[n] for n in ("upper", "maximum") if spec.get(n) is not None), None)
        width = float(upper) - low if upper is not None else D._read(spec, "scale", default=1.0)
        if a == 1:
            return low + width * (1 - F.pow(1 - level, F.lit(1 / b)))
        if b == 1:
            return low + width * F.pow(level, F.lit(1 / a))

    @F.pandas_udf("double")
    def at(levels: pd.Series) -> pd.Series:
        return pd.Series(D.quantile(spec, levels.to_numpy(float)))

    return at(level)


def apportioned(weights: list[float], n: Column) -> list[Column]:
    """Whole numbers of n in proportion to the weights: whole parts, then one each by remainder, the first on a tie."""
    total = float(sum(weights))
    share = [F.lit(w / total) * n for w in weights]
    base = [F.floor(s) for s in share]
    rest = [s - b for s, b in zip(share, base, strict=True)]
    left = n - sum(base[1:], base[0])
    before = [sum((F.when((r > rest[i]) | ((r == rest[i]) & F.lit(j < i)), 1).otherwise(0) for j, r in enumerate(rest) if j != i), F.lit(0)) for i in range(len(weights))]
    return [b + F.when(k < left, 1).otherwise(0) for b, k in zip(base, before, strict=True)]


def component(weights: list[float], rank: Column, n: Column) -> Column:
    """Which weight's share a rank (from 0) of n falls into."""
    out, upto = F.lit(len(weights) - 1), F.lit(0)
    bounds = []
    for c in apportioned(weights, n):
        upto = upto + c
        bounds.append(upto)
    for i in reversed(range(len(weights) - 1)):
        out = F.when(rank < bounds[i], F.lit(i)).otherwise(out)
    return out


def drawn(units: DataFrame, streams: dict[str, Column], run: str = "run_id", unit: str = "unit_id", seed: str = "seed") -> DataFrame:
    """`units` with a struct (rank, n, level) for each stream: the unit's place in random order among its run's units of the same group, and its stratified level. A null group: no draw."""
    asked = F.array(*[F.struct(F.lit(n).alias("stream"), g.cast("string").alias("part")) for n, g in streams.items()])
    long = units.select(F.col(run), F.col(unit), F.col(seed), F.inline(asked)).where("part is not null")
    keyed = long.withColumn("_u", uniform(F.col(seed), F.col("stream"), F.col(unit)))
    placed = ranked(keyed, [run, "stream", "part"], ["_u", unit])
    level = (F.col("rank") + uniform(F.col(seed), F.concat("stream", F.lit("+")), F.col(unit))) / F.col("n")
    wide = placed.withColumn("_draw", F.struct("rank", "n", level.alias("level"))).groupBy(run, unit).agg(*[F.max(F.when(F.col("stream") == n, F.col("_draw"))).alias(n) for n in streams])
    return units.join(wide, [run, unit], "left")


def coil(chord: Column, tau: Column, pieces: int = PIECES, turns: int = TURNS) -> Column:
    """Radius of the coil of equal straight pieces whose length is tau times its chord."""
    return chord * F.sqrt(F.greatest(tau * tau - 1, F.lit(0.0))) / (2 * pieces * math.sin(math.pi * turns / pieces))


def assembled(centers: DataFrame, config: dict) -> DataFrame:
    """Units at centers(run_id, unit_id, seed, x, y, z): kind, component, volume, diameter, eta, tau, roughness, the angles asked for, a unit direction, and what the shape needs.

    config: porosity, box, channel_fraction, volume_ratio (a channel's mean over a compact one's), compact and channel
    (relative_volume, eta, roughness; for channels also tau and, if their diameters are asked for instead of volumes,
    diameter), and orientation, either components (weight, theta_xz and theta_xy in degrees) or a polar distribution
    (share of half a turn from x). Units are unique within a run; rows of a null run, unit or seed take no part.
    """
    share = float(config.get("channel_fraction", 0.0))
    parts = config["orientation"].get("components")
    kept = centers.dropna(subset=["run_id", "unit_id", "seed"])
    first = drawn(kept, {"kind": F.lit(0), "orientation": F.lit(0)})
    kinds = first.withColumn("_channel", component([1 - share, share], F.col("kind.rank"), F.col("kind.n")) == 1 if 0 < share < 1 else F.lit(share >= 1))
    kinds = kinds.withColumn("component", component([float(p["weight"]) for p in parts], F.col("orientation.rank"), F.col("orientation.n")) if parts else F.lit(None).cast("int")).drop("kind", "orientation")
    channel = F.col("_channel")
    by_kind, tubes = channel.cast("int"), F.when(channel, F.lit(1))
    angled = {"theta_xz": F.col("component"), "theta_xy": F.col("component")} if parts else {"polar": F.lit(0)}
    second = drawn(kinds, {"relative_volume": by_kind, "eta": by_kind, "roughness": by_kind, "tau": tubes, "diameter": tubes, **angled})

    def of_kind(name: str) -> Column:
        level = F.col(f"{name}.level")
        return F.when(channel, quantile(config["channel"][name], level)).otherwise(quantile(config["compact"][name], level))

    valued = second.select(
        "run_id", "unit_id", "seed", "x", "y", "z", "_channel", "component", of_kind("relative_volume").alias("_relative"), F.greatest(of_kind("eta"), F.lit(1.0)).alias("eta"), of_kind("roughness").alias("roughness"),
        F.when(channel, F.greatest(quantile(config["channel"].get("tau", {"family": "constant", "value": 1.0}), F.col("tau.level")), F.lit(1.0))).alias("tau"),
        (F.when(channel, quantile(config["channel"]["diameter"], F.col("diameter.level"))) if config["channel"].get("diameter") else F.lit(None).cast("double")).alias("_diameter"),
        *_angles(config, parts),
    )
    ratio, room = float(config.get("volume_ratio", 1.0)), float(config["porosity"]) * math.prod(config["box"])
    weight = F.col("_relative") * F.when(channel, ratio).otherwise(1.0)
    totals = valued.groupBy("run_id").agg(F.sum(weight).alias("_total"))  # a row a run
    out = valued.join(totals, "run_id").withColumn("_volume", room * weight / F.col("_total"))
    tube = F.coalesce(F.col("_diameter"), F.pow(4 * F.col("_volume") / (math.pi * F.col("eta")), F.lit(1 / 3)))
    diameter = F.when(channel, tube).otherwise(F.pow(6 * F.col("_volume") / math.pi, F.lit(1 / 3)))
    out = out.withColumn("diameter", diameter).withColumn("volume", F.when(channel, math.pi / 4 * F.pow("diameter", F.lit(2.0)) * F.col("eta") * F.col("diameter")).otherwise(F.col("_volume")))
    arc = F.col("eta") * F.col("diameter")
    out = out.withColumn("chord", F.when(channel, arc / F.col("tau"))).withColumn("coil_radius", F.when(channel, coil(F.col("chord"), F.col("tau"))))
    minor = F.when(~channel, F.pow(3 * F.col("_volume") / (4 * math.pi * F.col("eta")), F.lit(1 / 3)))
    return out.select(
        "run_id", "unit_id", F.when(channel, CHANNEL).otherwise(COMPACT).alias("kind"), "component", "x", "y", "z", "volume", "diameter", "eta", "tau", "roughness", "theta_xz", "theta_xy", "dx", "dy", "dz", "chord", "coil_radius",
        minor.alias("minor_radius"), (minor * F.col("eta")).alias("major_radius"), (uniform(F.col("seed"), "phase", F.col("unit_id")) * 2 * math.pi).alias("phase"), F.when(uniform(F.col("seed"), "hand", F.col("unit_id")) < 0.5, -1.0).otherwise(1.0).alias("hand"),
    )


def _angles(config: dict, parts: list[dict] | None) -> list[Column]:
    """theta_xz and theta_xy in degrees and the direction with these projections, signs at random; or the direction at a polar angle from x."""
    sign = {c: F.when(uniform(F.col("seed"), f"sign-{c}", F.col("unit_id")) < 0.5, -1.0).otherwise(1.0) for c in "yz"}
    if parts:
        angle = {}
        for name in ("theta_xz", "theta_xy"):
            value = F.lit(None).cast("double")
            for i, p in enumerate(parts):
                value = F.when(F.col("component") == i, quantile(p[name], F.col(f"{name}.level"))).otherwise(value)
            angle[name] = value
        along = (F.lit(1.0), sign["y"] * F.tan(F.radians(angle["theta_xy"])), sign["z"] * F.tan(F.radians(angle["theta_xz"])))
        long = G.norm(along)
        return [*(a.alias(n) for n, a in angle.items()), *((a / long).alias(f"d{c}") for c, a in zip("xyz", along, strict=True))]
    polar = math.pi * F.least(F.greatest(quantile(config["orientation"]["polar"], F.col("polar.level")), F.lit(0.0)), F.lit(1.0))
    azimuth = 2 * math.pi * uniform(F.col("seed"), "azimuth", F.col("unit_id"))
    x, y, z = F.cos(polar), F.sin(polar) * F.cos(azimuth), F.sin(polar) * F.sin(azimuth)
    xz, xy = (F.degrees(F.atan2(F.abs(a), F.abs(x))) for a in (z, y))
    return [xz.alias("theta_xz"), xy.alias("theta_xy"), x.alias("dx"), y.alias("dy"), z.alias("dz")]


def centerlines(units: DataFrame, pieces: int = PIECES, turns: int = TURNS) -> DataFrame:
    """run_id, unit_id, place and x, y, z of the points of every channel's centreline, unwrapped, its chord's middle at the centre."""
    channels = units.where(F.col("kind") == CHANNEL).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(pieces))))
    along = (F.col("place") / pieces - 0.5) * F.col("chord")
    turned = F.col("phase") + F.col("hand") * F.col("place") * (2 * math.pi * turns / pieces)
    sides = [F.col("coil_radius") * (f(turned) - f(F.col("phase"))) for f in (F.cos, F.sin)]
    direction = tuple(F.col(f"d{c}") for c in "xyz")
    first, second = G.normal_plane_axes(direction)
    return channels.select("run_id", "unit_id", "place", *[(F.col(c) + along * d + sides[0] * a + sides[1] * b).alias(c) for c, d, a, b in zip("xyz", direction, first, second, strict=True)])


def remeasured(units: DataFrame, lines: DataFrame) -> DataFrame:
    """run_id, unit_id, kind and diameter, eta, tau, theta_xz, theta_xy found again from the geometry alone: channels from their points, compact units from their half axes."""
    step = F.sqrt(sum(((F.col(f"b.{c}") - F.col(f"a.{c}")) * (F.col(f"b.{c}") - F.col(f"a.{c}")) for c in "yz"), (F.col("b.x") - F.col("a.x")) * (F.col("b.x") - F.col("a.x"))))
    points = lines.groupBy("run_id", "unit_id").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))).alias("points"))  # as many as a channel has pieces
    pairs = F.arrays_zip(F.slice("points", 1, F.size("points") - 1).alias("a"), F.slice("points", 2, F.size("points") - 1).alias("b"))
    pieces = points.select("run_id", "unit_id", F.element_at("points", 1).alias("first"), F.element_at("points", -1).alias("last"), F.explode(pairs).alias("pair")).select("run_id", "unit_id", "first", "last", "pair.a", "pair.b")
    spans = pieces.groupBy("run_id", "unit_id").agg(F.sum(step).alias("arc"), *[F.first(F.col(f"last.{c}") - F.col(f"first.{c}")).alias(f"e{c}") for c in "xyz"])
    both = units.join(spans, ["run_id", "unit_id"], "left")
    channel = F.col("kind") == CHANNEL
    ex, ey, ez = (F.when(channel, F.col(f"e{c}")).otherwise(F.col(f"d{c}")) for c in "xyz")
    chord = F.sqrt(F.col("ex") * F.col("ex") + F.col("ey") * F.col("ey") + F.col("ez") * F.col("ez"))
    # a tube's diameter from its volume and length, a body's from the sphere of its half axes
    tube = F.sqrt(4 * F.col("volume") / (math.pi * F.col("arc")))
    body = 2 * F.pow(F.col("minor_radius") * F.col("minor_radius") * F.col("major_radius"), F.lit(1 / 3))
    return both.select(
        "run_id", "unit_id", "kind", F.when(channel, tube).otherwise(body).alias("diameter"), F.when(channel, F.col("arc") / tube).otherwise(F.col("major_radius") / F.col("minor_radius")).alias("eta"),
        F.when(channel, F.col("arc") / chord).alias("tau"), G.projected_angle(ex, ez, ey, 0.0).alias("theta_xz"), G.projected_angle(ex, ey, ez, 0.0).alias("theta_xy"),
    )


def ks_by_group(samples: DataFrame, by: list[str], value: str, cdf: Column) -> DataFrame:
    """by, n and the Kolmogorov-Smirnov distance of a group's values to a continuous distribution, cdf a column of `samples`; groups of any size."""
    placed = ranked(samples.where(F.col(value).isNotNull()).withColumn("_f", cdf).select(*by, F.col(value), "_f"), by, [value])
    upper, lower = F.max(F.abs((F.col("rank") + 1) / F.col("n") - F.col("_f"))), F.max(F.abs(F.col("_f") - F.col("rank") / F.col("n")))
    return placed.groupBy(*by).agg(F.first("n").alias("n"), F.greatest(upper, lower).alias("ks"))


def _span(low: Column, high: Column, spacing: float, n: int | None) -> Column:
    """Voxels whose centres may lie between two places; within 0 .. n - 1 if n is given."""
    first, last = F.ceil(low / spacing - 0.5), F.floor(high / spacing - 0.5)
    if n is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def covered(units: DataFrame, lines: DataFrame, shape: tuple[int, int, int], spacing: float, by: list[str] | None = None) -> DataFrame:
    """by, x, y, z of the voxels whose centre lies in any unit: in the capsule of a channel's piece, or in the ellipsoid of a compact unit.

    Each piece and each body walks through its own bounding box; x and y wrap, z doesn't. by: what keeps phases apart,
    run_id without it; `lines` has it too.
    """
    by = by or ["run_id"]
    nx, ny, nz = shape
    follow = Window.partitionBy(*by, "unit_id").orderBy("place")  # as many rows as a channel has points
    ahead = lines.select(*by, "unit_id", "place", *[F.col(c).alias(f"a{c}") for c in "xyz"], *[F.lead(c).over(follow).alias(f"b{c}") for c in "xyz"]).where("bx is not null")
    radius = units.where(F.col("kind") == CHANNEL).select(*by, "unit_id", (F.col("diameter") / 2).alias("r"))
    pieces = ahead.join(radius, [*by, "unit_id"]).select(*by, "ax", "ay", "az", "bx", "by", "bz", "r")
    boxed = pieces.select(*by, F.struct("ax", "ay", "az", "bx", "by", "bz", "r").alias("s"), *[(F.least(f"a{c}", f"b{c}") - F.col("r")).alias(f"l{c}") for c in "xyz"], *[(F.greatest(f"a{c}", f"b{c}") + F.col("r")).alias(f"h{c}") for c in "xyz"])

    def walked(rows: DataFrame) -> DataFrame:
        for c, n in (("z", nz), ("y", None), ("x", None)):
            rows = rows.withColumn(f"v{c}", F.explode(_span(F.col(f"l{c}"), F.col(f"h{c}"), spacing, n)))
        return rows

    centre = {c: (F.col(f"v{c}") + 0.5) * spacing for c in "xyz"}
    s = F.col("s")
    way = [s[f"b{c}"] - s[f"a{c}"] for c in "xyz"]
    off = [centre[c] - s[f"a{c}"] for c in "xyz"]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    t = F.least(F.greatest(F.coalesce(dot(off, way) / F.nullif(dot(way, way), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    rest = [o - t * w for o, w in zip(off, way, strict=True)]
    tubes = walked(boxed).where(dot(rest, rest) < s["r"] * s["r"])
    bodies = units.where(F.col("kind") == COMPACT).select(*by, F.struct("x", "y", "z", "dx", "dy", "dz", "minor_radius", "major_radius").alias("s"), *[(F.col(c) - F.greatest("minor_radius", "major_radius")).alias(f"l{c}") for c in "xyz"], *[(F.col(c) + F.greatest("minor_radius", "major_radius")).alias(f"h{c}") for c in "xyz"])
    from_middle = [centre[c] - s[c] for c in "xyz"]
    along = dot(from_middle, [s[f"d{c}"] for c in "xyz"])
    across = dot(from_middle, from_middle) - along * along
    filled = walked(bodies).where(across / (s["minor_radius"] * s["minor_radius"]) + along * along / (s["major_radius"] * s["major_radius"]) < 1)
    at = [F.pmod("vx", F.lit(nx)).cast("int").alias("x"), F.pmod("vy", F.lit(ny)).cast("int").alias("y"), F.col("vz").cast("int").alias("z")]
    return tubes.select(*by, *at).unionByName(filled.select(*by, *at)).distinct()


def scaled(units: DataFrame, scale: Column) -> DataFrame:
    """Units made larger about their own centres: lengths by the scale, volumes by its cube."""
    lengths = ["diameter", "chord", "coil_radius", "minor_radius", "major_radius"]
    out = units.withColumn("volume", F.col("volume") * scale * scale * scale)
    for c in lengths:
        out = out.withColumn(c, F.col(c) * scale)
    return out


def porosities(units: DataFrame, scales: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """run_id, scale and porosity of every (run_id, scale): all of them in one job."""
    by = ["run_id", "scale"]
    larger = scaled(units.join(scales, "run_id"), F.col("scale"))
    lines = centerlines(larger.withColumn("unit_id", F.struct("scale", "unit_id"))).select("run_id", F.col("unit_id.scale").alias("scale"), F.col("unit_id.unit_id").alias("unit_id"), "place", "x", "y", "z")
    counts = covered(larger, lines, shape, spacing, by).groupBy(*by).agg(F.count("*").alias("n"))
    return scales.join(counts, by, "left").select(*by, (F.coalesce("n", F.lit(0)) / F.lit(float(shape[0] * shape[1] * shape[2]))).alias("porosity"))


def solved_scales(units: DataFrame, target: float, shape: tuple[int, int, int], spacing: float, low: float = 0.1, high: float = 10.0, each: int = 7, rounds: int = 4) -> DataFrame:
    """run_id, scale and porosity: of all scales tried, the one whose porosity is nearest the target, the smaller one on a tie.

    Porosity grows with the scale. A round tries `each` scales between each run's bounds, evenly in their logarithm,
    and the next goes on between the two around the target: after r rounds bounds are (each + 1)**r times as close.
    """
    bounds = units.select("run_id").distinct().select("run_id", F.lit(low).alias("low"), F.lit(high).alias("high"))
    tried = None
    for _ in range(rounds):
        bounds = written(bounds, "bounds")
        steps = F.transform(F.sequence(F.lit(1), F.lit(each)), lambda i: F.col("low") * F.pow(F.col("high") / F.col("low"), i / F.lit(each + 1.0)))
        found = written(porosities(units, bounds.select("run_id", F.explode(steps).alias("scale")), shape, spacing), "porosities")
        tried = found if tried is None else tried.unionByName(found)
        around = found.groupBy("run_id").agg(F.max(F.when(F.col("porosity") < target, F.col("scale"))).alias("_low"), F.min(F.when(F.col("porosity") >= target, F.col("scale"))).alias("_high"))
        bounds = bounds.join(around, "run_id").select("run_id", F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"))
    best = F.min(F.struct(F.abs(F.col("porosity") - target).alias("off"), "scale", "porosity")).alias("b")
    return tried.groupBy("run_id").agg(best).select("run_id", "b.scale", "b.porosity")
