"""Points against triangles: sides of a closed surface by columns, nearest faces by cells, and both against voxels.

Triangles are rows (face, x1, y1, z1 .. z3); equal ones are met once. For sides a triangle is dealt to the columns of cells its
bounding box meets, a point to its own, and they meet by an equi-join; a cell's points are spread over several tasks where there
are few cells. For nearest faces cells of points meet groups of like triangles, both halved again and again, and a cell keeps
the groups that may be nearest. No point meets all triangles, no task holds the surface, and triangles repeated by cell are
never broadcast: the size of their file says little of them. Expressions are SQL text in the functions that both Spark and other
engines have, so that they can be checked there as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.voxels import evenly_sampled
from voxlake.tables import dropped, written

CORNERS = [f"{c}{v}" for v in "123" for c in "xyz"]
#: Points of one x and y that a triangle is tried on at once, and how many must have one on average for packs to be made.
PACK, SHARED = 64, 4
#: So many pairs of points and triangles are all measured; so many of cells and groups begin a descent.
FEW, FIRST = 2**22, 2**19
#: Groups that are broadcast, of some 200 bytes; more meet the cells in a shuffle.
GROUPS = 2**14


def _side(p: str, q: str) -> str:
    """Which side of the line from p to q a point lies on in the plane of x and y; from the same end for both triangles of an edge, so that they never disagree."""
    first = f"(x{p} < x{q} or (x{p} = x{q} and y{p} <= y{q}))"
    of = lambda u, v: f"((x{v} - x{u}) * (y - y{u}) - (y{v} - y{u}) * (x - x{u}))"
    return f"(case when {first} then {of(p, q)} else -{of(q, p)} end)"


#: Twice the area of a triangle's shadow, with its sign.
SHADOW = "((x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1))"


def _within(p: str, q: str) -> str:
    """Inside an edge, or on it if it is one of those whose points count."""
    turned = f"(case when {SHADOW} > 0 then 1 else -1 end)"
    on = f"((y{q} - y{p}) * {turned} > 0 or (y{q} = y{p} and (x{q} - x{p}) * {turned} < 0))"
    return f"({_side(p, q)} * {turned} > 0 or ({_side(p, q)} = 0 and {on}))"


_NX, _NY = "((y2 - y1) * (z3 - z1) - (z2 - z1) * (y3 - y1))", "((z2 - z1) * (x3 - x1) - (x2 - x1) * (z3 - z1))"
#: The ray upwards from (x, y, z) goes through the triangle.
CROSSED = f"({SHADOW} <> 0 and {_within('1', '2')} and {_within('2', '3')} and {_within('3', '1')} and z1 - ({_NX} * (x - x1) + {_NY} * (y - y1)) / nullif({SHADOW}, 0) > z)"


def _dot(a: list[str], b: list[str]) -> str:
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b, strict=True)) + ")"


def _minus(a: str, b: str) -> list[str]:
    return [f"({c}{a} - {c}{b})" for c in "xyz"]


def _to_segment(p: str, q: str) -> str:
    """Squared distance of (x, y, z) to a segment."""
    along, off = _minus(q, p), _minus("", p)
    t = f"least(greatest(coalesce({_dot(off, along)} / nullif({_dot(along, along)}, 0), 0), 0), 1)"
    rest = [f"({o} - {t} * {d})" for o, d in zip(off, along, strict=True)]
    return _dot(rest, rest)


def _cross(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


_NORMAL = _cross(_minus("2", "1"), _minus("3", "1"))
_OVER = " and ".join(f"{_dot(_NORMAL, _cross(_minus(q, p), _minus('', p)))} >= 0" for p, q in ("12", "23", "31"))
#: Squared distance of (x, y, z) to the triangle: of its plane if the foot lies inside, else of the nearest edge.
SQUARED = f"(case when {_dot(_NORMAL, _NORMAL)} > 0 and {_OVER} then {_dot(_NORMAL, _minus('', '1'))} * {_dot(_NORMAL, _minus('', '1'))} / nullif({_dot(_NORMAL, _NORMAL)}, 0) else least({_to_segment('1', '2')}, {_to_segment('2', '3')}, {_to_segment('3', '1')}) end)"


def _sides(triangles: DataFrame) -> DataFrame:
    """Triangles that have a shadow, with what CROSSED needs of each worked out once: a test of a pair then is a few operations, with the same results.

    Each step names what the next one uses several times, so that no expression grows long.
    """
    out = triangles.withColumn("_shadow", F.expr(SHADOW)).where("_shadow <> 0")
    out = out.withColumns({"_nx": F.expr(_NX), "_ny": F.expr(_NY), "_turned": F.when(F.col("_shadow") > 0, 1.0).otherwise(-1.0)})
    edges = ("12", "23", "31")
    out = out.withColumns({f"_d{c}{p}": F.col("_turned") * (F.col(f"{c}{q}") - F.col(f"{c}{p}")) for p, q in edges for c in "xy"})
    out = out.withColumns({f"_u{c}{p}": F.expr(f"case when x{p} < x{q} or (x{p} = x{q} and y{p} <= y{q}) then {c}{p} else {c}{q} end") for p, q in edges for c in "xy"})
    return out.withColumns({f"_on{p}": F.expr(f"_dy{p} > 0 or (y{q} = y{p} and _dx{p} < 0)") for p, q in edges}).drop("_turned")


#: Where the upright line through (x, y) meets the plane of a triangle of _sides.
_HEIGHT = "z1 - (_nx * (x - x1) + _ny * (y - y1)) / _shadow"


def _shaded(met: DataFrame) -> DataFrame:
    """The pairs of points and triangles of _sides whose shadow the point's x and y lie in."""
    side = [F.col(f"_dx{p}") * (F.col("y") - F.col(f"_uy{p}")) - F.col(f"_dy{p}") * (F.col("x") - F.col(f"_ux{p}")) for p in "123"]
    within = [(s > 0) | ((s == 0) & F.col(f"_on{p}")) for s, p in zip(side, "123", strict=True)]
    return met.where(within[0] & within[1] & within[2])


def _crossed(met: DataFrame) -> DataFrame:
    """The pairs that CROSSED holds for, of points and triangles of _sides."""
    return _shaded(met).where(F.expr(f"{_HEIGHT} > z"))


def _packs(points: DataFrame) -> DataFrame:
    """Points (id, x, y, z) of one x and y as rows (x, y, pack, held), about PACK of them each, however many there are."""
    crowded = points.groupBy("x", "y").agg(F.count("*").alias("_n")).where(F.col("_n") > PACK)
    dealt = points.join(crowded, ["x", "y"], "left").withColumn("pack", F.pmod(F.hash("id", "z"), F.ceil(F.coalesce("_n", F.lit(1)) / PACK)))
    return dealt.groupBy("x", "y", "pack").agg(F.collect_list(F.struct("id", "z")).alias("held"))


def _squares(*columns: pd.Series) -> pd.Series:
    """SQUARED of x, y, z and the nine corners by arrays, operation by operation: as an expression it makes a method too long for the compiler."""
    at, *corner = (np.stack([c.to_numpy() for c in columns[i : i + 3]]) for i in range(0, 12, 3))
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = lambda a, b: np.stack([a[i] * b[j] - a[j] * b[i] for i, j in ((1, 2), (2, 0), (0, 1))])
    normal = cross(corner[1] - corner[0], corner[2] - corner[0])
    plane, size, over, edge = dot(normal, at - corner[0]), dot(normal, normal), True, None
    for p, q in ((0, 1), (1, 2), (2, 0)):
        along, off = corner[q] - corner[p], at - corner[p]
        over = over & (dot(normal, cross(along, off)) >= 0)
        length = dot(along, along)
        rest = off - np.clip(np.where(length > 0, dot(off, along) / np.where(length > 0, length, 1.0), 0.0), 0.0, 1.0) * along
        edge = dot(rest, rest) if edge is None else np.minimum(edge, dot(rest, rest))
    return pd.Series(np.where((size > 0) & over, plane * plane / np.where(size > 0, size, 1.0), edge))


def _squared(met: DataFrame, *held: str | Column) -> DataFrame:
    """`held` (id and face) and _s, SQUARED of points and triangles."""
    return met.select(*(held or ("id", "face")), F.pandas_udf(_squares, "double").asNondeterministic()("x", "y", "z", *CORNERS).alias("_s"))  # or a filter on _s measures again


def _dealt(triangles: DataFrame, cell: float, axes: str) -> DataFrame:
    """Each triangle once for every cell its bounding box meets."""
    out = triangles
    for c in axes:
        ends = [F.col(f"{c}{v}") for v in "123"]
        out = out.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.least(*ends) / cell), F.floor(F.greatest(*ends) / cell))))
    return out


def _sound(triangles: DataFrame) -> DataFrame:
    """Triangles with all their numbers, once for each set of corners in order: the smallest face, and copies, how many there are."""
    size = sum((F.abs(F.col(c)) for c in CORNERS[1:]), F.abs(F.col(CORNERS[0])))
    sound = triangles.select("face", *[F.col(c).cast("double").alias(c) for c in CORNERS]).where(size < float("inf"))
    return sound.groupBy(*CORNERS).agg(F.min("face").alias("face"), F.count("*").alias("copies"))


def cell_size(triangles: DataFrame) -> float:
    """The mean length of the bounding boxes' longest sides: a triangle meets a few cells, and a cell few triangles."""
    longest = F.greatest(*[F.greatest(*ends) - F.least(*ends) for ends in ([F.col(f"{c}{v}") for v in "123"] for c in "xyz")])
    return float(triangles.agg(F.avg(longest)).first()[0] or 1.0) or 1.0


def _ends(points: DataFrame, triangles: DataFrame, axes: str = "xyz") -> dict[str, tuple[float, float]] | None:
    """Where points and triangles lie, by axis; None without either."""
    held = triangles.agg(*[g(h(*[F.col(f"{c}{v}") for v in "123"])).alias(f"{n}{c}") for c in axes for n, g, h in (("l", F.min, F.least), ("h", F.max, F.greatest))]).first()
    spread = points.agg(*[g(c).alias(f"{n}{c}") for c in axes for n, g in (("l", F.min), ("h", F.max))]).first()
    if held["lx"] is None or spread["lx"] is None:
        return None
    return {c: (min(held[f"l{c}"], spread[f"l{c}"]), max(held[f"h{c}"], spread[f"h{c}"])) for c in axes}


def _finite(points: DataFrame) -> DataFrame:
    return points.select("id", "x", "y", "z").where(F.abs(F.col("x")) + F.abs(F.col("y")) + F.abs(F.col("z")) < float("inf"))


def _parts(df: DataFrame, rows: int = 0) -> int:
    """Tasks that keep all cores busy, with about half a million of `rows` each at most."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, rows >> 19)


def _met(points: DataFrame, triangles: DataFrame, cell: float, ends: dict[str, tuple[float, float]], axes: str, by: tuple[str, ...] = ("id",), n: int | None = None) -> DataFrame:
    """Points with the triangles of their cell. With fewer cells than keep all tasks busy, a cell's points are dealt by columns `by` to several tasks and its triangles go to each; with `n` points given, not to more than a cell has points."""
    parts = _parts(points)
    cells = math.prod((ends[c][1] - ends[c][0]) / cell + 1 for c in axes)
    ways = math.ceil(min(max(4 * parts / cells, 1), parts))
    if n is not None:
        ways = min(ways, max(int(n / cells), 1))
    keys = [*[f"_{c}" for c in axes], "_way"]
    here = points.withColumns({f"_{c}": F.floor(F.col(c) / cell) for c in axes}).withColumn("_way", F.pmod(F.hash(*by), F.lit(ways)))
    there = _dealt(triangles, cell, axes).withColumn("_way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return here.repartition(parts, *keys).join(there.hint("merge"), keys)


def crossings(points: DataFrame, triangles: DataFrame, cell: float | None = None) -> DataFrame:
    """id and n, the triangles over each point (id, x, y, z) that has any: only those of its own column of cells are tried, on packs of points where many have one x and y."""
    here, held = _finite(points), written(_sound(triangles).drop("face"), "triangles")
    ends = _ends(here, held, "xy")
    if ends is None:
        return points.select("id", F.lit(0).cast("bigint").alias("n")).limit(0)
    cell = cell or cell_size(held)
    n, columns = here.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("x", "y"))).first()
    if n < SHARED * columns:
        over = _crossed(_met(here, _sides(held), cell, ends, "xy"))
    else:
        packs = written(_packs(here), "packs")
        met = _shaded(_met(packs, _sides(held), cell, ends, "xy", by=("x", "y", "pack"), n=packs.count()))
        over = met.select("copies", F.expr(_HEIGHT).alias("_height"), F.explode("held").alias("p")).where(F.col("_height") > F.col("p.z")).select("p.id", "copies")
    return over.groupBy("id").agg(F.sum("copies").alias("n"))


def inside(points: DataFrame, triangles: DataFrame, cell: float | None = None) -> DataFrame:
    """`points` with inside: an odd number of a closed surface's triangles lies over the point."""
    n = crossings(points, triangles, cell)
    return points.join(n.withColumnRenamed("n", "_n"), "id", "left").withColumn("inside", F.coalesce(F.col("_n") % 2 == 1, F.lit(False))).drop("_n")


def _nearest(near: DataFrame, *by: str) -> DataFrame:
    """`by` and m, the distance and face of the nearest of the triangles met, the smaller face on a tie."""
    return _squared(near, *by, "face").groupBy(*by).agg(F.min(F.struct(F.sqrt("_s").alias("distance"), "face")).alias("m"))


def _above(level: int, depth: int, columns: list[str]) -> list[Column]:
    """Numbers of the cells at `level`, from those at `depth`."""
    return [F.shiftright(F.col(f"_{c}"), depth - level) for c in columns]


def _groups(triangles: DataFrame, part: Column, level: int, depth: int, unit: float) -> DataFrame:
    """Groups of triangles whose corners lie in the same nine cells: part, the group they come from, group, the middles and n of its triangles, r, how far they reach from the triangle through the middles, and the ends of them all, in half units.

    Middles are whole numbers, whose products are exact, so that no sliver is taken for a plane. Groups are told by a hash:
    should two have one, both are kept wherever either is, and nothing is lost.
    """
    keys = [k.alias(f"_k{c}") for k, c in zip(_above(level, depth, CORNERS), CORNERS, strict=True)]
    rows = triangles.select(part.alias("part"), *keys, *[f"_{c}" for c in CORNERS]).groupBy("part", *[f"_k{c}" for c in CORNERS])
    out = rows.agg(F.count("*").alias("n"), *[g(f"_{c}").alias(f"{e}{c}") for c in CORNERS for e, g in (("l", F.min), ("h", F.max))])
    reach = [F.sqrt(sum(F.pow(F.col(f"h{c}{v}") - F.col(f"l{c}{v}") + 1, F.lit(2.0)) for c in "xyz")) for v in "123"]
    held = {c: (F.col(f"l{c}") + F.col(f"h{c}") + 1).cast("double") for c in CORNERS} | {"group": F.xxhash64(*[f"_k{c}" for c in CORNERS]), "r": F.greatest(*reach) * (unit / 2)}
    held |= {f"{e}{c}": 2.0 * (g(*[F.col(f"{e}{c}{v}") for v in "123"]) + off) for c in "xyz" for e, g, off in (("l", F.least, 0), ("h", F.greatest, 1))}
    return out.select("part", "n", *[v.alias(k) for k, v in held.items()])


def _kept(met: DataFrame, groups: DataFrame, few: bool, low: dict[str, float], unit: float, parts: int) -> DataFrame:
    """Cells or places (px, py, pz), whose points lie within h of (mx, my, mz), with those groups of their groups' that may hold the nearest triangle of a point there.

    No triangle of a group is nearer to a point of the cell than the distance of the middles less h and r, and each is as near
    as that distance, h and r; the least of these is handed down as top. A unit more stands for rounding.
    """
    at = ["px", "py", "pz"]
    met = met.withColumns({c: (F.col(f"m{c}") - low[c]) / (unit / 2) for c in "xyz"}).withColumnRenamed("group", "part")
    tried = met.repartition(parts, *at).join(groups.hint("broadcast"), "part") if few else met.join(groups.hint("merge"), "part")
    off = [F.greatest(F.col(f"l{c}") - F.col(c), F.col(c) - F.col(f"h{c}"), F.lit(0.0)) for c in "xyz"]
    tried = tried.where(F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]) * (unit / 2) - F.col("h") - unit <= F.col("top"))
    measured = _squared(tried, *at, "group", "n", "top", (F.col("h") + F.col("r") + unit).alias("slack"))
    measured = measured.withColumn("_d", F.sqrt("_s") * (unit / 2)).where(F.col("_d") - F.col("slack") <= F.col("top"))
    least = F.min(F.col("_d") + F.col("slack")).over(Window.partitionBy(*at))
    dealt = measured if few else measured.repartition(parts, *at)
    return dealt.withColumn("top", F.least("top", least)).where(F.col("_d") - F.col("slack") <= F.col("top")).select(*at, "group", "n", "top")


def nearest_face(points: DataFrame, triangles: DataFrame, cell: float | None = None) -> DataFrame:
    """id, face and distance of the nearest triangle of every point (id, x, y, z), the smaller face on a tie.

    Cells of points meet groups of triangles alike in all corners, both halved again and again, and each cell keeps the groups
    that may be nearest; where cells hold few points these take their place, and groups are halved until they hold few
    triangles, which are measured. The descent begins with cells `cell` wide, or as narrow as leaves FEW pairs.
    Points with a null or non-finite place, and all if there are no triangles, have no row.
    """
    held = written(_sound(triangles).drop("copies"), "triangles")
    here = _finite(points).withColumns({c: F.col(c).cast("double") for c in "xyz"})
    ends = _ends(here, held)
    if ends is None:
        return points.select("id", F.lit(None).cast(dict(held.dtypes)["face"]).alias("face"), F.lit(None).cast("double").alias("distance")).limit(0)
    number = here.count()
    if cell is None and number * held.count() <= FEW:
        return _nearest(here.repartition(_parts(here)).crossJoin(held.coalesce(1).hint("shuffle_replicate_nl")), "id").select("id", "m.face", "m.distance")
    near = _descended(here, held, ends, number, cell)
    best = _nearest(near, "x", "y", "z")
    return here.join(best.hint("merge"), ["x", "y", "z"]).groupBy("id").agg(F.min("m").alias("m")).select("id", "m.face", "m.distance")


def _descended(points: DataFrame, triangles: DataFrame, ends: dict[str, tuple[float, float]], number: int, cell: float | None = None) -> DataFrame:
    """Places of points (x, y, z) with the triangles that may be nearest."""
    at, low = ["px", "py", "pz"], {c: ends[c][0] for c in "xyz"}
    wide = max(high - least for least, high in ends.values()) or 1.0
    longest = F.greatest(*[F.greatest(*e) - F.least(*e) for e in ([F.col(f"{c}{v}") for v in "123"] for c in "xyz")])
    side = triangles.agg(F.max(longest)).first()[0] or wide
    depth = min(40, 25 + math.floor(math.log2(wide / side)))  # no triangle is more than 2**26 half cells long
    numbers = lambda columns: [F.floor((F.col(c) - low[c[0]]) / wide * 2.0**depth).alias(f"_{c}") for c in columns]
    unit = wide / 2.0**depth
    numbers = lambda columns: [F.floor((F.col(c) - low[c[0]]) / unit).alias(f"_{c}") for c in columns]
    places = written(points.select("x", "y", "z", *numbers("xyz")).distinct(), "places")
    held = written(triangles.select("*", *numbers(CORNERS)), "triangles")

    def counts(df: DataFrame, columns: list[str]) -> list[int]:
        """About how many cells or groups there are at each level."""
        rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")).groupBy("level")
        n = rows.agg(F.approx_count_distinct(F.xxhash64(*[F.expr(f"shiftright(_{c}, {depth} - level)") for c in columns])).alias("n")).collect()
        return [r["n"] for r in sorted(n, key=lambda r: r["level"])]

    def cells_of(level: int, over: int) -> DataFrame:
        """Cells of places, the cells at level `over` they are part of (qx, qy, qz), and where their places lie."""
        keys = [k.alias(f"{p}{c}") for p, at_level in (("q", over), ("p", level)) for k, c in zip(_above(at_level, depth, list("xyz")), "xyz", strict=True)]
        ends = [g(c).alias(f"{e}{c}") for c in "xyz" for e, g in (("l", F.min), ("h", F.max))]
        out = places.select(*keys, "x", "y", "z").groupBy("qx", "qy", "qz", *at).agg(*ends)
        spread = [(F.col(f"h{c}") - F.col(f"l{c}")) / 2 for c in "xyz"]
        return out.select("qx", "qy", "qz", *at, *[(F.col(f"l{c}") + s).alias(f"m{c}") for c, s in zip("xyz", spread, strict=True)], F.sqrt(sum(s * s for s in spread)).alias("h"))

    def itself(met: DataFrame) -> DataFrame:
        """Places, which are their own middles."""
        return met.withColumns({f"m{c}": F.col(f"p{c}") for c in "xyz"} | {"h": F.lit(0.0)})

    cells, groups = counts(places, list("xyz")), counts(held, CORNERS)
    level = max((k for k in range(depth + 1) if groups[k] <= GROUPS and cells[k] * groups[k] <= FIRST), default=0)
    if cell is not None:
        level = min(max(math.ceil(math.log2(wide / cell)), 0), depth)
    part, exact, was, rows = F.lit(0), False, None, cells[level] * groups[level]
    met = cells_of(level, level).drop("qx", "qy", "qz").withColumns({"group": F.lit(0), "top": F.lit(float("inf"))})
    while True:
        near = written(_kept(met, _groups(held, part, level, depth, unit), groups[level] <= GROUPS, low, unit, _parts(places, 4 * rows)), "near")
        if was is not None:
            dropped(was)
        was = near
        rows, pairs = near.agg(F.count("*"), F.sum("n")).first()
        part = F.xxhash64(*_above(level, depth, CORNERS))
        if exact and (level == depth or pairs <= max(FEW, 4 * rows)):
            return near.select(*[F.col(p).alias(c) for c, p in zip("xyz", at, strict=True)], "group").join(held.select(part.alias("group"), "face", *CORNERS).hint("merge"), "group")
        met, over = near.select(*at, "group", "top"), level
        level = min(level + (2 if exact else 1), depth)
        if exact:
            met = itself(met)
            continue
        exact = level == depth or 4 * cells[level] >= number
        keys = [k.alias(f"q{c}") for k, c in zip(_above(over, depth, list("xyz")), "xyz", strict=True)]
        inner = itself(places.select(*keys, *[F.col(c).alias(f"p{c}") for c in "xyz"])) if exact else cells_of(level, over)
        met = met.withColumnsRenamed({f"p{c}": f"q{c}" for c in "xyz"}).join(inner.hint("merge"), ["qx", "qy", "qz"]).drop("qx", "qy", "qz")


def occupancy_mismatch(voxels: DataFrame, triangles: DataFrame, spacing: float = 1.0, most: int | None = None, cell: float | None = None) -> DataFrame:
    """One row: n and mismatch, the share of voxels (x, y, z, pore) whose centre's side of the surface isn't what `pore` says; of `most` evenly spaced ones if given."""
    placed = voxels.select("x", "y", "z", "pore")
    some = evenly_sampled(placed, ["z", "y", "x"], most) if most else placed
    rows = written(some.withColumn("id", F.struct("z", "y", "x")), "voxels")
    centres = rows.select("id", "pore", *[((F.col(c) + 0.5) * spacing).alias(c) for c in "xyz"])
    wrong = F.count_if(F.col("inside") != F.col("pore"))
    return inside(centres, triangles, cell).agg(F.count("*").alias("n"), (wrong / F.nullif(F.count("*"), F.lit(0))).alias("mismatch"))


def octahedra(spheres: DataFrame) -> DataFrame:
    """face and corners of eight triangles inside each sphere (id, cx, cy, cz, r), facing outwards. Spheres are dealt to tasks first, as a small file is read by one."""
    faces = []
    for k in range(8):
        sx, sy, sz = (1 if k >> i & 1 else -1 for i in range(3))
        tips = [("cx", sx, 0), ("cy", sy, 1), ("cz", sz, 2)]
        if sx * sy * sz < 0:
            tips[1], tips[2] = tips[2], tips[1]
        corners: list[Column] = [F.lit(k).cast("bigint").alias("k")]
        for v, (_, sign, axis) in zip("123", tips, strict=True):
            corners += [(F.col(f"c{c}") + (sign * F.col("r") if i == axis else F.lit(0.0))).alias(f"{c}{v}") for i, c in enumerate("xyz")]
        faces.append(F.struct(*corners))
    return spheres.repartition("id").select("id", F.explode(F.array(*faces)).alias("f")).select((F.col("id") * 8 + F.col("f.k")).alias("face"), *[f"f.{c}" for c in CORNERS])

