"""Ordered-sequence operators: per-key windows, and running totals over one global order without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.geometry import minimum_image
from voxlake.tables import written


def running_totals(rows: DataFrame, order: list[str], sums: dict[str, str], ahead: dict[str, str] | None = None) -> DataFrame:
    """`rows` with, for each name of `sums`, the total of its column up to and including each row in the global order, and for each of `ahead` its column's value in the next row.

    Rows are range-partitioned once; each partition sums its own. What the partitions tell each other, a row each of
    totals and first values, is collected: never more rows than there are partitions.
    """
    ahead = ahead or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *ahead.values()])])
    facts = placed.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.min(row).alias("_first")).orderBy("_part").collect()
    starts, before = [], dict.fromkeys(sums)
    for i, f in enumerate(facts):
        following = facts[i + 1] if i + 1 < len(facts) else None
        nexts = [following["_first"][c] if following else None for c in ahead.values()]
        starts.append((f["_part"], *before.values(), *nexts))
        before = {n: (b or 0) + (f[n] or 0) for n, b in before.items()}
    kinds = dict(placed.agg(*[F.sum(c).alias(n) for n, c in sums.items()]).dtypes) | {n: dict(placed.dtypes)[c] for n, c in ahead.items()}
    schema = "_part int" + "".join(f", `_{n}` {t}" for n, t in kinds.items())
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, schema))
    w = Window.partitionBy("_part").orderBy(*order)
    out = placed.join(known, "_part")
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.col(f"_{n}"), F.lit(0)))
    last = F.lead(F.lit(True)).over(w).isNull()
    for n, c in ahead.items():
        out = out.withColumn(n, F.when(last, F.col(f"_{n}")).otherwise(F.lead(c).over(w)))
    return out.drop("_part", *[f"_{n}" for n in kinds])


def running_total(rows: DataFrame, order: list[str], value: str, out: str = "running") -> DataFrame:
    """`rows` with the total of `value` up to and including each row in the global order."""
    return running_totals(rows, order, {out: value})


def ranked(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """`rows` with rank (from 0, by `order`, which decides every tie) and n within their group. Rows of a null group take no part.

    A range sort over (by, order): a partition numbers its own rows, and a table of a row a partition and group says
    where each group's part begins. Groups of any size and number; no task holds a group.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.dropna(subset=by)
    placed = written(kept.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    starts = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(group).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return placed.withColumn("_place", place).join(starts, [*by, "_part"]).withColumn("rank", F.col("_start") + F.col("_place") - 1).drop("_part", "_place", "_start")


def ecdf(rows: DataFrame, column: str) -> DataFrame:
    """value, n, upto (rows no larger) and total, one row for each different value."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return running_total(counts, ["value"], "n", "upto").crossJoin(F.broadcast(total))  # one row


def steps(rows: DataFrame, by: str, order: list[str], columns: list[str], box: dict[str, float] | None = None) -> DataFrame:
    """d_<column>: each row's difference from the one before, by its minimum image where the box has a side for it; 0 for the first."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows
    for c in columns:
        d = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
        out = out.withColumn(f"d_{c}", minimum_image(d, box[c]) if box and c in box else d)
    return out


def unwrapped(rows: DataFrame, by: str, order: list[str], column: str, length: float) -> DataFrame:
    """`column` followed across a periodic border: the first value and the running sum of minimum-image steps."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stepped = steps(rows, by, order, [column], {column: length})
    return stepped.withColumn("unwrapped", F.first(column).over(w) + F.sum(f"d_{column}").over(w))


def arc_length(rows: DataFrame, by: str, order: list[str], step: Column, out: str = "arc") -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(step).over(w))


def interpolated(rows: DataFrame, by: str, order: list[str], at: str, value: str, spacing: float) -> DataFrame:
    """by, s and value at every multiple of `spacing` between a key's first and last `at`, linear between the rows around it.

    The row to the left holds: each row knows its follower and makes the points between them itself, so no range join
    is needed. At equal places the later row counts.
    """
    w = Window.partitionBy(by).orderBy(*order)
    ahead = rows.withColumn("_at", F.lead(at).over(w)).withColumn("_value", F.lead(value).over(w))
    first = F.ceil(F.col(at) / spacing).cast("bigint")
    last = F.when(F.col("_at").isNull(), F.floor(F.col(at) / spacing)).otherwise(F.ceil(F.col("_at") / spacing) - 1).cast("bigint")
    points = ahead.withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    s = F.col("_k") * F.lit(spacing)
    mixed = F.when(F.col("_at").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("_value") - F.col(value)) * (s - F.col(at)) / (F.col("_at") - F.col(at)))
    return points.select(by, s.alias("s"), mixed.alias(value))


def interpolated_in_blocks(rows: DataFrame, by: str, order: list[str], at: str, value: str, spacing: float, block: float) -> DataFrame:
    """by, place and value at every multiple of `spacing`, place its number: `interpolated`, for keys too large for one task.

    A key's rows are put in order within blocks of `block` along `at`; the last row of a block takes its follower from
    a table with the first row of every block, which alone is put in order by key.
    """
    placed = rows.withColumn("_block", F.floor(F.col(at) / block))
    first = F.min(F.struct(*order, F.col(value).alias("_v"), F.col(at).alias("_a")))
    starts = placed.groupBy(by, "_block").agg(first.alias("_first"))
    following = starts.withColumn("_next", F.lead("_first").over(Window.partitionBy(by).orderBy("_block"))).select(by, "_block", F.col("_next._a").alias("_na"), F.col("_next._v").alias("_nv"))
    w = Window.partitionBy(by, "_block").orderBy(*order)
    ahead = placed.withColumn("_at", F.lead(at).over(w)).withColumn("_value", F.lead(value).over(w)).join(following, [by, "_block"])
    ahead = ahead.withColumn("_value", F.when(F.col("_at").isNull(), F.col("_nv")).otherwise(F.col("_value"))).withColumn("_at", F.coalesce("_at", "_na"))
    low = F.ceil(F.col(at) / spacing).cast("bigint")
    high = F.when(F.col("_at").isNull(), F.floor(F.col(at) / spacing)).otherwise(F.ceil(F.col("_at") / spacing) - 1).cast("bigint")
    points = ahead.withColumn("place", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    mixed = F.when(F.col("_at").isNull(), F.col(value)).otherwise(F.col(value) + (F.col("_value") - F.col(value)) * (F.col("place") * F.lit(spacing) - F.col(at)) / (F.col("_at") - F.col(at)))
    return points.select(by, "place", mixed.alias(value))


def near_event(rows: DataFrame, by: str, at: str, order: list[str], is_event: Column, reach: float) -> DataFrame:
    """`rows` with excluded: an event of the key is no farther than `reach`; rows stay, flagged."""
    marks = F.when(is_event, F.col(at))
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    last, following = F.max(marks).over(before), F.min(marks).over(after)
    near = (F.col(at) - last <= reach) | (following - F.col(at) <= reach)
    return rows.withColumn("excluded", F.coalesce(near, F.lit(False)))


def circular(rows: DataFrame, by: str, order: list[str], column: str) -> tuple[Column, Column]:
    """The value before and after on a closed curve."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(column).over(w), F.last(column).over(whole)), F.coalesce(F.lead(column).over(w), F.first(column).over(whole))


#: Weights exp(-k * k / 2) of a Gaussian of one sample, cut off after four.
GAUSSIAN_REACH = 4


def gaussian_smoothed(rows: DataFrame, by: str, order: list[str], column: str, out: str = "smooth") -> DataFrame:
    """A Gaussian of one sample, ends repeated outwards and themselves left as they are."""
    import math

    weights = [math.exp(-0.5 * k * k) for k in range(-GAUSSIAN_REACH, GAUSSIAN_REACH + 1)]
    total = sum(weights)
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(whole), F.last(column).over(whole)
    mixed = None
    for k, weight in zip(range(-GAUSSIAN_REACH, GAUSSIAN_REACH + 1), weights, strict=True):
        near = F.col(column) if k == 0 else F.coalesce(F.lag(column, -k).over(w), first) if k < 0 else F.coalesce(F.lead(column, k).over(w), last)
        part = near * (weight / total)
        mixed = part if mixed is None else mixed + part
    edge = F.lag(column).over(w).isNull() | F.lead(column).over(w).isNull()
    return rows.withColumn(out, F.when(edge, F.col(column)).otherwise(mixed))


def local_maxima(rows: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Inner rows no lower than either neighbour; a plateau counts whole."""
    w = Window.partitionBy(by).orderBy(*order)
    both = rows.withColumn("_b", F.lag(column).over(w)).withColumn("_a", F.lead(column).over(w))
    return both.where((F.col(column) >= F.col("_b")) & (F.col(column) >= F.col("_a"))).drop("_a", "_b")


def longest_runs(rows: DataFrame, by: str, order: list[str], condition: Column) -> DataFrame:
    """Length of the longest run of neighbouring rows for which `condition` holds, by key; 0 if for none."""
    w = Window.partitionBy(by).orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(w)).withColumn("_on", F.coalesce(condition, F.lit(False)))
    islands = numbered.where("_on").withColumn("_g", F.col("_i") - F.row_number().over(w)).groupBy(by, "_g").agg(F.count("*").alias("n"))
    best = islands.groupBy(by).agg(F.max("n").alias("longest"))
    return rows.select(by).distinct().join(best, by, "left").select(by, F.coalesce("longest", F.lit(0)).alias("longest"))


def bend_counts(rows: DataFrame, by: str, order: list[str], axes: list[str], least: float = 0.08) -> DataFrame:
    """Bends of a polyline by key: neighbouring segments at an angle over `least` radians."""
    w = Window.partitionBy(by).orderBy(*order)
    out = rows
    for c in axes:
        out = out.withColumn(f"_d{c}", F.lead(c).over(w) - F.col(c))
    for c in axes:
        out = out.withColumn(f"_e{c}", F.lag(f"_d{c}").over(w))
    product = sum((F.col(f"_d{c}") * F.col(f"_e{c}") for c in axes[1:]), F.col(f"_d{axes[0]}") * F.col(f"_e{axes[0]}"))
    size = lambda p: F.sqrt(sum((F.col(f"{p}{c}") * F.col(f"{p}{c}") for c in axes[1:]), F.col(f"{p}{axes[0]}") * F.col(f"{p}{axes[0]}")))
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / (size("_d") * size("_e")))))
    return out.groupBy(by).agg(F.count_if(turn > least).alias("bends"))
