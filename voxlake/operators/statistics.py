"""Distances between distributions, apportionment, quantiles, summaries and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.ordered import ecdf, ranked, running_total, running_totals


def ks_distance(rows: DataFrame, column: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance to a continuous distribution, over different values and their counts."""
    steps = ecdf(rows, column).withColumn("f", cdf(F.col("value")))
    high = F.abs(F.col("upto") / F.col("total") - F.col("f"))
    low = F.abs(F.col("f") - (F.col("upto") - F.col("n")) / F.col("total"))
    return steps.agg(F.max(F.greatest(high, low)).alias("ks"))


def ks_to_constant(rows: DataFrame, column: str, value: float, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """A constant target: 0 if every value is close to it, else 1."""
    far = F.abs(F.col(column) - value) > atol + rtol * abs(value)
    return rows.agg(F.when(F.count_if(far) == 0, 0.0).otherwise(1.0).alias("ks"))


def wasserstein(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """1-Wasserstein distance of two samples: the area between their step functions over the merged different values."""
    both = first.select(F.col(column).alias("value"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(second.select(F.col(column), F.lit(0), F.lit(1))).where("value is not null")
    counts = both.groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    upto = running_totals(counts, ["value"], {"ua": "a", "ub": "b"}, {"after": "value"}).crossJoin(F.broadcast(totals))  # one row
    gap = F.abs(F.col("ua") / F.col("na") - F.col("ub") / F.col("nb"))
    return upto.agg(F.coalesce(F.sum(gap * (F.col("after").cast("double") - F.col("value").cast("double"))), F.lit(0.0)).alias("distance"))


def quantiles(rows: DataFrame, column: str, at: list[float], by: str | None = None) -> DataFrame:
    """Exact quantiles, linear between neighbours, and the mean, as q<per cent> and mean.

    Values are counted and put in order over range partitions; of each group only the two values around a quantile are
    picked out, by partial aggregates. No task holds a group's values.
    """
    group = by or "_all"
    kept = rows.where(F.col(column).isNotNull())
    kept = kept if by else kept.withColumn("_all", F.lit(0))
    counts = kept.groupBy(group, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    placed = running_total(counts, [group, "value"], "n", "upto")
    facts = placed.groupBy(group).agg(F.min(F.col("upto") - F.col("n")).alias("_start"), F.sum("n").alias("_n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    both = placed.join(facts, group)
    first = F.col("upto") - F.col("n") - F.col("_start")  # places of this value in its group
    last = F.col("upto") - F.col("_start")
    picks = []
    for i, q in enumerate(at):
        exact = F.lit(float(q)) * (F.col("_n") - 1)
        for name, place in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            picks.append(F.max(F.when((first <= place) & (place < last), F.col("value"))).alias(f"_{name}{i}"))
    found = both.groupBy(group).agg(*picks, F.first("_n").alias("_n"), F.first("mean").alias("mean"))
    out = []
    for i, q in enumerate(at):
        exact = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (exact - F.floor(exact))).alias(f"q{round(q * 100)}"))
    return found.select(*([by] if by else []), *out, "mean")


def scale_of(rows: DataFrame, column: str, mode: str) -> DataFrame:
    """What a distance is divided by: the range of the target's values, or its 5 to 95 per cent range."""
    if mode == "range":
        return rows.agg((F.max(column) - F.min(column)).cast("double").alias("scale"))
    return quantiles(rows, column, [0.05, 0.95]).select((F.col("q95") - F.col("q5")).alias("scale"))


def largest_remainder(weights: DataFrame, key: str, weight: str, seats: int) -> DataFrame:
    """seats per key in proportion to its weight: the whole parts, then one each by remainder, the smaller key on a tie. weights: one row a key."""
    every = Window.partitionBy()  # a row a key, of a handful
    share = F.col(weight) * F.lit(float(seats)) / F.sum(weight).over(every)
    base = weights.withColumn("_base", F.floor(share)).withColumn("_rest", share - F.floor(share))
    rank = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    left = F.lit(seats) - F.sum("_base").over(every)
    return base.withColumn("seats", F.col("_base") + F.when(rank <= left, 1).otherwise(0)).select(key, F.col("seats").cast("bigint").alias("seats"))


def stratified_levels(rows: DataFrame, by: str, order: list[str], u: float = 0.5) -> DataFrame:
    """level (i + u) / n of each row within its stratum, i its place in order."""
    placed = ranked(rows.withColumn("_stratum", F.struct(by)), ["_stratum"], order)  # in a struct, null is a stratum too
    return placed.withColumn("level", (F.col("rank") + F.lit(u)) / F.col("n")).drop("_stratum", "rank", "n")


def nearest_prototype(rows: DataFrame, column: str, prototypes: list[float]) -> DataFrame:
    """`rows` with component, the place of the nearest prototype, the first on a tie."""
    ranked = F.array(*[F.struct(F.abs(F.col(column) - p).alias("d"), F.lit(i).alias("i")) for i, p in enumerate(prototypes)])
    return rows.withColumn("component", F.array_min(ranked)["i"])


def mixture_errors(assigned: DataFrame, weights: list[float]) -> DataFrame:
    """component, n and the error of its share against the weight it should have, for every component."""
    spark = assigned.sparkSession
    wanted = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "component int, weight double")
    counts = assigned.groupBy("component").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = wanted.join(counts, "component", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("component", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total") - F.col("weight")).alias("error"))


def summary_by_kind(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """count, mean, least and largest of `value` over the kind's mean."""
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.min(value) / F.avg(value)).alias("least_over_mean"), (F.max(value) / F.avg(value)).alias("most_over_mean"))


def panel_summary(rows: DataFrame, by: str, value: str, good: Column) -> DataFrame:
    """Runs, successes, failures, and mean and population variance of the successes' values."""
    kept = F.when(good, F.col(value))
    return rows.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.avg(kept).alias("mean"), F.var_pop(kept).alias("variance"))


def select_candidate(rows: DataFrame, passed: Column, value: str, target: float, sequence: str) -> DataFrame:
    """The first row that passed by sequence; if none did, the one nearest the target, then by sequence. A top-1, never a sort of all."""
    ok = F.coalesce(passed, F.lit(False))
    return rows.orderBy(F.desc(ok), F.when(ok, F.lit(0.0)).otherwise(F.abs(F.col(value) - target)), sequence).limit(1)


def gates(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """passed: every gate's value is there and within its limit; failed: the names of those that aren't. rows: name, value, limit."""
    ok = F.coalesce(F.abs(F.col("value")) <= F.col("limit"), F.lit(False))
    aggs = (F.bool_and(ok).alias("passed"), F.sort_array(F.collect_list(F.when(~ok, F.col("name")))).alias("failed"))
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def porosity_tolerance(voxels: int) -> float:
    return max(1.0 / voxels, 0.01)


def solver_tolerance(voxels: int) -> float:
    return max(max(1.0 / voxels, 1e-4), 0.01)


def seed_count(density: float, volume: float) -> int:
    """Half to even."""
    return round(density * volume)


def molecule_count(density_g_cm3: float, volume_A3: float, mass_g_mol: float) -> int:
    """Half up."""
    import math

    return math.floor(density_g_cm3 * volume_A3 * 1e-24 * 6.02214076e23 / mass_g_mol + 0.5)
