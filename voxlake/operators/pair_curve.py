"""Pair distance curves of runs over what evenly spread points would give, and their losses against a wanted curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions.geometry import minimum_image
from voxlake.functions.kernels import SOBOL_BITS, sobol_directions
from voxlake.operators.pairs import histogram, pair_histogram

#: Most and fewest pairs of even points; their numbers in between are powers of two.
MOST_PAIRS, FEWEST_PAIRS = 1 << 16, 1 << 4


def sobol(index: Column, dims: int, bits: int = MOST_PAIRS.bit_length() - 1) -> list[Column]:
    """The point of each index (below 2**bits) of the unscrambled Sobol sequence: direction numbers combined where the index's Gray code has a bit."""
    gray = index.bitwiseXOR(F.shiftright(index, 1))
    out = []
    for d in range(dims):
        steps = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("bit"), F.lit(v).cast("bigint").alias("by")) for i, v in enumerate(sobol_directions(d)[:bits])])
        value = F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, s: acc.bitwiseXOR(F.when(gray.bitwiseAND(s["bit"]) != 0, s["by"]).otherwise(F.lit(0).cast("bigint"))))
        out.append(value / F.lit(float(1 << SOBOL_BITS)))
    return out


def even_pairs(spark: SparkSession, box: tuple[float, float, float], width: float, bins: int) -> DataFrame:
    """(level, bin, c): distances of MOST_PAIRS pairs of even points in a box that is periodic in x and y, counted by bin and by the least power of two of pairs that holds them."""
    index = F.col("id")
    points = spark.range(MOST_PAIRS).select("id", *[(p * F.lit(float(side))).alias(n) for p, n, side in zip(sobol(index, 6), ("ax", "ay", "az", "bx", "by", "bz"), (*box, *box), strict=True)])
    dx, dy = (minimum_image(F.col(f"a{c}") - F.col(f"b{c}"), float(side)) for c, side in zip("xy", box, strict=False))
    dz = F.col("az") - F.col("bz")
    level = F.greatest(F.lit(FEWEST_PAIRS).cast("bigint"), F.expr("shiftleft(1L, length(bin(id)))"))  # the first power of two above the index
    return histogram(points.select(level.alias("level"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("d")), "d", width, bins, ["level"]).withColumnRenamed("n", "c")


def reference(sizes: DataFrame, box: tuple[float, float, float], width: float, bins: int) -> DataFrame:
    """run_id, bin and reference: the pairs that as many evenly spread points (run_id, n) would have; n * (n - 1) / 2 pairs, from the largest power of two of even ones that is no larger."""
    spark = sizes.sparkSession
    pairs = F.col("n").cast("double") * (F.col("n") - 1) / 2
    take = F.least(F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(pairs, F.lit(1.0)) + 0.5))), F.lit(float(FEWEST_PAIRS))), F.lit(float(MOST_PAIRS))).cast("bigint")
    even = even_pairs(spark, box, width, bins)
    levels = spark.createDataFrame([(1 << k,) for k in range(FEWEST_PAIRS.bit_length() - 1, MOST_PAIRS.bit_length())], "take bigint")
    upto = levels.join(F.broadcast(even), F.col("level") <= F.col("take")).groupBy("take", "bin").agg(F.sum("c").alias("c"))  # levels times bins rows
    every = levels.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(upto, ["take", "bin"], "left")
    return sizes.withColumn("take", take).withColumn("pairs", pairs).join(F.broadcast(every), "take").select("run_id", "bin", (F.coalesce("c", F.lit(0)) * F.col("pairs") / F.col("take")).alias("reference"))


def pair_curve(points: DataFrame, box: tuple[float, float, float], width: float, bins: int) -> DataFrame:
    """run_id, bin, n, reference and g of points(run_id, id, x, y, z): pair counts over the reference, over the mean of that over the bins that have one.

    Distances are periodic in x and y and plain in z; pairs are counted in arrays, see pair_histogram. Runs of one point have no
    pairs and a g of 0.
    """
    counts = pair_histogram(points.select("id", "x", "y", "z", "run_id"), width, bins, (box[0], box[1]), "run_id")
    sizes = points.groupBy("run_id").agg(F.count("*").alias("n"))
    both = reference(sizes, box, width, bins).join(counts, ["run_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ratio = F.when(F.col("reference") > 0, F.col("n") / F.col("reference"))
    mean = F.avg("_ratio").over(Window.partitionBy("run_id"))  # a row a bin
    g = F.when(mean > 0, F.coalesce("_ratio", F.lit(0.0)) / mean).otherwise(F.coalesce("_ratio", F.lit(0.0)))
    return both.withColumn("_ratio", ratio).select("run_id", "bin", "n", "reference", g.alias("g"))


def bare_curve(curve: DataFrame) -> DataFrame:
    """The curve without a reference: counts over the mean of the counts that aren't 0."""
    mean = F.avg(F.when(F.col("n") > 0, F.col("n"))).over(Window.partitionBy("run_id"))  # a row a bin
    return curve.select("run_id", "bin", "n", F.when(mean > 0, F.col("n") / mean).otherwise(0.0).alias("g"))


def losses(curve: DataFrame, target: str = "target") -> DataFrame:
    """run_id, loss and peaks: the mean square error weighted by the target (at least 1e-12), infinite for runs without pairs, and the bins no lower than either neighbour, by bin."""
    w = Window.partitionBy("run_id").orderBy("bin")  # a row a bin
    weight = F.greatest(F.col(target), F.lit(1e-12))
    off = F.col("g") - F.col(target)
    peak = (F.col("g") > 0) & (F.col("g") >= F.coalesce(F.lag("g").over(w), F.lit(0.0))) & (F.col("g") >= F.coalesce(F.lead("g").over(w), F.lit(0.0)))
    held = curve.withColumn("_peak", F.when(peak, F.col("bin")))
    loss = F.when(F.sum("n") > 0, F.sum(weight * off * off) / F.sum(weight)).otherwise(F.lit(float("inf")))
    return held.groupBy("run_id").agg(loss.alias("loss"), F.sort_array(F.collect_list("_peak")).alias("peaks"))
