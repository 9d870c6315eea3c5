"""Tracks resampled at even spacing, with samples near disturbing events set apart, and gates a track and day must pass.

    python -m jobs.track_resampling --input events.parquet --output resampled/ --mark mark/ [--config config.json]

What is measured along a track comes at uneven places; statistics need even ones, linear between the points around
them, and only those off the neighbourhood of branches or errors count as formal. The job writes, by day with dynamic
overwrite, output/samples (every sample and whether it is formal) and output/report (a row a track and day: counts, mean,
ends, largest step between formal samples, and the gates that failed). A rerun writes the same days with the same rows.

Points are interpolated in blocks of a track (see operators.ordered.interpolated_in_blocks), and an event excludes
samples by the places it makes itself, so that neither needs a task that holds a track. Rows without a track, time
or value are left out. An empty table gives empty results.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line
from voxlake.operators.ordered import interpolated_in_blocks
from voxlake.operators.statistics import gates
from voxlake.tables import exists

log = logging.getLogger("jobs.track_resampling")

SAMPLES = "day date, track bigint, place bigint, value double, formal boolean"
REPORT = "day date, track bigint, samples bigint, n_formal bigint, mean double, low double, high double, largest_step double, passed boolean, failed array<string>"


def points(events: DataFrame, config: dict) -> DataFrame:
    """track, seq, at (seconds since 1970), value and kind of the rows that can be placed."""
    at = F.unix_micros(F.col(config["time"]).cast("timestamp")) / 1000000.0
    got = events.select(F.col(config["track"]).cast("bigint").alias("track"), F.col(config["order"]).alias("seq"), at.alias("at"), F.col(config["value"]).cast("double").alias("value"), F.col(config["kind"]).alias("kind"))
    return got.where("track is not null and at is not null and value is not null and not isnan(value)")


def samples(events: DataFrame, config: dict) -> DataFrame:
    """day, track, place (in spacings since 1970), value and formal of every sample."""
    spacing, reach = float(config["spacing_s"]), float(config["reach_s"])
    rows = points(events, config)
    even = interpolated_in_blocks(rows, "track", ["at", "seq"], "at", "value", spacing, float(config["block_s"]))
    first, last = F.ceil((F.col("at") - reach) / spacing).cast("bigint"), F.floor((F.col("at") + reach) / spacing).cast("bigint")
    near = rows.where(F.col("kind") == config["excluding"]).select("track", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("place")).distinct()
    out = even.join(near.withColumn("_near", F.lit(True)), ["track", "place"], "left")
    day = F.to_date(F.timestamp_seconds(F.col("place") * F.lit(spacing)))
    return out.select(day.alias("day"), "track", "place", "value", F.col("_near").isNull().alias("formal"))


def report(rows: DataFrame, config: dict) -> DataFrame:
    """A row a track and day, with the gates it failed: too few formal samples, or too large a step between them."""
    w = Window.partitionBy("day", "track").orderBy("place")  # as many rows as a day has samples
    formal = F.when(F.col("formal"), F.col("value"))
    stepped = rows.withColumn("_f", formal).withColumn("_step", F.abs(F.col("_f") - F.last("_f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    found = stepped.groupBy("day", "track").agg(
        F.count("*").alias("samples"), F.count("_f").alias("n_formal"), F.round(F.avg("_f"), 6).alias("mean"), F.min("_f").alias("low"), F.max("_f").alias("high"), F.coalesce(F.max("_step"), F.lit(0.0)).alias("largest_step")
    )
    shortfall = F.greatest(F.lit(float(config["least_formal"])) - F.col("n_formal") / F.col("samples"), F.lit(0.0))
    limits = F.array(F.struct(F.lit("formal_samples").alias("name"), shortfall.alias("value"), F.lit(0.0).alias("limit")), F.struct(F.lit("largest_step").alias("name"), F.col("largest_step").alias("value"), F.lit(float(config["largest_step"])).alias("limit")))
    judged = gates(found.select("day", "track", F.inline(limits)), ["day", "track"])
    return found.join(judged, ["day", "track"])


def run(spark: SparkSession, source: str, output: str, mark: str, config: dict) -> dict:
    """Writes samples and report of the table at `source`; `mark` isn't needed, as every run takes the whole table."""
    base = output.rstrip("/")
    events = spark.read.parquet(source)
    samples(events, config).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{base}/samples")
    made = _read(spark, f"{base}/samples", SAMPLES)
    report(made, config).hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{base}/report")
    wrote = {"events": events.count(), "samples": made.count(), "tracks_and_days": _read(spark, f"{base}/report", REPORT).count()}
    log.info("read %d events of %s; wrote %d samples and %d rows of report to %s", wrote["events"], source, wrote["samples"], wrote["tracks_and_days"], output)
    return wrote


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: every sample with the report of its track and day."""
    base = output.rstrip("/")
    rows = _read(spark, f"{base}/samples", SAMPLES).join(_read(spark, f"{base}/report", REPORT), ["day", "track"], "left")
    return rows.select("day", "track", "place", F.round("value", 6).alias("value"), "formal", "samples", "n_formal", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("largest_step", 6).alias("largest_step"), "passed", "failed")


SQL = """
with e as (select user_id track, event_id seq, event_type kind, value, epoch_us(ts) / 1000000.0::double t from events where user_id is not null and ts is not null and value is not null and not isnan(value)),
w as (select *, lead(t) over q t1, lead(value) over q v1 from e window q as (partition by track order by t, seq)),
g as (select *, unnest(generate_series(ceil(t / 21600.0::double)::bigint, (case when t1 is null then floor(t / 21600.0::double) else ceil(t1 / 21600.0::double) - 1 end)::bigint)) place from w),
n as (select distinct track, unnest(generate_series(ceil((t - 3600) / 21600.0::double)::bigint, floor((t + 3600) / 21600.0::double)::bigint)) place from e where kind = 'error'),
s as (select (make_timestamp(place * 21600000000))::date as day, g.track, g.place, case when t1 is null then value else value + (v1 - value) * (place * 21600.0::double - t) / (t1 - t) end v, n.place is null formal
      from g left join n using (track, place)),
f as (select *, case when formal then v end fv from s),
d as (select *, abs(fv - last_value(fv ignore nulls) over (partition by day, track order by place rows between unbounded preceding and 1 preceding)) step from f),
r as (select day, track, count(*) samples, count(fv) n_formal, round(avg(fv), 6) mean, min(fv) low, max(fv) high, coalesce(max(step), 0) largest_step from d group by all),
j as (select *, list_filter([case when n_formal / samples < 0.5 then 'formal_samples' end, case when largest_step > 60 then 'largest_step' end], lambda x: x is not null) failed from r)
select day, track, place, round(v, 6) as value, formal, samples, n_formal, mean, round(low, 6) low, round(high, 6) high, round(largest_step, 6) largest_step, len(failed) = 0 passed, failed from s join j using (day, track)
"""

if __name__ == "__main__":
    command_line("track_resampling", run)
