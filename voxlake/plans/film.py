"""Whole films: candidates made, voxelised, measured and audited, run by run."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.plans import generate, measure
from voxlake.plans.catalog import query
from voxlake.tables import table, written

#: A film of 30000 x 30000 x 6000 angstrom at 500 angstrom: 43 units, a third of them channels.
FILM = {
    "box": [30000.0, 30000.0, 6000.0],
    "spacing": 500.0,
    "count": 43,
    "porosity": 0.28,
    "lattice": "simple_cubic",
    "jitter": 0.3,
    "channel_fraction": 0.3,
    "diameter": {"family": "beta", "alpha": 2.5, "beta": 3.0, "lower": 1600.0, "upper": 4700.0},
    "eta": {"family": "beta", "alpha": 2.2, "beta": 2.8, "lower": 2.0, "upper": 4.0},
}
CONTRACT = {
    "z_slice_spacing_A": 500.0, "center_min_separation_A": 800.0, "center_tracking_max_displacement_A": 1400.0, "surface_exclusion_length_A": 500.0, "branch_exclusion_length_A": 600.0,
    "cross_section_spacing_A": 500.0, "boundary_resample_spacing_A": 250.0, "curvature_smoothing_length_A": 500.0, "orientation_projection_min_fraction": 0.05,
}
TARGETS = {"diameter": FILM["diameter"], "tau": {"family": "beta", "alpha": 2.0, "beta": 3.0, "lower": 1.05, "upper": 1.24}}


def candidate_slabs(tasks: DataFrame, config: dict) -> DataFrame:
    """slab(run_id, z, mask) of every candidate (sequence_index, seed) that can be made; one task each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            _, mask = generate.evaluate(config, int(frame["seed"].iloc[0]))
        except ValueError:  # generate.evaluated() says why
            return pd.DataFrame({"run_id": [], "z": [], "mask": []})
        return pd.DataFrame({"run_id": int(frame["sequence_index"].iloc[0]), "z": np.arange(len(mask)), "mask": [np.packbits(m).tobytes() for m in mask]})

    return tasks.groupBy("sequence_index").applyInPandas(run, "run_id int, z int, mask binary")


def films(tasks: DataFrame, config: dict = FILM, contract: dict = CONTRACT, targets: dict = TARGETS) -> DataFrame:
    """A row a candidate: porosity, tracks, through tracks, valid sections, and whether its samples meet their targets."""
    shape = tuple(round(b / config["spacing"]) for b in config["box"])
    m = measure.measure_slabs(candidate_slabs(tasks, config), shape, config["spacing"], contract)
    valid = m["sections"].where("valid").groupBy("run_id").agg(F.count("*").alias("valid_sections"))
    tracks = m["points"].groupBy("run_id").agg(F.count_distinct("track_id").alias("tracks"))
    through = m["through"].groupBy("run_id").agg(F.count("*").alias("through_tracks"))
    formal = m["channels"].join(m["through"], ["run_id", "track_id"], "left_semi").where("valid")
    samples = written(formal.select("run_id", F.explode(F.create_map(F.lit("diameter"), F.col("diameter"), F.lit("tau"), F.col("tau"))).alias("quantity", "value")), "samples")

    def judged(frame: pd.DataFrame) -> pd.DataFrame:
        from voxlake.functions import distributions as D

        found = [D.compared(frame.loc[frame["quantity"] == q, "value"].to_numpy(float), spec, 0.2, 0.2) for q, spec in targets.items()]
        return pd.DataFrame({"run_id": [int(frame["run_id"].iloc[0])], "targets_met": [all(f["passed"] for f in found)]})

    met = samples.groupBy("run_id").applyInPandas(judged, "run_id int, targets_met boolean")
    out = m["porosity"]
    for part in (tracks, through, valid, met):
        out = out.join(part, "run_id", "left")
    return out.select("run_id", "porosity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tracks", "through_tracks", "valid_sections")], F.coalesce("targets_met", F.lit(False)).alias("targets_met"))


@query("film_panel")
def film_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A film per region, seeded by its key."""
    seeds = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("sequence_index"), (F.col("r_regionkey").cast("bigint") + 21001).alias("seed"))
    return films(seeds).withColumn("porosity", F.round("porosity", 6))

