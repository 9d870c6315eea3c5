"""Measured samples against their targets: one row per quantity, and whether all pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import distributions as D
from voxlake.functions import fields

#: Fixed values of a candidate's audit: largest KS and normalised distance, mean square error of the pair curve, relative error of a constant, error of a mixture's share.
KS_LIMIT, DISTANCE_LIMIT, PAIR_LIMIT, CONSTANT_ERROR, SHARE_ERROR = 0.2, 0.2, 1.0, 0.05, 0.05


def audit_quantities(samples: DataFrame, targets: dict[str, dict], ks_limit: float, distance_limit: float, reading: str = "generator") -> DataFrame:
    """quantity, n, ks, distance, passed, warning for each target; samples: quantity, value.

    Samples of one quantity of one run are what one task compares. A target without samples: the generator's reading
    fails it and warns; so does the validator's, which passes quantities that have no target.
    """
    specs = targets

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        name = key[0]
        got = D.compared(frame["value"].to_numpy(float), specs[name], ks_limit, distance_limit, reading)
        return pd.DataFrame([{"quantity": name, "n": int(frame["value"].notna().sum()), "ks": got["ks"], "distance": got["distance"], "passed": got["passed"]}])

    wanted = samples.where(F.col("quantity").isin(list(specs)))
    found = wanted.groupBy("quantity").applyInPandas(run, "quantity string, n bigint, ks double, distance double, passed boolean")
    names = samples.sparkSession.createDataFrame([(n,) for n in specs], "quantity string")
    out = names.join(found, "quantity", "left")
    return out.select("quantity", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ks", F.lit(float("inf"))).alias("ks"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"), F.coalesce("passed", F.lit(False)).alias("passed"), F.when(F.coalesce("n", F.lit(0)) == 0, F.concat(F.lit("no formal samples for "), "quantity")).alias("warning"))


def rollup(quantities: DataFrame, porosity: float, target: float, voxels: int) -> DataFrame:
    """One row: passed, porosity error, and the warnings."""
    from voxlake.operators.statistics import porosity_tolerance

    near = abs(porosity - target) <= porosity_tolerance(voxels)
    warnings = F.array_compact(F.sort_array(F.collect_list(F.coalesce("warning", F.when(~F.col("passed"), F.concat(F.lit("distribution mismatch: "), "quantity"))))))
    return quantities.agg(F.bool_and("passed").alias("all"), warnings.alias("warnings")).select((F.col("all") & F.lit(near)).alias("passed"), F.lit(porosity - target).alias("porosity_error"), "warnings")


def judged(samples: dict[str, np.ndarray], targets: dict[str, dict]) -> list[str]:
    """What misses its target: no samples, a distribution too far off, or a mixture's component with too small or large a share.

    A constant is met by values within CONSTANT_ERROR of it, any other target within KS_LIMIT and DISTANCE_LIMIT.
    """
    out = []
    for name, spec in targets.items():
        x = np.asarray(samples.get(name, ()), float)
        x = x[np.isfinite(x)]
        if not len(x):
            out.append(f"no formal samples for {name}")
            continue
        if spec.get("family") == "constant":
            value = float(spec["value"])
            passed = bool((np.abs(x - value) <= CONSTANT_ERROR * max(abs(value), 1e-12)).all())
        else:
            passed = D.compared(x, spec, KS_LIMIT, DISTANCE_LIMIT)["passed"]
        if not passed:
            out.append(f"distribution mismatch: {name}")
        if spec.get("family") == "mixture":
            middle = np.array([np.median(D.target_values(c, 129)) for c in spec["components"]])
            got = np.bincount(np.abs(x[:, None] - middle).argmin(axis=1), minlength=len(middle))
            off = np.abs(got - D.apportioned([float(c["weight"]) for c in spec["components"]], len(x))) / len(x)
            if (off > SHARE_ERROR + 0.5 / len(x)).any():
                out.append(f"mixture weights exceed audit tolerance: {name}")
    return out


def unit_samples(units: list[fields.Unit]) -> dict[str, np.ndarray]:
    """What units are, from their own geometry: diameter (of the sphere of a compact one's volume), eta by kind, tau, roughness, angles of their axes in degrees; spheres have no axis."""
    out: dict[str, list[float]] = {n: [] for n in ("diameter", "compact_eta", "channel_eta", "tau", "roughness", "theta_xz", "theta_xy")}
    for u in units:
        out["roughness"].append(u.rough)
        if isinstance(u, fields.Compact):
            out["diameter"].append(2 * float(np.prod(u.radii)) ** (1 / 3))
            out["compact_eta"].append(float(u.radii[2] / u.radii[0]))
            axis = u.rotation[:, 2] if np.ptp(u.radii) > 1e-6 * np.min(u.radii) else None
        else:
            axis = u.points[-1] - u.points[0]
            diameter, chord = 2 * float(u.radius.mean()), float(np.linalg.norm(axis))
            out["diameter"].append(diameter)
            out["channel_eta"].append(float(u.arc[-1]) / diameter)
            out["tau"].append(float(u.arc[-1]) / chord if chord > 0 else np.inf)
        if axis is not None:
            x, y, z = np.abs(axis)
            out["theta_xz"].append(float(np.degrees(np.arctan2(z, x))))
            out["theta_xy"].append(float(np.degrees(np.arctan2(y, x))))
    return {n: np.array(v) for n, v in out.items()}


def unit_targets(config: dict) -> dict[str, dict]:
    """The distributions that a candidate's configuration asks of its units; lengths are as they are in the film, the solved scale included."""
    out = {"diameter": config["diameter"]} if config.get("sized", True) else {}
    share = float(config.get("channel_fraction", 0.0))
    compact, channel = D.apportioned([1 - share, share], int(config["count"])) if 0 < share < 1 else (int(share < 1), int(share >= 1))
    if config.get("eta"):
        out |= ({"compact_eta": config["eta"]} if compact else {}) | ({"channel_eta": config["eta"]} if channel else {})
    if config.get("roughness") is not None:
        out["roughness"] = {"family": "constant", "value": float(config["roughness"])}
    return out | {n: config[n] for n in ("tau", "theta_xz", "theta_xy") if config.get(n)}


def unit_warnings(config: dict, units: list[fields.Unit], porosity: float, voxels: int, pair_loss: float | None) -> list[str]:
    """What a candidate's units and phase miss of its configuration: distributions, numbers, proportions, distances and porosity."""
    from voxlake.operators.statistics import porosity_tolerance

    n = int(config["count"])
    out = judged(unit_samples(units), unit_targets(config))
    if len(units) != n:
        out.append(f"{len(units)} units instead of {n}")
    share = sum(isinstance(u, fields.Channel) for u in units) / max(1, len(units))
    if abs(share - float(config.get("channel_fraction", 0.0))) > 0.5 / max(n, 1) + 1e-12:
        out.append("channel fraction exceeds audit tolerance")
    if pair_loss is not None and not pair_loss <= PAIR_LIMIT:
        out.append("pair distances exceed audit limit")
    if abs(porosity - float(config["porosity"])) > porosity_tolerance(voxels):
        out.append("porosity exceeds audit tolerance")
    return out


def measured_warnings(m: dict[str, DataFrame], targets: dict[str, dict]) -> DataFrame:
    """run_id, missed: what the through tracks of each run of a measurement (measure_slabs) miss of the targets, by name equivalent_diameter, curvature_fluctuation, channel_eta, channel_tau, theta_xz and theta_xy."""
    found = []
    for rows, columns in ((m["sections"].where("valid"), {"equivalent_diameter": "diameter", "curvature_fluctuation": "fluctuation"}), (m["channels"].where("valid"), {"channel_eta": "eta", "channel_tau": "tau"}), (m["orientations"], {"theta_xz": "theta_xz", "theta_xy": "theta_xy"})):
        kept = rows.join(m["through"], ["run_id", "track_id"], "left_semi")
        found += [kept.select("run_id", F.lit(n).alias("quantity"), F.col(c).cast("double").alias("value")) for n, c in columns.items() if n in targets]
    samples = m["slabs"].select("run_id").distinct().select("run_id", F.lit("").alias("quantity"), F.lit(None).cast("double").alias("value"))  # runs without tracks too
    for part in found:
        samples = samples.union(part)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mine = {n: g.to_numpy(float) for n, g in frame.groupby("quantity")["value"]}
        return pd.DataFrame({"run_id": [frame["run_id"].iloc[0]], "missed": [judged(mine, targets)]})

    return samples.groupBy("run_id").applyInPandas(run, f"run_id {dict(samples.dtypes)['run_id']}, missed array<string>")
