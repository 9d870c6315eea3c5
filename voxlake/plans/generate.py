"""Candidates and seeds: tables of what to try, one task per candidate, failures as rows, the choice as a query.

Random streams are numpy's, drawn on the driver for the identities and inside a candidate's own task for the rest, so
that a candidate gives the same rows wherever it runs.
"""

from __future__ import annotations

import math
import traceback

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import distributions as D
from voxlake.functions import fields, kernels
from voxlake.operators.statistics import select_candidate
from voxlake.plans import audit, measure
from voxlake.tables import written

#: Points of the crystal cells.
LATTICES = {"simple_cubic": [(0, 0, 0)], "bcc": [(0, 0, 0), (0.5, 0.5, 0.5)], "fcc": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]}


def candidates(spark: SparkSession, seed: int, rounds: int, each: int) -> DataFrame:
    """sequence_index, round_index, candidate_index and seed of every candidate, the seeds drawn one after another from one stream."""
    rng = np.random.default_rng(seed)
    rows = [(r * each + c, r, c, int(rng.integers(0, 2**63 - 1))) for r in range(rounds) for c in range(each)]
    return spark.createDataFrame(rows, "sequence_index int, round_index int, candidate_index int, seed bigint")


def seed_panel(spark: SparkSession, seeds: list[int], each: int) -> DataFrame:
    """Candidates of every seed of a panel, with panel_index."""
    panel = [(p, s) for p, s in enumerate(seeds)]
    out = None
    for p, s in panel:
        part = candidates(spark, s, 1, each).withColumn("panel_index", F.lit(p)).withColumn("panel_seed", F.lit(s))
        out = part if out is None else out.union(part)
    return out


def lattice_centers(n: int, box: tuple[float, float, float], lattice: str, jitter: float, rng: np.random.Generator) -> np.ndarray:
    """The first n points of a crystal stretched over the box, each moved within a share of its cell; x and y wrap, z is clipped."""
    basis = np.array(LATTICES[lattice])
    side = math.ceil((n / len(basis)) ** (1 / 3) - 1e-9)
    cell = np.array(box) / side
    corners = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 1, 3)
    points = ((corners + basis[None] + 0.5 / len(basis)) * cell).reshape(-1, 3)[:n]
    points = points + rng.uniform(-0.5, 0.5, points.shape) * jitter * cell
    points[:, :2] %= np.array(box)[:2]
    points[:, 2] = np.clip(points[:, 2], 0, box[2])
    return points


def pair_curve(points: np.ndarray, box: tuple[float, float, float], edges: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Pair counts by distance over the reference, over the mean of that."""
    i, j = np.triu_indices(len(points), 1)
    d = points[i] - points[j]
    d[:, :2] -= np.array(box)[:2] * np.rint(d[:, :2] / np.array(box)[:2])
    count, _ = np.histogram(np.sqrt((d**2).sum(axis=1)), edges)
    g = np.where(reference > 0, count / np.maximum(reference, 1e-300), 0)
    mean = g[reference > 0].mean() if (reference > 0).any() else 0
    return g / mean if mean > 0 else g


def uniform_reference(n: int, box: tuple[float, float, float], edges: np.ndarray, most: int = 65536) -> np.ndarray:
    """Pair counts an even spread would give: Sobol pairs, at most `most`, scaled to n * (n - 1) / 2."""
    take = 1 << max(4, min(most, max(1, n * (n - 1) // 2)).bit_length() - 1)
    u = kernels.sobol(take, 6) * np.array([*box, *box])
    d = u[:, :3] - u[:, 3:]
    d[:, :2] -= np.array(box)[:2] * np.rint(d[:, :2] / np.array(box)[:2])
    count, _ = np.histogram(np.sqrt((d**2).sum(axis=1)), edges)
    return count * (n * (n - 1) / 2) / take


def annealed_centers(points: np.ndarray, box: tuple[float, float, float], edges: np.ndarray, target: np.ndarray, rng: np.random.Generator, steps_each: int = 24, hot: float = 0.05, cold: float = 1e-4) -> np.ndarray:
    """Moves single points so that the pair curve comes nearer the target; worse moves pass by chance, less and less."""
    reference = uniform_reference(len(points), box, edges)
    weight = np.maximum(target, 1e-12)
    loss = lambda p: float(np.average((pair_curve(p, box, edges, reference) - target) ** 2, weights=weight))
    now, best = loss(points), points
    current, least = points.copy(), now
    total = steps_each * len(points)
    for k in range(total):
        heat = hot + (cold - hot) * k / max(1, total - 1)
        trial = current.copy()
        i = rng.integers(len(points))
        trial[i] += rng.normal(0, 0.1, 3) * np.array(box)
        trial[i, :2] %= np.array(box)[:2]
        trial[i, 2] = np.clip(trial[i, 2], 0, box[2])
        new = loss(trial)
        if new < now or rng.random() < math.exp(-(new - now) / heat):
            current, now = trial, new
            if now < least:
                best, least = current.copy(), now
    return best


def pair_loss(config: dict, centers: np.ndarray) -> float | None:
    """Mean square error of the centres' pair curve, weighted by the curve asked for; None if none is."""
    if not config.get("pair_target"):
        return None
    edges, target = (np.array(config["pair_target"][n], float) for n in ("edges", "values"))
    curve = pair_curve(centers, tuple(config["box"]), edges, uniform_reference(len(centers), tuple(config["box"]), edges))
    return float(np.average((curve - target) ** 2, weights=np.maximum(target, 1e-12)))


def units_at(centers: np.ndarray, config: dict, rng: np.random.Generator) -> list[fields.Unit]:
    """Units of apportioned kinds in random order, sizes and shapes from the targets' shares."""
    n = len(centers)
    share = float(config.get("channel_fraction", 0.0))
    compact, channel = D.apportioned([1 - share, share], n) if 0 < share < 1 else ((0, n) if share >= 1 else (n, 0))
    kinds = rng.permutation(["compact"] * compact + ["channel"] * channel)
    diameters = D.stratified_sample(config["diameter"], n, rng)
    etas = np.maximum(D.stratified_sample(config.get("eta", {"family": "constant", "value": 1.0}), n, rng), 1.0)
    out: list[fields.Unit] = []
    for i, (kind, at) in enumerate(zip(kinds, centers, strict=True)):
        r = float(diameters[i]) / 2
        if kind == "compact":
            stretch = float(etas[i]) ** (1 / 3)
            out.append(fields.Compact(f"unit-{i:05d}", at, np.array([r / stretch, r / stretch, r * stretch**2]), rotation=_rotation(rng), rough=float(config.get("roughness", 0.0))))
        else:
            axis = _rotation(rng)[:, 0]
            s = np.linspace(-0.5, 0.5, 9)
            bend = np.cross(axis, [0, 0, 1.0] if abs(axis[2]) < 0.85 else [1.0, 0, 0])
            line = at + (s[:, None] * axis + 0.15 * np.cos(2 * np.pi * s)[:, None] * bend) * (2 * r * float(etas[i]))
            out.append(fields.Channel(f"unit-{i:05d}", line, np.full(len(s), r), float(config.get("roughness", 0.0))))
    return out


def _rotation(rng: np.random.Generator) -> np.ndarray:
    q, r = np.linalg.qr(rng.normal(size=(3, 3)))
    q = q * np.sign(np.diag(r))
    return q if np.linalg.det(q) > 0 else q[:, [1, 0, 2]]


def voxelised(units: list[fields.Unit], box: tuple[float, float, float], spacing: float, batch: int = 1 << 16) -> np.ndarray:
    """mask[z, y, x] of where the field is negative, in batches; what a batch holds doesn't matter.

    A unit meets only the points in its own bounds: outside them its field is positive, and two units' blend doesn't
    reach that far.
    """
    nx, ny, nz = (round(b / spacing) for b in box)
    margin = 8 / fields.SHARPNESS
    shifted = [(u, shift, *u.bounds()) for u in units for shift in fields.images(u, box)]
    out = np.zeros(nx * ny * nz, bool)
    for i in range(0, len(out), batch):
        k = np.arange(i, min(i + batch, len(out)))
        at = (np.stack([k % nx, k // nx % ny, k // (nx * ny)], axis=1) + 0.5) * spacing
        least, total = np.full(len(k), np.inf), np.zeros(len(k))
        for u, shift, low, high in shifted:
            near = np.flatnonzero(((at >= low + shift - margin) & (at <= high + shift + margin)).all(axis=1))
            if len(near):
                f = u.field(at[near] - shift)
                new = np.minimum(least[near], f)
                with np.errstate(invalid="ignore", over="ignore"):
                    kept = np.where(np.isfinite(least[near]), total[near] * np.exp(-fields.SHARPNESS * (least[near] - new)), 0)
                    total[near] = kept + np.where(np.isfinite(f), np.exp(-fields.SHARPNESS * (f - new)), 0)
                least[near] = new
        met = total > 0
        out[k[met]] = least[met] - np.log(total[met]) / fields.SHARPNESS < 0
    return out.reshape(nz, ny, nx)


def evaluate(config: dict, seed: int) -> tuple[list[fields.Unit], np.ndarray]:
    """A candidate's units and phase."""
    return solved(config, seed)[:2]


def solved(config: dict, seed: int) -> tuple[list[fields.Unit], np.ndarray, float, np.ndarray]:
    """A candidate's units and phase, the scale that gives the porosity asked for, and the units' centres."""
    rng = np.random.default_rng(seed)
    box = tuple(config["box"])
    centers = lattice_centers(int(config["count"]), box, config.get("lattice", "simple_cubic"), float(config.get("jitter", 0.2)), rng)
    if config.get("pair_target"):
        edges = np.array(config["pair_target"]["edges"], float)
        centers = annealed_centers(centers, box, edges, np.array(config["pair_target"]["values"], float), rng)
    state = rng.bit_generator.state
    low, high = 0.1, 10.0
    for _ in range(64):
        scale = math.sqrt(low * high)
        rng.bit_generator.state = state
        scaled = units_at(centers, config | {"diameter": _scaled(config["diameter"], scale)}, rng)
        mask = voxelised(scaled, box, float(config["spacing"]))
        off = mask.mean() - float(config["porosity"])
        if abs(off) <= max(1 / mask.size, 0.01):
            return scaled, mask, scale, centers
        low, high = (scale, high) if off < 0 else (low, scale)
    raise ValueError(f"no scale gives a porosity of {config['porosity']}")


def _scaled(spec: dict, scale: float) -> dict:
    lengths = {"value", "scale", "loc", "low", "high", "lower", "upper", "minimum", "maximum", "mean", "sigma"} if spec["family"] != "lognormal" else {"scale", "loc"}
    return {k: v * scale if k in lengths and isinstance(v, (int, float)) else v for k, v in spec.items()}


def evaluated(tasks: DataFrame, config: dict) -> DataFrame:
    """tasks with solved scale, porosity, components of the pores and the audit of each candidate; one that fails is a row that says so.

    audit_passed: nothing of the configuration is missed, see audit.unit_warnings; warnings say what is. With targets
    under "measured" (and a measuring "contract") the phases are measured too and held against these.
    """
    wanted = config.get("measured")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        base = {"sequence_index": int(row["sequence_index"]), "seed": int(row["seed"])}
        try:
            units, mask, scale, centers = solved(config, int(row["seed"]))
            warnings = audit.unit_warnings(config, units, float(mask.mean()), mask.size, pair_loss(config, centers))
            done = {"succeeded": True, "porosity": float(mask.mean()), "units": len(units), "failure_type": None, "failure_message": None, "scale": scale, "components": kernels.pore_components(mask), "warnings": warnings, "masks": [np.packbits(m).tobytes() for m in mask] if wanted else None}
            return pd.DataFrame([base | done])
        except Exception as e:  # a candidate's failure is its result
            failed = {"succeeded": False, "porosity": None, "units": None, "failure_type": type(e).__name__, "failure_message": "".join(traceback.format_exception_only(e)).strip(), "scale": None, "components": None, "warnings": [], "masks": None}
            return pd.DataFrame([base | failed])

    out = tasks.groupBy("sequence_index").applyInPandas(run, "sequence_index int, seed bigint, succeeded boolean, porosity double, units int, failure_type string, failure_message string, scale double, components int, warnings array<string>, masks array<binary>")
    if wanted:
        out = written(out, "candidates")
        slabs = out.where("succeeded").select(F.col("sequence_index").alias("run_id"), F.posexplode("masks").alias("z", "mask"))
        shape = tuple(round(b / config["spacing"]) for b in config["box"])
        missed = audit.measured_warnings(measure.measure_slabs(slabs, shape, float(config["spacing"]), config.get("contract", measure.CONTRACT)), wanted)
        out = out.join(missed.withColumnRenamed("run_id", "sequence_index"), "sequence_index", "left").withColumn("warnings", F.concat("warnings", F.coalesce("missed", F.array().cast("array<string>"))))
    passed = F.col("succeeded") & (F.size("warnings") == 0)
    return out.select("sequence_index", "seed", "succeeded", "porosity", passed.alias("audit_passed"), "units", "failure_type", "failure_message", "scale", "components", "warnings")


def chosen(results: DataFrame, target: float) -> DataFrame:
    """The first candidate that passed its audit; else, of those that have one, the porosity nearest the target."""
    return select_candidate(results.where("succeeded"), F.col("audit_passed"), "porosity", target, "sequence_index")


def replayed(results: DataFrame, winner: DataFrame, config: dict) -> DataFrame:
    """sequence_index, same and differing: the winner evaluated once more from its seed, and the columns of its row that come out otherwise. A candidate must not depend on where or when it ran."""
    kept = written(winner.select(results.columns), "winner")
    again = evaluated(kept.select("sequence_index", "seed"), config)
    columns = [c for c in kept.columns if c != "sequence_index"]
    both = kept.select("sequence_index", F.struct(*columns).alias("_a")).join(again.select("sequence_index", F.struct(*columns).alias("_b")), "sequence_index", "left")
    off = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    return both.select("sequence_index", off.alias("differing")).select("sequence_index", (F.size("differing") == 0).alias("same"), "differing")
