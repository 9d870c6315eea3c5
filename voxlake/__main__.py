"""python -m voxlake: preflight, generate, measure and validate from the command line."""

from __future__ import annotations

import argparse
import json
import sys

VERSION = "0.1.0"


def _film(config: dict) -> tuple[dict, dict]:
    """The generator's and the measurement's parameters of a checked configuration."""
    from voxlake.sources.config import derived

    box, shape = config["film"]["target_box_A"], config["formal_targets"]["shape"]
    diameter = shape["equivalent_diameter_A"] or {"family": "constant", "value": (6 * config["pores"]["target_porosity"] / (3.141592653589793 * max(config["pores"]["seed_number_density_A3"], 1e-300))) ** (1 / 3)}
    film = {"box": [box["x"], box["y"], box["z"]], "spacing": config["audit"]["fine_spacing_A"], "count": derived(config)["seed_count"], "porosity": config["pores"]["target_porosity"], "lattice": (config["center_distribution"] or {}).get("lattice") or "simple_cubic", "jitter": (config["center_distribution"] or {}).get("position_jitter") or 0.3, "channel_fraction": config["pores"]["channel_fraction_by_count"], "diameter": diameter, "eta": shape["channel_aspect_ratio"] or {"family": "constant", "value": 1.0}}
    contract = {k: v for k, v in config["measurement"].items() if v is not None}
    angles = (shape["orientation"] or {}).get("components") or []
    formal = {"equivalent_diameter": shape["equivalent_diameter_A"], "channel_eta": shape["channel_aspect_ratio"], "channel_tau": shape["channel_tortuosity"], "curvature_fluctuation": shape["curvature_fluctuation"]}
    formal |= {n: {"family": "mixture", "components": [c[f"{n}_deg"] | {"weight": c["weight"]} for c in angles]} if angles else None for n in ("theta_xz", "theta_xy")}
    film |= {"sized": bool(shape["equivalent_diameter_A"]), "measured": {k: v for k, v in formal.items() if v}, "contract": contract}
    return film, contract


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="voxlake", description=__doc__)
    parser.add_argument("--version", action="version", version=VERSION)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("preflight", "check a configuration"), ("generate", "make, measure and choose candidates"), ("measure", "measure a stored phase"), ("validate", "hold a stored measurement against a new one")):
        sub = commands.add_parser(name, help=text)
        sub.add_argument("path", help="a configuration, or the folder of a stored phase")
        sub.add_argument("--out", help="folder to write to")
        sub.add_argument("--candidates", type=int)
        sub.add_argument("--replay", action="store_true", help="generate: evaluate the chosen candidate again, and fail if anything differs")
    args = parser.parse_args(argv)
    from voxlake.sources import config as configs

    if args.command == "preflight":
        found = configs.preflight(configs.load(args.path))
        print(json.dumps({"passed": not any(level == "error" for level, _ in found), "issues": found, "memory_bytes": configs.voxel_memory(configs.load(args.path))}))
        return int(bool(found))
    from pyspark.sql import SparkSession

    from voxlake.plans import film, generate, measure, validate
    from voxlake.sources import phase
    from voxlake.tables import exists

    spark = SparkSession.builder.appName("voxlake").getOrCreate()
    if args.command == "generate":
        config = configs.load(args.path)
        if any(level == "error" for level, _ in configs.preflight(config)):
            print(json.dumps({"passed": False, "issues": configs.preflight(config)}))
            return 1
        made, contract = _film(config)
        tasks = generate.candidates(spark, config["task"]["random_seed"], config["audit"]["maximum_rounds"], args.candidates or config["audit"]["candidate_count_per_round"])
        results = generate.evaluated(tasks, made)
        best = generate.chosen(results, made["porosity"]).collect()
        print(json.dumps([r.asDict() for r in results.orderBy("sequence_index").collect()]))  # a row a candidate
        if best and args.replay:
            differing = generate.replayed(results, results.where(results.sequence_index == best[0]["sequence_index"]), made).first()["differing"]
            if differing:
                print(json.dumps({"replay": "differs", "columns": differing}))
                return 1
        if best and args.out:
            one = tasks.where(tasks.sequence_index == best[0]["sequence_index"])
            shape = tuple(round(b / made["spacing"]) for b in made["box"])
            phase.write_measurement(measure.measure_slabs(film.candidate_slabs(one, made), shape, made["spacing"], contract), args.out, contract)
        return int(not best)
    folder = args.out or f"{args.path}/measurement"
    places = {"voxels": f"{args.path}/voxels"} | {entry: f"{folder}/{name}" for entry, name in validate.TABLES.items()}
    there = [entry for entry in validate.MANDATORY if exists(spark, places[entry])]
    if args.command == "validate" and "voxels" not in there:  # nothing to measure anew
        print(json.dumps({"run_id": 0, "status": "NOT_EVALUABLE", "errors": [], "missing": sorted(set(validate.MANDATORY) - set(there))}))
        return 1
    voxels, meta = phase.read_phase(spark, args.path)
    contract = measure.CONTRACT | meta.get("contract", {})
    from pyspark.sql import functions as F

    rows = voxels.withColumn("run_id", F.lit(0))
    if args.command == "measure":
        phase.write_measurement(measure.measure(rows, tuple(meta["shape"]), meta["spacing_A"], contract), folder, contract)
        return 0
    present = spark.createDataFrame([(0, m) for m in there], "run_id int, entry string")
    off = []
    if "contract" in there:
        held = measure.CONTRACT | json.loads(spark.read.parquet(places["contract"]).first()["contract"])
        off = [f"contract_mismatch: {k}" for k in sorted(held) if meta.get("contract") and held[k] != contract.get(k)]
        contract = contract if meta.get("contract") else held
    empty = {"cross_sections": f"run_id int, {measure.SECTION}", "measurements": "run_id int, porosity double"}
    sections, porosity = (spark.read.parquet(places[e]) if e in there else spark.createDataFrame([], kind) for e, kind in empty.items())
    others = {t: spark.read.parquet(f"{folder}/{t}") for t in ("centers", "points", "orientations", "channels", "distances") if exists(spark, f"{folder}/{t}")}
    others |= {t: spark.read.parquet(f"{args.path}/{t}") for t in ("units", "curves") if exists(spark, f"{args.path}/{t}")}
    got = validate.validate(rows, sections, porosity, present, tuple(meta["shape"]), meta["spacing_A"], contract, others).collect()[0].asDict()
    if off:
        got |= {"errors": sorted(got["errors"] + off), "status": "FAIL" if got["status"] in ("PASS", "WARNING") else got["status"]}
    print(json.dumps(got))
    return int(got["status"] not in ("PASS", "WARNING"))


if __name__ == "__main__":
    sys.exit(main())
