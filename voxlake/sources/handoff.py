"""Files handed over to packing programs, and what is looked up in the ones that come back. Written and read by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.sources.config import blocks_of, derived
from voxlake.tables import exists

#: Phases by name, what packing keeps between molecules in angstrom, and where configurations of a run lie, the first one that is there counting.
PHASES, TOLERANCE = {"MATRIX": 0, "PORE": 1}, 2.0
CONFIGURATIONS = ["inputs/normalized_config.yaml", "qa_export/normalized_config.yaml"]
#: Numbers on a line of an index group.
GROUP_WIDTH = 15


def interface_fraction(spark: SparkSession, root: str) -> float:
    """The mixing layer's share of the interface that the run's configuration gives its audit; 0 if there is no such file or number. A file that doesn't hold the number leaves it to the next."""
    for name in CONFIGURATIONS:
        path = f"{root.rstrip('/')}/{name}"
        if not exists(spark, path):
            continue
        data, _ = blocks_of(spark.read.text(path, wholetext=True).first()[0])
        audit = data.get("audit", data.get("geometry_audit"))
        if isinstance(audit, dict) and "interface_mixing_layer_fraction" in audit:
            return float(audit["interface_mixing_layer_fraction"])
    return 0.0


def _box(sides: dict) -> list[float]:
    return [float(sides[c]) for c in "xyz"]


def packing_deck(config: dict, structure: str, count: int, output: str = "packed_pore_material.pdb") -> list[str]:
    """The lines of a packing input: so many copies of a structure inside the packing box of a checked configuration."""
    packing = _box(derived(config)["packing_box_A"])
    return [
        f"# target_box_A: {_box(config['film']['target_box_A'])}", f"# packing_box_A: {packing}", f"tolerance {TOLERANCE}", "filetype pdb", f"output {output}",
        f"structure {structure}", f"  number {int(count)}", "  inside box 0.0 0.0 0.0 " + " ".join(f"{side:.10f}" for side in packing), "end structure",
    ]


def index_lines(atoms: DataFrame, name: str = "PORE", serial: str = "serial", width: int = GROUP_WIDTH) -> DataFrame:
    """place and value: the lines of an index group of the different serials from 1 on, `width` numbers' worth of them a line."""
    rows = atoms.select(F.col(serial).cast("bigint").alias("serial")).where("serial > 0").distinct()
    lines = rows.groupBy(F.floor((F.col("serial") - 1) / width).alias("_line")).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list("serial")), lambda s: s.cast("string"))).alias("value"))
    head = atoms.sparkSession.createDataFrame([(-1, f"[ {name} ]")], "place bigint, value string")
    return head.unionByName(lines.select(F.col("_line").alias("place"), "value"))


def coordinate_digest(atoms: DataFrame, columns: tuple[str, ...] = ("x", "y", "z"), digits: int = 6) -> str:
    """A digest of all rows' coordinates that doesn't depend on their order: the first 60 bits of each row's SHA-256, added up, in hex."""
    text = F.concat_ws(" ", *[F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in columns])
    first = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return f"{int(atoms.agg(F.coalesce(F.sum(first), F.lit(0))).first()[0]):x}"


def compression(config: dict, atoms: DataFrame) -> dict:
    """What a compressing run must keep: boxes, where the target lies in the packing box, and the digest of the coordinates."""
    found = derived(config)
    return {
        "target_box_A": _box(config["film"]["target_box_A"]), "packing_box_A": _box(found["packing_box_A"]), "target_origin_A": _box(found["target_origin_in_packing_A"]),
        "absolute_lock_mode": "target_origin_in_packing_A", "pore_coordinate_hash": coordinate_digest(atoms),
    }


def write_handoff(config: dict, atoms: DataFrame, structure: str, count: int, folder: str) -> None:
    """packing_input, index_group, phase_mapping and compression in a folder, as text whose parts one after another are the files."""
    spark, base = atoms.sparkSession, folder.rstrip("/")
    texts = {"packing_input": packing_deck(config, structure, count), "phase_mapping": [json.dumps(PHASES, sort_keys=True)], "compression": [json.dumps(compression(config, atoms), sort_keys=True)]}
    for name, lines in texts.items():
        spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/{name}")  # a few lines
    index_lines(atoms).orderBy("place").select("value").write.mode("overwrite").text(f"{base}/index_group")
