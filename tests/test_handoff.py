"""Handed-over files, lookups in returned ones, and the replay of a winner."""

import json
from pathlib import Path

from pyspark.sql import functions as F
from test_operators import minimal

from voxlake.plans import generate
from voxlake.plans.kernels import CONFIG
from voxlake.sources import config, handoff, text


def text_of(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def atoms_of(spark, n):
    return spark.range(1, n + 1).select(F.col("id").alias("serial"), *[(F.col("id") * k / 7).alias(c) for c, k in (("x", 1.0), ("y", 2.0), ("z", 3.0))]).repartition(4)


def test_files_for_a_packing_program(spark, tmp_path):
    checked, atoms = config.checked(minimal()), atoms_of(spark, 47)
    handoff.write_handoff(checked, atoms, "/data/m.pdb", 12, str(tmp_path))
    deck = text_of(tmp_path / "packing_input").splitlines()
    assert deck[2:5] == ["tolerance 2.0", "filetype pdb", "output packed_pore_material.pdb"] and "structure /data/m.pdb" in deck and "  number 12" in deck
    assert deck[-2] == "  inside box 0.0 0.0 0.0 20.0000000000 20.0000000000 30.0000000000" and deck[-1] == "end structure"
    group = text_of(tmp_path / "index_group").splitlines()
    assert group[0] == "[ PORE ]" and " ".join(group[1:]).split() == [str(i) for i in range(1, 48)] and len(group) == 5
    assert sorted(r["serial"] for r in text.index_group(spark, str(tmp_path / "index_group")).collect()) == list(range(1, 48))
    assert json.loads(text_of(tmp_path / "phase_mapping")) == {"MATRIX": 0, "PORE": 1}
    meta = json.loads(text_of(tmp_path / "compression"))
    assert meta["target_origin_A"] == [0.0, 0.0, 5.0] and meta["packing_box_A"] == [20.0, 20.0, 30.0] and meta["pore_coordinate_hash"] == handoff.coordinate_digest(atoms.orderBy(F.desc("serial")))
    assert handoff.coordinate_digest(atoms.withColumn("x", F.col("x") + F.when(F.col("serial") == 3, 1e-5).otherwise(0.0))) != meta["pore_coordinate_hash"]
    assert handoff.coordinate_digest(atoms.limit(0)) == "0"


def test_interface_fraction_of_the_first_file_that_has_it(spark, tmp_path):
    assert handoff.interface_fraction(spark, str(tmp_path)) == 0.0
    for folder, body in (("qa_export", "geometry_audit: {interface_mixing_layer_fraction: 0.25}\n"), ("inputs", "audit: {other: 1}\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "normalized_config.yaml").write_text(body)
    assert handoff.interface_fraction(spark, str(tmp_path)) == 0.25
    (tmp_path / "inputs" / "normalized_config.yaml").write_text("audit: {interface_mixing_layer_fraction: 0.5}\n")
    assert handoff.interface_fraction(spark, str(tmp_path)) == 0.5


def test_a_winner_comes_out_the_same_again(spark):
    results = generate.evaluated(spark.createDataFrame([(0, 11), (1, 12)], "sequence_index int, seed bigint"), CONFIG).cache()
    best = generate.chosen(results, CONFIG["porosity"])
    assert tuple(generate.replayed(results, best, CONFIG).first())[1:] == (True, [])
    altered = best.withColumn("porosity", F.col("porosity") + 1e-9).withColumn("units", F.col("units") + 1)
    assert sorted(generate.replayed(results, altered, CONFIG).first()["differing"]) == ["porosity", "units"]
