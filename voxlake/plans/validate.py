"""An exported measurement against one made anew: issues per run, and a status that orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.operators.curves import record_issues
from voxlake.operators.matching import matched_points, mutual
from voxlake.operators.reconcile import differs, reconciled, report_status
from voxlake.plans import measure
from voxlake.tables import written

#: Tables every bundle must have.
MANDATORY = ["voxels", "centerlines", "cross_sections", "measurements", "contract"]
#: Tables of a written measurement that stand for them; voxels are the phase's own.
TABLES = {"centerlines": "points", "cross_sections": "sections", "measurements": "porosity", "contract": "contract"}
#: Tolerances of recomputed values.
ATOL, RTOL = 1e-6, 1e-6


def missing_entries(present: DataFrame) -> DataFrame:
    """Mandatory tables a run doesn't have: an anti-join of what should be with present(run_id, entry)."""
    spark = present.sparkSession
    wanted = present.select("run_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in MANDATORY], "entry string")))  # a fixed list
    return wanted.join(present, ["run_id", "entry"], "left_anti")


def section_issues(reported: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(run_id, code, detail) of sections that are missing, extra or off in any measure."""
    keys = ["run_id", "track_id", "place"]
    cols = ["valid", "area", "diameter", "fluctuation"]
    place = F.round(F.col("arc") * 1000).cast("bigint").alias("place")
    left = reported.select("run_id", "track_id", place, *[F.col(c).alias(f"r_{c}") for c in cols], F.lit(True).alias("_r"))
    right = rebuilt.select("run_id", "track_id", place, *[F.col(c).alias(f"e_{c}") for c in cols], F.lit(True).alias("_e"))
    both = left.join(right, keys, "full_outer")
    off = F.filter(F.array(F.when(~F.col("r_valid").eqNullSafe(F.col("e_valid")), F.lit("valid")), *[F.when(differs(F.col(f"r_{c}"), F.col(f"e_{c}"), ATOL, RTOL), F.lit(c)) for c in cols[1:]]), lambda x: x.isNotNull())
    code = F.when(F.col("_r").isNull(), "section_missing").when(F.col("_e").isNull(), "section_unexpected").when(F.size(off) > 0, "section_mismatch")
    found = both.withColumn("code", code).where("code is not null")
    return found.select("run_id", "code", F.format_string("track %d: %s", "track_id", F.array_join(off, ", ")).alias("detail"))


def porosity_issues(reported: DataFrame, rebuilt: DataFrame, tolerance: float = 0.01) -> DataFrame:
    rows = reconciled(reported, rebuilt, ["run_id"], "porosity", tolerance)
    return rows.where("status <> 'ok'").select("run_id", F.concat(F.lit("porosity_"), "status").alias("code"), F.format_string("%s against %s", F.col("reported").cast("string"), F.col("expected").cast("string")).alias("detail"))


def _named(rows: DataFrame, code, detail) -> DataFrame:
    return rows.select("run_id", code.alias("code"), detail.alias("detail")).where("code is not null")


def center_issues(reported: DataFrame, rebuilt: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """(run_id, code, detail) of slice centres that are missing, extra, moved or of another wall distance. Centres of a slice have no order: they are matched one to one within a voxel."""
    by, box = ["run_id", "z_index"], (shape[0] * spacing, shape[1] * spacing)
    flat = lambda rows: rows.select(*by, F.posexplode("centers").alias("id", "c")).select(*by, "id", "c.x", "c.y", "c.wall")
    left, right = flat(reported), flat(rebuilt)
    met = matched_points(left.select(*by, "id", "x", "y"), right.select(*by, "id", "x", "y"), spacing, box, by)
    met = met.join(left.select(*by, F.col("id").alias("reported"), F.col("wall").alias("_r")), [*by, "reported"], "left").join(right.select(*by, F.col("id").alias("expected"), F.col("wall").alias("_e")), [*by, "expected"], "left")
    code = F.when(F.col("status") != "ok", F.concat(F.lit("center_"), "status")).when(F.col("distance") > ATOL, "center_moved").when(differs(F.col("_r"), F.col("_e"), ATOL, RTOL), "center_wall")
    return _named(met, code, F.format_string("slice %d", "z_index"))


def track_pairs(reported: DataFrame, rebuilt: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """run_id, a (reported track), b (rebuilt track) and points they share: tracks may be numbered otherwise, so those with most points in common belong together."""
    by, box = ["run_id", "z_index"], (shape[0] * spacing, shape[1] * spacing)
    spots = lambda rows: rows.select(*by, F.col("track_id").alias("id"), F.col("wrapped_x").alias("x"), F.col("wrapped_y").alias("y"))
    met = matched_points(spots(reported), spots(rebuilt), spacing, box, by).where("status = 'ok'")
    shared = met.groupBy("run_id", F.col("reported").alias("a"), F.col("expected").alias("b")).agg(F.count("*").alias("shared"), F.max("distance").alias("moved"))
    return mutual(shared.withColumn("cost", -F.col("shared")), "cost", ["run_id"]).join(shared, ["run_id", "a", "b"])


def track_issues(reported: DataFrame, rebuilt: DataFrame, paired: DataFrame) -> DataFrame:
    """(run_id, code, detail) of tracks that are missing, extra, of other points or branches, or moved."""
    facts = lambda rows, end: rows.groupBy("run_id", F.col("track_id").alias(end)).agg(F.count("*").alias(f"n_{end}"), F.count_if("branch").alias(f"branches_{end}"))
    both = paired.join(facts(reported, "a"), ["run_id", "a"], "full_outer").join(facts(rebuilt, "b"), ["run_id", "b"], "full_outer")
    code = F.when(F.col("a").isNull(), "track_missing").when(F.col("b").isNull(), "track_unexpected").when((F.col("n_a") != F.col("n_b")) | (F.col("shared") != F.col("n_a")), "track_points").when(F.col("moved") > ATOL, "track_moved").when(F.col("branches_a") != F.col("branches_b"), "track_branches")
    return _named(both, code, F.format_string("track %d", F.coalesce("a", "b")))


def keyed_issues(reported: DataFrame, rebuilt: DataFrame, keys: list[str], columns: list[str], what: str, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """(run_id, code, detail) of rows that are missing, extra, or off in any of the columns, by key."""
    left = reported.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns], F.lit(True).alias("_r"))
    right = rebuilt.select(*keys, *[F.col(c).alias(f"e_{c}") for c in columns], F.lit(True).alias("_e"))
    off = F.array_compact(F.array(*[F.when(differs(F.col(f"r_{c}").cast("double"), F.col(f"e_{c}").cast("double"), atol, rtol), F.lit(c)) for c in columns]))
    both = left.join(right, keys, "full_outer").withColumn("_off", off)
    code = F.when(F.col("_r").isNull(), f"{what}_missing").when(F.col("_e").isNull(), f"{what}_unexpected").when(F.size("_off") > 0, f"{what}_mismatch")
    return _named(both, code, F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys[1:]], F.array_join("_off", ", ")))


def renamed(rows: DataFrame, paired: DataFrame) -> DataFrame:
    """`rows` with the rebuilt track's number for track_id; a track without a partner gets a negative one, which no rebuilt track has."""
    names = paired.select("run_id", F.col("a").alias("track_id"), F.col("b").alias("_track"))
    return rows.join(names, ["run_id", "track_id"], "left").withColumn("track_id", F.coalesce("_track", -1 - F.col("track_id"))).drop("_track")


def geometry_issues(reported: dict[str, DataFrame], anew: dict[str, DataFrame], shape: tuple[int, int, int], spacing: float, paired: DataFrame | None = None) -> DataFrame | None:
    """Issues of what is there of centers, points, orientations, channels and distances; orientations and channels are compared through the tracks' matching."""
    found = []
    if "centers" in reported:
        found.append(center_issues(reported["centers"], anew["centers"], shape, spacing))
    if "points" in reported:
        found.append(track_issues(reported["points"], anew["points"], paired))
        for table, columns in (("orientations", ["theta_xz", "theta_xy"]), ("channels", ["valid", "eta", "tau", "fluctuation"])):
            if table in reported:
                found.append(keyed_issues(renamed(reported[table], paired), anew[table], ["run_id", "track_id"], columns, table.removesuffix("s")))
    if "distances" in reported:
        found.append(keyed_issues(reported["distances"], anew["distances"], ["run_id", "bin"], ["n", "reference", "g"], "g_xy"))
    out = None
    for part in found:
        out = part if out is None else out.unionByName(part)
    return out


def validate(voxels: DataFrame, reported_sections: DataFrame, reported_porosity: DataFrame, present: DataFrame, shape: tuple[int, int, int], spacing: float = 1.0, contract: dict | None = None, reported: dict[str, DataFrame] | None = None) -> DataFrame:
    """run_id, status and issues of every run, everything measured anew from its voxels.

    reported: other tables of the measurement to be judged, see geometry_issues, and units and curves, see
    record_issues; those that aren't given aren't judged.
    """
    anew = measure.measure(voxels, shape, spacing, contract or measure.CONTRACT)
    reported = reported or {}
    paired = written(track_pairs(reported["points"], anew["points"], shape, spacing), "paired-tracks") if "points" in reported else None
    sections = renamed(reported_sections, paired) if paired is not None else reported_sections
    issues = section_issues(sections, anew["sections"]).unionByName(porosity_issues(reported_porosity, anew["porosity"]))
    if "units" in reported and "curves" in reported:
        records = record_issues(reported["units"], reported["curves"], ["run_id", "unit_id"])
        issues = issues.unionByName(records.select("run_id", "code", F.concat_ws(" ", F.col("unit_id").cast("string"), "detail").alias("detail")))
    geometry = geometry_issues(reported, anew, shape, spacing, paired)
    issues = issues if geometry is None else issues.unionByName(geometry)
    missing = missing_entries(present).groupBy("run_id").agg(F.sort_array(F.collect_list("entry")).alias("missing"))
    listed = issues.groupBy("run_id", "code").agg(F.count("*").alias("n"), F.min("detail").alias("first"))  # a row a kind of issue, however many there are
    text = F.concat(F.col("code"), F.lit(": "), F.coalesce("first", F.lit("")), F.when(F.col("n") > 1, F.format_string(" and %d more", F.col("n") - 1)).otherwise(""))
    errors = listed.groupBy("run_id").agg(F.sort_array(F.collect_list(text)).alias("errors"))
    none = F.array().cast("array<string>")
    out = present.select("run_id").distinct().join(errors, "run_id", "left").join(missing, "run_id", "left").select("run_id", F.coalesce("errors", none).alias("errors"), F.coalesce("missing", none).alias("missing"))
    return out.select("run_id", report_status(F.col("errors"), none, F.col("missing")).alias("status"), "errors", "missing")
