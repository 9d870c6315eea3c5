"""Text sources: fixed-width records, JSON members, molecule files, index groups, manifests. Bad records become rows, not failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fixed_width(rows: DataFrame, line: str, fields: dict[str, tuple[int, int, str]]) -> DataFrame:
    """`rows` with a column per field (start from 1, length, type); null where the text isn't of the type."""
    return rows.select("*", *[F.trim(F.substring(line, at, n)).try_cast(kind).alias(name) for name, (at, n, kind) in fields.items()])


def json_number(column: str, key: str) -> Column:
    """A member of a JSON object as a number; null if it isn't there or no number."""
    return F.get_json_object(column, f"$.{key}").try_cast("double")


def json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(objects, issues): lines as variants of their own, and the lines that are no JSON objects, with file and line text."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value")).where(F.trim("value") != "")
    parsed = lines.withColumn("object", F.expr("try_parse_json(value)"))
    good = F.expr("object is not null and schema_of_variant(object) like 'OBJECT%'")
    return parsed.where(good).select("file", "object"), parsed.where(~good | F.col("object").isNull()).select("file", F.lit("not_a_json_object").alias("code"), F.col("value").alias("text"))


#: Symbol, mass in g/mol and van der Waals radius in angstrom.
ELEMENTS = [
    ("H", 1.008, 1.20), ("C", 12.011, 1.70), ("N", 14.007, 1.55), ("O", 15.999, 1.52), ("F", 18.998, 1.47), ("SI", 28.085, 2.10), ("P", 30.974, 1.80),
    ("S", 32.06, 1.80), ("CL", 35.45, 1.75), ("AR", 39.948, 1.88), ("SE", 78.971, 1.90), ("BR", 79.904, 1.85), ("I", 126.904, 1.98), ("XE", 131.293, 2.16),
]


def elements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELEMENTS, "element string, mass double, radius double")


def _first_model(lines: DataFrame) -> DataFrame:
    """Lines before the first ENDMDL of a molecule file; files are small, so a file is one partition's."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("_after", F.coalesce(F.max(F.col("value").startswith("ENDMDL")).over(w), F.lit(False))).where("not _after").drop("_after")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no and value of text files that are read whole, one row each before they are split."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))


def atoms(spark: SparkSession, path: str) -> DataFrame:
    """file, serial, name, element, chain, residue, residue_no, x, y, z of the first model's ATOM and HETATM records.

    Coordinates come from their columns, or from the 7th to 9th word where those hold no numbers; the element from its
    own columns, or from the first two letters or the first letter of the atom's name, whichever is known.
    """
    rows = _first_model(numbered_lines(spark, path)).where(F.col("value").rlike("^(ATOM|HETATM)"))
    cut = fixed_width(rows, "value", {"serial": (7, 5, "int"), "name": (13, 4, "string"), "residue": (18, 3, "string"), "chain": (22, 1, "string"), "residue_no": (23, 4, "int"), "x": (31, 8, "double"), "y": (39, 8, "double"), "z": (47, 8, "double"), "symbol": (77, 2, "string")})
    words = F.split(F.trim("value"), r"\s+")
    xyz = [F.coalesce(c, F.try_element_at(words, F.lit(7 + i)).try_cast("double")).alias(c) for i, c in enumerate("xyz")]
    letters = F.upper(F.regexp_replace("name", "[^A-Za-z]", ""))
    known = [e for e, _, _ in ELEMENTS]
    element = F.coalesce(*[F.when(c.isin(known), c) for c in (F.upper("symbol"), F.substring(letters, 1, 2), F.substring(letters, 1, 1))])
    return cut.select("file", F.coalesce("serial", F.try_element_at(words, F.lit(2)).try_cast("int")).alias("serial"), "name", element.alias("element"), "chain", "residue", "residue_no", *xyz)


def bonds(spark: SparkSession, path: str) -> DataFrame:
    """file, a, b: CONECT pairs of different serials, each once."""
    rows = numbered_lines(spark, path).where(F.col("value").startswith("CONECT"))
    serials = F.array_compact(F.array(*[F.trim(F.substring("value", 7 + 5 * i, 5)).try_cast("int") for i in range(5)]))
    ends = rows.select("file", serials[0].alias("a"), F.explode(F.slice(serials, 2, 4)).alias("b")).where("a <> b")
    return ends.select("file", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def template(spark: SparkSession, path: str) -> DataFrame:
    """Atoms with mass and radius, moved so that the centre of mass is at the origin."""
    rows = atoms(spark, path).join(F.broadcast(elements(spark)), "element")  # a fixed table
    m = rows.groupBy("file").agg(*[(F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(f"_{c}") for c in "xyz"])
    return rows.join(m, "file").select("file", "serial", "name", "element", "mass", "radius", *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"])


def index_group(spark: SparkSession, path: str) -> DataFrame:
    """Different integers of an index-group file; group headers and other words are passed over."""
    words = spark.read.text(path).where(~F.trim("value").startswith("[")).select(F.explode(F.split("value", r"\s+")).alias("word"))
    return words.select(F.col("word").try_cast("int").alias("serial")).where("serial is not null").distinct()


def cif_atom_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count_if(F.col("value").startswith("HETATM ")).alias("atoms"))


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header; empty fields are null, True and False are booleans."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", mode="PERMISSIVE")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """sha and relative path of a checksum manifest."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("sha"), F.regexp_replace(parts[1], r"^\*", "").alias("relative"))


def manifest_issues(listed: DataFrame, present: DataFrame, required: DataFrame) -> DataFrame:
    """(code, relative): unsafe paths, entries listed twice, files absent or changed, and required files that aren't listed.

    present: relative and sha of the files there are; required: relative.
    """
    unsafe = listed.where(F.col("relative").rlike(r"(^/)|(^[A-Za-z]:)|((^|[/\\])\.\.([/\\]|$))")).select(F.lit("unsafe_path").alias("code"), "relative")
    twice = listed.groupBy("relative").count().where("count > 1").select(F.lit("duplicate"), "relative")
    joined = listed.select("relative", F.col("sha").alias("_listed")).join(present, "relative", "left")
    absent = joined.where("sha is null").select(F.lit("missing_file"), "relative")
    changed = joined.where("sha is not null and lower(sha) <> lower(_listed)").select(F.lit("checksum_mismatch"), "relative")
    unlisted = required.join(listed, "relative", "left_anti").select(F.lit("not_listed"), "relative")
    return unsafe.union(twice).union(absent).union(changed).union(unlisted)


def file_sums(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of whole files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha"))
