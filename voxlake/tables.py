"""Tables in and out: the driver's Parquet files, and tables written between jobs to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where a session on one machine names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="voxlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, what: str = "part") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/voxlake-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._voxlake_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _at(df: DataFrame):
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._voxlake_path)
    return path, path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    if getattr(df, "_voxlake_path", None):
        path, system = _at(df)
        system.delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Size on disk of a table of written()."""
    path, system = _at(df)
    return int(system.getContentSummary(path).getLength())
