"""The jobs as queries: each runs twice into one new folder of the shared one, and gives the whole output after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import artifact_ledger, track_resampling
from jobs.common import config_of
from voxlake.tables import shared_dir


def _twice(job, name: str, table: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for _ in range(2):
            job.run(spark, f"{sf_dir.rstrip('/')}/{table}.parquet", f"{folder}/output", f"{folder}/mark", config_of(name))
        return job.read(spark, f"{folder}/output")

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "job1_artifact_ledger": _twice(artifact_ledger, "artifact_ledger", "documents"),
    "job2_track_resampling": _twice(track_resampling, "track_resampling", "events"),
}
SQL: dict[str, str] = {"job1_artifact_ledger": artifact_ledger.SQL, "job2_track_resampling": track_resampling.SQL}
