"""Reported against recomputed: full outer joins with tolerances, statuses, missing and extra entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(reported: Column, expected: Column, atol: float, rtol: float) -> Column:
    """Off by more than atol + rtol * |expected|; a null differs from a value, not from a null."""
    both = reported.isNotNull() & expected.isNotNull()
    off = F.abs(reported - expected) > F.lit(atol) + rtol * F.abs(expected)
    return F.when(both, F.coalesce(off | (F.isnan(reported) != F.isnan(expected)), F.lit(False))).otherwise(reported.isNull() != expected.isNull())


def reconciled(reported: DataFrame, expected: DataFrame, keys: list[str], column: str, atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """keys, reported, expected and status: ok, mismatch, missing (only expected) or unexpected (only reported)."""
    left = reported.select(*keys, F.col(column).cast("double").alias("reported"), F.lit(True).alias("_r"))
    right = expected.select(*keys, F.col(column).cast("double").alias("expected"), F.lit(True).alias("_e"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(differs(F.col("reported"), F.col("expected"), atol, rtol), "mismatch").otherwise("ok")
    return left.join(right, keys, "full_outer").select(*keys, "reported", "expected", status.alias("status"))


def report_status(errors: Column, warnings: Column, missing: Column) -> Column:
    """Missing entries, or errors that name a mandatory one: NOT_EVALUABLE; then FAIL, WARNING, PASS. Arrays of text."""
    absent = (F.size(missing) > 0) | F.exists(errors, lambda e: F.lower(e).contains("mandatory"))
    return F.when(absent, "NOT_EVALUABLE").when(F.size(errors) > 0, "FAIL").when(F.size(warnings) > 0, "WARNING").otherwise("PASS")


def accepted(passed: Column, warnings: Column, vetoes: list[str]) -> Column:
    """Passed, or no warning holds any of the vetoes."""
    veto = F.lit(False)
    for v in (x.lower() for x in vetoes):
        veto = veto | F.exists(warnings, lambda w: F.lower(w).contains(v))  # noqa: B023
    return F.coalesce(passed, F.lit(False)) | ~veto


def without_key(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others, key, "left_anti")


def with_key(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others, key, "left_semi")


def completed(tasks: DataFrame, results: DataFrame, message: str) -> DataFrame:
    """Results in order of their sequence, with a cancelled row for every task that has none."""
    missing = tasks.join(results.select("sequence_index"), "sequence_index", "left_anti").select("sequence_index", F.lit("cancelled").alias("status"), F.lit(message).alias("message"))
    return results.select("sequence_index", "status", "message").unionByName(missing).orderBy("sequence_index")
