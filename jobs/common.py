"""What the jobs share: configuration read by Spark, the command line, and sessions only it makes."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def config_of(name: str) -> dict:
    """The configuration that comes with a job."""
    return json.loads((HERE / f"{name}.json").read_text())


def command_line(name: str, job: Callable[[SparkSession, str, str, str, dict], dict], argv: list[str] | None = None) -> None:
    """Runs a job on the paths given, in a session of its own; --config is a JSON file anywhere Spark reads."""
    p = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    p.add_argument("--input", required=True, help="Parquet table to read")
    p.add_argument("--output", required=True, help="folder to write")
    p.add_argument("--mark", required=True, help="folder of checkpoint and marks")
    p.add_argument("--config", help=f"JSON file; jobs/{name}.json without it")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = config_of(name)
        if args.config:
            config |= json.loads(spark.read.text(args.config, wholetext=True).first()[0])
        job(spark, args.input, args.output, args.mark, config)
    finally:
        spark.stop()
