"""A ledger of delivered text artefacts, and a status for every delivering source; takes only files that are new.

    python -m jobs.artifact_ledger --input documents/ --output ledger/ --mark mark/ [--config config.json]

Handed-over bundles are checked by their manifests: what came, how large it is, its SHA-256, whether that is what was
declared, and whether a name came twice with different contents. Here the artefacts are rows of a text table that grows
file by file.

1. A file stream (availableNow, with its checkpoint under `mark`) takes the files no earlier run has taken. Every batch
   writes its rows to output/ledger, partitioned by batch and run (the source's slug), with dynamic overwrite: a batch
   that is repeated after a failure writes the same partitions again.
2. output/summary, partitioned by run, is written anew for the runs of batches behind the summary's own mark (the last
   batch it counts). A run stopped before this step is caught up by the next.

Entry statuses: missing (no text), undeclared (no size), size_mismatch, ok. A source is NOT_EVALUABLE with missing texts,
FAIL with wrong sizes or ids of different contents, WARNING with repeated contents, else PASS. Null sources are one run
of their own, null ids are never taken for one another, and an empty table gives an empty ledger.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line
from voxlake.functions.geometry import slug
from voxlake.operators.reconcile import differs, report_status
from voxlake.tables import exists

log = logging.getLogger("jobs.artifact_ledger")

LEDGER = "batch bigint, run string, source string, doc_id bigint, n_bytes bigint, n_lines bigint, sha256 string, status string"
SUMMARY = "run string, source string, artifacts bigint, bytes bigint, contents bigint, conflicts bigint, digest string, source_status string, upto bigint"


def entries(docs: DataFrame, tolerance: float = 0) -> DataFrame:
    """run, source, doc_id, n_bytes, n_lines, sha256 and status of every row."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    off = differs(F.length(text).cast("double"), F.col("n_chars").cast("double"), float(tolerance), 0.0)
    status = F.when(text.isNull(), "missing").when(F.col("n_chars").isNull(), "undeclared").when(off, "size_mismatch").otherwise("ok")
    run = F.concat(F.lit("run-"), F.coalesce(slug(source), F.lit("")))  # never empty, so that no partition is the default one
    return docs.select(
        run.alias("run"), source.alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint").alias("n_lines"), F.sha2(text.cast("binary"), 256).alias("sha256"), status.alias("status"),
    )


def summaries(ledger: DataFrame, warn_copies: bool = True) -> DataFrame:
    """A row a source: counts, an order-free digest of its contents, and its status. Every step counts before it shuffles."""
    keyed = ledger.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")))  # a source decides its run; null joins null
    first = F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(20,0)")
    totals = keyed.groupBy("_key", "run", "source").agg(
        F.count("*").alias("artifacts"), F.sum("n_bytes").alias("bytes"), F.coalesce(F.sum(first), F.lit(0)).cast("string").alias("digest"), F.max("batch").alias("upto"),
        *[F.count_if(F.col("status") == s).alias(f"_{s}") for s in ("missing", "size_mismatch")],
    )
    contents = keyed.where("sha256 is not null").groupBy("_key", "sha256").agg(F.count("*").alias("n"))
    contents = contents.groupBy("_key").agg(F.count("*").alias("contents"), F.count_if(F.col("n") > 1).alias("_copied"))
    ids = keyed.where("doc_id is not null").groupBy("_key", "doc_id").agg((F.min("sha256") < F.max("sha256")).alias("differ"))
    ids = ids.groupBy("_key").agg(F.count_if("differ").alias("conflicts"))
    out = totals.join(contents, "_key", "left").join(ids, "_key", "left").fillna(0, ["contents", "_copied", "conflicts"])

    def named(count: str, what: str):
        return F.when(F.col(count) > 0, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))

    errors = F.concat(named("_size_mismatch", "size differs from what was declared"), named("conflicts", "one id with different contents"))
    warnings = named("_copied", "repeated contents") if warn_copies else F.array().cast("array<string>")
    return out.select("run", "source", "artifacts", F.coalesce("bytes", F.lit(0)).alias("bytes"), "contents", "conflicts", "digest", report_status(errors, warnings, named("_missing", "text")).alias("source_status"), "upto")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def run(spark: SparkSession, source: str, output: str, mark: str, config: dict) -> dict:
    """Takes what is new at `source` into the ledger and brings the summary up to date; returns what it took and wrote."""
    ledger, summary = f"{output.rstrip('/')}/ledger", f"{output.rstrip('/')}/summary"
    took = {"batches": 0, "rows": 0, "runs": 0}

    def take(batch: DataFrame, number: int) -> None:
        rows = entries(batch, config["size_tolerance"]).withColumn("batch", F.lit(number).cast("bigint"))
        rows.hint("rebalance", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "run").parquet(ledger)  # few files a run, and a large run in several
        n = _read(spark, ledger, LEDGER).where(F.col("batch") == number).count()
        took["batches"] += 1
        took["rows"] += n
        log.info("batch %d: read and wrote %d rows to %s", number, n, ledger)

    pattern = f"{source.rstrip('/')[:-1]}[{source.rstrip('/')[-1]}]"  # streams read folders or patterns, and a table may be one file
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(pattern)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{mark.rstrip('/')}/stream").trigger(availableNow=True).start().awaitTermination()

    rows = _read(spark, ledger, LEDGER)
    done = _read(spark, summary, SUMMARY).groupBy("run").agg(F.max("upto").alias("upto"))
    behind = rows.groupBy("run").agg(F.max("batch").alias("last")).join(done, "run", "left").where("upto is null or upto < last").select("run")
    stale = behind.count()
    if stale:
        anew = summaries(rows.join(behind, "run", "left_semi"), config["warn_copies"])
        anew.hint("rebalance", "run").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(summary)
    took["runs"] = stale
    log.info("took %(rows)d rows in %(batches)d batches; summary written for %(runs)d runs", took)
    return took


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: every entry of the ledger with the summary of its source."""
    ledger, summary = (_read(spark, f"{output.rstrip('/')}/{name}", schema).alias(name) for name, schema in (("ledger", LEDGER), ("summary", SUMMARY)))
    same = (F.col("ledger.run") == F.col("summary.run")) & F.col("ledger.source").eqNullSafe(F.col("summary.source"))
    return ledger.join(summary, same, "left").select("ledger.run", "ledger.source", *LEDGER_OUT, *SUMMARY_OUT)


LEDGER_OUT = ["doc_id", "n_bytes", "n_lines", "sha256", "status"]
SUMMARY_OUT = ["artifacts", "bytes", "contents", "conflicts", "digest", "source_status"]

SQL = r"""
with e as (select 'run-' || coalesce(regexp_replace(regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), '') run, source, doc_id, strlen(text)::bigint n_bytes,
             (length(text) - length(replace(text, chr(10), '')) + 1)::bigint n_lines, sha256(text) sha256,
             case when text is null then 'missing' when n_chars is null then 'undeclared' when length(text) <> n_chars then 'size_mismatch' else 'ok' end status from documents),
c as (select run, source, count(*) contents, count(*) filter (n > 1) copied from (select run, source, sha256, count(*) n from e where sha256 is not null group by all) group by all),
i as (select run, source, count(*) filter (a < b) conflicts from (select run, source, doc_id, min(sha256) a, max(sha256) b from e where doc_id is not null group by all) group by all),
t as (select run, source, count(*) artifacts, coalesce(sum(n_bytes), 0)::bigint bytes, coalesce(sum(('0x' || substr(sha256, 1, 15))::bigint), 0)::varchar digest,
        count(*) filter (status = 'missing') missing, count(*) filter (status = 'size_mismatch') wrong from e group by all),
s as (select t.*, coalesce(contents, 0) contents, coalesce(conflicts, 0) conflicts,
        case when missing > 0 then 'NOT_EVALUABLE' when wrong > 0 or coalesce(conflicts, 0) > 0 then 'FAIL' when coalesce(copied, 0) > 0 then 'WARNING' else 'PASS' end source_status
      from t left join c on c.run = t.run and c.source is not distinct from t.source left join i on i.run = t.run and i.source is not distinct from t.source)
select e.run, e.source, doc_id, n_bytes, n_lines, sha256, status, artifacts, bytes, contents, conflicts, digest, source_status from e join s on s.run = e.run and s.source is not distinct from e.source
"""

if __name__ == "__main__":
    command_line("artifact_ledger", run)
