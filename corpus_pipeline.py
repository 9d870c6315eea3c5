"""A training corpus from `documents`, stage by stage.

Every stage but the last returns the columns of its documents; each is written to the shared folder and read again.
Null ids are kept by every stage; texts that a stage empties stay as empty texts. Of a group of near duplicates the one
of the smallest id stays, and rows of one id stay or go together; substrings that repeat stay where the id is smallest.
An empty table gives an empty one from every stage. Columns may have any names; a stage brings back those it was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import line_dedup, minhash, packing, quality, suffix_dedup
from voxlake.llm.common import by_ids, crc32_text, table, written
from voxlake.llm.queries import WORD_BPE

#: Documents whose probability of label 1 is lower are rejected.
LEAST_QUALITY = 0.3
SIMILARITY = 80


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, n_chars anew."""
    fresh = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs
    return fresh.select([F.col(f"`{c}`") for c in like.columns])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc32_text("doc_id") % 5 != 0)
    held = spark.sparkContext.broadcast(network)
    name = "_" * (1 + max(map(len, docs.columns)))  # longer than any column's
    scored = quality.labelled.scored(docs, lambda raw, offsets: held.value.score(raw, offsets), name)
    return scored.where(F.col(name) >= LEAST_QUALITY).drop(name)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies count as one page: the next stage is to find one of them whole."""
    return _recounted(line_dedup.dedup_lines(docs, "source", copies_once=True), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), percent=SIMILARITY)
    return by_ids(docs, groups.where("not kept"), "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of a cut character go with the cut."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = suffix_dedup.dedup_substrings(docs, 50, {"text": ("string", lambda kept, spans: kept.decode("utf-8", "ignore"))}, others)
    return _recounted(cut.select("doc_id", "text", *[F.col(f"rest.`{c}`") for c in others]), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_BPE, derive={"ids": ("array<int>", packing.ids_list)})


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_substrings),
    ("best_fit_packing", pack_sequences),
]

#: A network fitted in numpy and the merges of a tokenizer aren't SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
