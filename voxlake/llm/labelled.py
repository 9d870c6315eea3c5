"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample(labels: DataFrame, label: str, fold: Column, per_class: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most per_class[c] rows of each class among those of `fold`, the first by a hash of the id, and all rows' counts by class.

    Rows with a null id or label, and ids with two labels, are left out.
    """
    rows = labels.select(F.col("doc_id").cast("bigint"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most").where(fold)
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = None
    for c, most in per_class.items():
        some = rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        out = some if out is None else out.union(some)
    return out, counts


def gathered(docs: DataFrame, chosen: DataFrame, made: Callable[[np.ndarray, np.ndarray], list[bytes]], most: int) -> tuple[list[bytes], np.ndarray]:
    """What `made` gives for the whole texts of the sample (pieces of bytes and offsets -> one value a row), and their labels, on the driver.

    `most`, the sum of the sample's bounds, is what makes the broadcast of its ids and the collection safe.
    """
    from voxlake.llm.common import pieces, string_buffers

    ids = [(r["doc_id"], r["label"]) for r in chosen.collect()]
    assert len(ids) <= most
    if not ids:
        return [], np.zeros(0, np.int64)
    small = docs.sparkSession.createDataFrame(ids, "doc_id bigint, label int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for i, j, part, at in pieces(raw, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(made(part, at), pa.binary()), batch.column(2).slice(i, j - i)], names=["doc_id", "made", "label"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text is not null")
    rows = texts.join(F.broadcast(small), "doc_id").mapInArrow(run, "doc_id bigint, made binary, label int")
    found = {}
    for r in rows.collect():  # of repeated ids one row counts
        mine = (bytes(r["made"]), r["label"])
        found[r["doc_id"]] = min(found.get(r["doc_id"], mine), mine)
    order = sorted(found)
    return [found[i][0] for i in order], np.array([found[i][1] for i in order], np.int64)


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str = "score", text: str = "text") -> DataFrame:
    """`docs` with the score of every whole text, null texts as empty ones, as column `name`, which replaces one of that name.

    score: bytes and offsets -> one number a row.
    """
    from voxlake.llm.common import in_small_batches, pieces, string_buffers, trimmed

    rest = docs.select([F.col(f"`{c}`") for c in docs.columns if c != name])
    schema = T.StructType([*rest.schema.fields, T.StructField(name, T.DoubleType())])
    at = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(at).cast(pa.string()))
            scores = [score(part, ends).astype(np.float64) for _, _, part, ends in pieces(raw, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*batch.schema.names, name])
        trimmed()

    return in_small_batches(rest).mapInArrow(run, schema)
