"""Vector columns as bytes, and which of them take part in a search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, components) of a binary column of equally long float64 vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float64).reshape(n, -1)


def usable(rows: DataFrame, key: str, vector: str, extra: list[str] | None = None) -> DataFrame:
    """id, vec (float64 bytes), width and `extra` of rows whose key isn't null and whose vector is neither null nor zero nor holds null or non-finite components."""
    extra = extra or []
    got = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c) for c in extra]).where("id is not null and v is not null and size(v) > 0")
    schema = "id bigint, vec binary, width int" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*extra).schema) if extra else "id bigint, vec binary, width int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keep, vecs, widths = [], [], []
            values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
            at = 0
            for i, n in enumerate(np.diff(lists.offsets.to_numpy()).tolist()):
                v = np.asarray(values[at : at + n], np.float64)
                at += n
                if np.isfinite(v).all() and v.any():
                    keep.append(i)
                    vecs.append(v.tobytes())
                    widths.append(n)
            take = pa.array(keep, pa.int64())
            rest = [batch.column(2 + k).take(take) for k in range(len(extra))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(vecs, pa.binary()), pa.array(widths, pa.int32()), *rest], names=["id", "vec", "width", *extra])

    return got.mapInArrow(run, schema)
