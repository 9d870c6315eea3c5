"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosines, connected components.

Vectors of one label whose bytes agree are one class from the start. A table gives each class a signature, the signs
of its products with `bits` random directions, and classes of one label and signature share a bucket. The number of
tables is such that a pair at the threshold misses all of them with probability MISS. A bucket is compared in cells of
at most CELL x CELL classes, so a bucket with a third of all rows is many tasks; every class carries its signatures of
all tables, and a pair counts in the first table it shares a bucket of, so nothing is counted twice and no pair leaves
its cell. Out of a cell come link counts and a spanning set of the links.

Vectors null, zero, or with null or non-finite components link with nothing, as do rows of a null label; each is its own
component. Vectors of different widths have no cosine: a width is part of the label. Equal vectors link (their cosine is 1). Rows of a null id count as vectors of
no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import written
from voxlake.llm.components import components
from voxlake.llm.vectors import matrix, usable

#: Classes a bucket should hold, classes on either side of a cell, and the chance to miss a pair at the threshold.
BUCKET, CELL, MISS = 64, 512, 1e-5


def plan(classes: int, labels: int, threshold: float, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = max(4, min(30, math.ceil(math.log2(max(2, classes / max(1, labels) / bucket)))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - alike)))


@lru_cache(maxsize=4)
def planes(width: int, n: int) -> np.ndarray:
    """n random directions for vectors of a width, the same in every task."""
    return np.random.default_rng((5, width)).normal(size=(width, n))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept per row of `rows`."""
    mine = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    vectors = written(usable(mine.where("label is not null"), "id", "v", ["label"]).select("id", "vec", F.struct("label", "width").alias("label")), "vectors")
    classes = written(vectors.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels")).collect()[0]
    bits, tables = plan(size["n"], size["labels"], threshold)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for batch in batches:
            widths = np.asarray(pa.compute.struct_field(batch.column(2), "width"))
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                signs = (matrix(part.column(1)) @ planes(width, bits * tables) > 0).reshape(part.num_rows, tables, bits)
                sigs = (signs * weights).sum(axis=2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sigs], pa.binary()), pa.array(list(sigs), pa.list_(pa.int32())), part.column(2), part.column(1), part.column(3)], names=["rep", "sigs", "each", "label", "vec", "copies"])

    kind = dict(classes.dtypes)["label"]
    held = written(classes.select("rep", "vec", "label", "copies").mapInArrow(signed, f"rep bigint, sigs binary, each array<int>, label {kind}, vec binary, copies bigint"), "signed")
    posts = held.select("rep", "label", F.posexplode("each").alias("t", "sig"))
    chunks = posts.groupBy("label", "t", "sig").agg(F.count("*").alias("n")).where("n > 1").select("label", "t", "sig", F.ceil(F.col("n") / CELL).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    placed = posts.join(chunks, ["label", "t", "sig"]).withColumn("own", own).select("label", "t", "sig", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    cells = placed.select("label", "t", "sig", "rep", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    full = cells.join(held.select("rep", "label", "sigs", "vec", "copies"), ["rep", "label"])

    def compared(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        t, i, j = (group.column(c)[0].as_py() for c in ("t", "i", "j"))
        rep, own, copies = (np.array(group.column(c)) for c in ("rep", "own", "copies"))
        sigs = np.frombuffer(b"".join(group.column("sigs").to_pylist()), np.int32).reshape(len(rep), -1)
        x = _unit(matrix(group.column("vec")))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links = np.zeros(len(rep), np.int64)
        root = np.arange(len(rep))

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        edges = []
        near = np.argwhere(x[left] @ x[right].T >= threshold - 1e-9)
        a, b = left[near[:, 0]], right[near[:, 1]]
        if i == j:
            a, b = a[a < b], b[a < b]
        exact = (x[a] * x[b]).sum(axis=1)
        close = (exact >= threshold) & ~(sigs[a, :t] == sigs[b, :t]).any(axis=1)
        a, b = a[close], b[close]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            u, v = find(p), find(q)
            if u != v:
                root[u] = v
                edges.append((int(rep[p]), int(rep[q])))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "rep": pa.array(np.concatenate([rep[some], np.array([e[0] for e in edges], np.int64)]), pa.int64()),
                "other": pa.array([None] * len(some) + [e[1] for e in edges], pa.int64()),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)]), pa.int64()),
            }
        )

    out = written(full.groupBy("label", "t", "sig", "i", "j").applyInArrow(compared, "rep bigint, other bigint, links bigint"), "links")
    labels = components(out.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counts = out.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("rep", "copies").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    # by the class, hot or not, each vector gets what its class has; joins that Spark can split
    mapped = vectors.join(classes.select("label", "vec", "rep"), ["label", "vec"]).select("id", "rep").join(known, "rep").select("id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("component"))
    taken = mapped.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return mine.select("id").join(taken, "id", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))
