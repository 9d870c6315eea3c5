"""Vector search and near-dedup: complete at every small size, for every width, with repeated ids; brute force of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import ann, vector_dedup

ROWS = "vec_id bigint, embedding array<double>, label int"


def brute_nearest(rows, asks, k):
    """Plain Python: per query id the best score of every other id."""
    out = {}
    for q, v in rows:
        if asks(q):
            for i, w in rows:
                if i != q and len(w) == len(v):
                    s = float((np.array(w) * np.array(v)).sum())
                    best = out.setdefault(q, {})
                    best[i] = max(best.get(i, -np.inf), s)
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in out.items()}


def found(spark, rows, asks, k):
    frame = spark.createDataFrame([(i, list(map(float, v)), 0) for i, v in rows], ROWS).repartition(3)
    got = {}
    for r in ann.nearest(frame, asks, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    out = {}
    for q, rs in got.items():
        rs.sort()
        assert [r[0] for r in rs] == list(range(1, len(rs) + 1))
        out[q] = [r[1:] for r in rs]
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 21, 40, 100])
def test_every_query_gets_as_many_as_there_are(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16)) for i in range(n)]
    got, want = found(spark, rows, F.lit(True), 20), brute_nearest(rows, lambda q: True, 20)
    assert {q: len(r) for q, r in got.items()} == {q: min(20, n - 1) for q in (range(n) if n > 1 else ())}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    if n <= 21:
        assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}


def test_each_width_is_searched_apart(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8)) for i in range(10)] + [(100 + i, rng.normal(size=3)) for i in range(4)] + [(200, rng.normal(size=5))]
    got, want = found(spark, rows, F.lit(True), 20), brute_nearest(rows, lambda q: True, 20)
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}
    assert len(got[100]) == 3 and 200 not in got


def test_repeated_ids_take_no_places(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6)) for i in range(12)] + [(50, np.ones(6) * 9)] * 30 + [(51, rng.normal(size=6)), (51, np.ones(4)), (52, np.ones(4) * 2)]
    got, want = found(spark, rows, F.lit(True), 14), brute_nearest(rows, lambda q: True, 14)  # all 14 others
    assert {q: [i for _, i in r] for q, r in got.items()} == {q: [i for _, i in r] for q, r in want.items()}


def test_more_ranges_for_more_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4)) for i in range(600)]
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in rows], ROWS)
    got = ann.nearest(frame, F.col("vec_id") % 20 == 0, 5, segments=300).collect()
    want = brute_nearest(rows, lambda q: q % 20 == 0, 5)
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert len(got) == 30 * 5 and hits >= 0.9 * len(got)


def test_links_within_every_width(spark):
    rows = [(i, [1.0] * 8, 1) for i in range(10)] + [(20, [1.0, 2.0, 3.0], 1), (21, [2.0, 4.0, 6.0], 1), (22, [1.0, 2.0, 3.0], 2), (23, [3.0, 0.0, 0.0], 1), (30, [5.0], 1), (31, [-5.0], 1), (32, [7.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicate_vectors(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {i: (9, 0) for i in range(10)} | {20: (1, 20), 21: (1, 20), 22: (0, 22), 23: (0, 23), 30: (1, 30), 31: (0, 31), 32: (1, 30)}
