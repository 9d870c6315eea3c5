"""Centroid clustering and passage dedup against plain versions, and on awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF
from test_catalog import plain

from voxlake.llm import centroids, queries, rlz_dedup
from voxlake.llm.common import table

SHA: rlz_dedup.Derive = {"kept_sha256": ("string", lambda kept, spans: hashlib.sha256(kept).hexdigest())}


def same_as_sql(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    left = sorted((tuple(plain(v) for v in r) for r in got.collect()), key=repr)
    assert left == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_centroids", "op12_rlz_dedup"])
def test_query_against_duckdb(spark, duck, name):
    same_as_sql(queries.QUERIES[name](spark, SF), duck.sql(queries.SQL[name]))


# --- 11: centroid clustering


def plain_clusters(rows, width=64, k=16, rounds=3, scale=64):
    """Python's integers throughout."""
    kept = [(i, tuple(math.floor(Fraction(x) * scale) for x in v)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    at = [list(v) for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(at)), key=lambda c: (far(v, at[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v), []).append(v)
        for c, vs in groups.items():
            at[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = []
    for i, v in kept:
        c = near(v)
        out.append((i, c, far(v, at[c]), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()))
    return out


def held_against_plain(spark, rows, **how):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = centroids.clusters(frame, **how).collect()
    want = plain_clusters(rows, **{k: v for k, v in how.items() if k != "salt"})
    long = lambda n: n if n <= 2**63 - 1 else None
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got), key=repr) == sorted(((i, c, long(d), s) for i, c, d, s in want), key=repr)
    for r in got:
        assert r["cluster_inertia"] == long(sum(d for _, c, d, _ in want if c == r["cluster"])) or any(d > 2**63 - 1 for *_, d, _ in want)
    return got


def test_clusters_of_random_and_close_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    held_against_plain(spark, rows)
    # lattice points and repeated vectors: ties everywhere, which only exact distances can settle
    rows = [(i, rng.integers(-1, 2, 64).astype(float).tolist()) for i in range(150)] + [(1000 + i, [0.5] * 64) for i in range(60)]
    held_against_plain(spark, rows)


def test_clusters_with_components_beyond_float32_and_longs(spark):
    rng = np.random.default_rng(4)
    big = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 30)).tolist()) for i in range(80)]
    rest = [(100 + i, (2.0**20 + rng.normal(size=64) * 1e-3).tolist()) for i in range(60)]  # float32 can't tell these apart
    held_against_plain(spark, big + rest)
    held_against_plain(spark, rest)
    got = held_against_plain(spark, [(1, [1.7e308] * 64), (2, [-1.7e308] * 64), (3, [5e-324] * 64), (4, [-5e-324] * 64), (5, [0.0] * 64)], k=2)
    assert {r["vec_id"]: r["distance"] for r in got}[1] in (0, None)


def test_clusters_on_awkward_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [1.0] * 63 + [None]), (6, [1.0] * 63 + [float("nan")]), (7, [float("inf")] + [0.0] * 63), (8, [0.0] * 64), (8, [0.0] * 64), (8, [2.0] * 64), (None, [1.0] * 64), (9, [1.0] * 64)]
    got = held_against_plain(spark, rows)
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 8, 8, 8, 9]
    clash = spark.createDataFrame([(1, [1.0] * 64, 5, "x", "y")], "vec_id bigint, embedding array<double>, cluster int, id string, q string")
    assert centroids.clusters(clash).collect()[0]["cluster"] == 0
    assert centroids.clusters(clash.limit(0)).count() == 0
    assert centroids.clusters(spark.createDataFrame([(None, [1.0] * 64)], "vec_id bigint, embedding array<double>")).collect()[0]["cluster"] is None


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(5)
    for spread in (1, 100, 2**26):
        values = rng.integers(-spread, spread + 1, (16, 64)).tolist()
        c = centroids.Centroids(values)
        q = np.concatenate([rng.integers(-spread, spread + 1, (200, 64)), np.array(values)]).astype(np.int32)
        exact = np.array([[c.exact(v, j) for j in range(16)] for v in q.tolist()], object)
        assert all(c.shortlist(q)[i, j] for i, j in enumerate(exact.argmin(axis=1)))
        assert c.nearest(q).tolist() == exact.argmin(axis=1).tolist()


# --- 12: passages


def plain_passages(texts, length):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def passages_of(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rlz_dedup.dedup_passages(frame, how.pop("length", 35), SHA, **how).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("length,hot", [(35, 4096), (35, 2), (6, 4096), (6, 3), (1, 4096)])
def test_passages_against_brute_force(spark, length, hot):
    rng = random.Random(length * 10 + hot)
    base = [[f"w{rng.randrange(30)}" for _ in range(300)] for _ in range(4)]
    texts = [None, "", " \n", "a " * 300, "word"]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                b, i = rng.choice(base), rng.randrange(300)
                words += b[i : i + rng.randrange(1, 3 * length + 2)]
            else:
                words += [f"{rng.randrange(2000)}é" for _ in range(rng.randrange(30))]
        texts.append(rng.choice([" ", "\n", " \t\x0b\r"]).join(words))
    assert passages_of(spark, texts, length=length, hot=hot, run_bytes=2000) == plain_passages(texts, length)


def test_passages_across_factor_boundaries():
    """A's two halves stand in different passages; the window over the border is in a third."""
    length = 7
    before = length - rlz_dedup.anchor_words(length)
    width = before + length
    a = np.arange(1, width + 1)
    left, right, over = a.copy(), a.copy(), a.copy()
    left[length:] += 100
    right[: width - length] += 200
    over[:1] += 300
    over[-1:] += 400
    rows = np.array([a, left, right, over], np.int32)
    got = rlz_dedup.factored(rows, np.zeros(4, bool), length)
    windows = [[tuple(r[s : s + length]) for s in range(before + 1)] for r in rows.tolist()]
    seen = Counter(w for ws in windows for w in ws)
    assert got.tolist() == [[seen[w] > 1 for w in ws] for ws in windows]


def test_passages_of_copies_and_a_phrase_everywhere(spark):
    """Half of the documents are one text; a phrase shorter than a window stands in all others and must stay."""
    rng = random.Random(8)
    copy = " ".join(f"c{rng.randrange(500)}" for _ in range(80))
    phrase = " ".join(f"license{i}" for i in range(30))
    texts = [copy] * 60 + [f"{' '.join(f'x{rng.random()}' for _ in range(20))} {phrase} {' '.join(f'y{rng.random()}' for _ in range(20))}" for _ in range(60)]
    got = passages_of(spark, texts, run_bytes=3000, hot=10)
    assert got == plain_passages(texts, 35)
    assert all(r[1] == 80 for r in got[:60]) and all(r[1] == 0 for r in got[60:])


def test_passages_of_a_very_long_text(spark):
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(50)]
    long = [f"l{rng.randrange(10**6)}" for _ in range(300_000)]
    long[1000:1050] = long[200_000:200_050] = passage
    texts = [" ".join(long), " ".join(["z", *passage[:34]]), "b " * 1_000_000]
    assert passages_of(spark, texts) == plain_passages(texts, 35)
    assert passages_of(spark, texts)[0][1] == 100


def test_passages_on_awkward_rows(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, same, "x", 3), (1, same, "x", 3), (None, same + " tail", None, None), (None, None, None, None), (2, "short text", "run", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, run string, n_words bigint")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in rlz_dedup.dedup_passages(frame).collect()), key=repr)
    assert got == sorted([(1, 40, 40, b""), (1, 40, 40, b""), (None, 41, 40, b"tail"), (None, 0, 0, b""), (2, 2, 0, b"short text")], key=repr)
    assert rlz_dedup.dedup_passages(frame.limit(0)).count() == 0


def test_passages_keep_spans(spark):
    frame = spark.createDataFrame([(1, "a b c d x"), (2, "y b c d")], "doc_id bigint, text string")
    got = {r["doc_id"]: (bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in rlz_dedup.dedup_passages(frame, 3).collect()}
    assert got == {1: (b"a x", [(1, 4)]), 2: (b"y", [(1, 4)])}


def test_documents_whole(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op12_rlz_dedup(spark, SF).collect()}
    assert [got[d["doc_id"]] for d in docs] == plain_passages([d["text"] for d in docs], 35)
