"""The queries of the two classifiers against plain Python: every pair of terms summed on its own, every word looked up on its own."""

import math
import re

import numpy as np
import pytest
from conftest import SF

from voxlake.llm import quality, queries, toxicity
from voxlake.llm.common import crc32_text, string_buffers, table

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def crc_fold(i, folds):
    import zlib

    return zlib.crc32(str(i).encode()) % folds


def buffers(text):
    import pyarrow as pa

    raw, at = string_buffers(pa.array([text or ""]))
    return raw[at[0] : at[-1]], at - at[0]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_toxicity_query_against_a_sum_over_all_pairs(spark, docs):
    frame = table(spark, SF, "documents").select("doc_id", "text")
    machine = toxicity.fit(frame, table(spark, SF, "labels"), crc32_text("doc_id") % 3 != 1)
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, SF).collect()}
    assert set(got) == set(docs)
    pairs = 0
    for i, text in docs.items():
        bucket, _ = toxicity.terms(*buffers(text))
        mine = sorted({int(machine.place[b]) for b in bucket.tolist()} - {-1})
        margin = machine.bias + sum(machine.weight[t] for t in mine)
        for n, a in enumerate(mine):
            for b in mine[n + 1 :]:
                margin += float(machine.factor[a] @ machine.factor[b])
                pairs += 1
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, margin)))), abs=1e-9)
        assert got[i]["held_out"] == (crc_fold(i, 3) == 1) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
    assert pairs > 0


def test_quality_query_against_a_plain_forward_pass(spark, docs):
    frame = table(spark, SF, "documents").select("doc_id", "text")
    network = quality.fit(frame, table(spark, SF, "labels"), crc32_text("doc_id") % 5 != 0)
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, SF).collect()}
    assert set(got) == set(docs)
    w1, b1, w2, b2 = network.layers
    for i, text in docs.items():
        word, shape, _ = quality.words_and_shapes(*buffers(text))
        assert len(word) == len(WORD.findall((text or "").encode()))
        means = [[sum(float(network.vectors[part][t][d]) for t in tokens.tolist()) / max(1, len(tokens)) for d in range(quality.WIDTH)] for part, tokens in enumerate((word, shape))]
        pooled = [*means[0], *means[1], *(math.sqrt(sum(x * x for x in m)) for m in means)]
        inner = [(x - m) / s for x, m, s in zip(pooled, network.mean, network.scale, strict=True)]
        hidden = [math.tanh(sum(a * w for a, w in zip(inner, w1[:, h], strict=True)) + b1[h]) for h in range(quality.HIDDEN)]
        margin = (sum(a * w for a, w in zip(hidden, w2, strict=True)) + float(b2[0]) + network.shift) / network.temperature
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, margin)))), abs=1e-4)  # vectors are float32
        assert got[i]["held_out"] == (crc_fold(i, 5) == 0) and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    grid = np.geomspace(1 / 64, 64, 193)
    assert grid[0] < network.temperature < grid[-1]
