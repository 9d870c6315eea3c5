"""Texts longer than a piece of work (1 MB), alone and as copies, through the operators on words, bytes and tokens."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import bpe, minhash, packing, quality, queries, suffix_dedup, toxicity
from voxlake.llm.common import PIECE_BYTES


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}é" for _ in range(150_000)]
    long = " ".join(words)
    changed = " ".join(w if i % 97 else "other" for i, w in enumerate(words))
    assert len(long.encode()) > PIECE_BYTES
    return [long, long, changed, "short text of a few words here", "a" * 1_100_000, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).cache()


def test_packing(docs, texts):
    model = Tokenizer.from_file(queries.WORD_BPE)
    got = {}
    for r in packing.pack_documents(docs.where("doc_id in (0, 3, 5)"), queries.WORD_BPE, derive={"ids": ("array<int>", packing.ids_list)}).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["ids"]))
    for i in (0, 3, 5):
        want = model.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert [x for _, ids in sorted(got[i]) for x in ids] == want


def test_near_duplicates(docs):
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, percent=85).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (0, False), 3: (3, True), 4: (4, True), 5: (5, True)}


def test_substrings(docs, texts):
    derive: suffix_dedup.Derive = {"kept_sha256": ("string", lambda kept, spans: hashlib.sha256(kept).hexdigest())}
    got = {r["doc_id"]: r for r in suffix_dedup.dedup_substrings(docs, 50, derive).collect()}
    n = len(texts[0].encode())
    assert (got[0]["n_removed"], got[1]["n_removed"], got[4]["n_removed"]) == (0, n, 0)
    here = {texts[0].encode()[i : i + 50] for i in range(n - 49)}
    mine = texts[2].encode()
    gone = np.zeros(len(mine) + 1, np.int64)
    for i in range(len(mine) - 49):
        if mine[i : i + 50] in here:
            gone[i] += 1
            gone[min(len(mine), i + 50)] -= 1
    kept = np.frombuffer(mine, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes()
    assert got[2]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[2]["n_removed"] == len(mine) - len(kept)


def test_encoding(docs, texts):
    model = Tokenizer.from_file(queries.BYTE_BPE)
    derive: bpe.Derive = {"ids": ("array<int>", lambda codec, ids: ids.tolist())}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs.where("doc_id in (0, 3, 4)"), queries.BYTE_BPE, derive).collect()}
    for i in (0, 3, 4):
        assert got[i] == model.encode(texts[i], add_special_tokens=False).ids


def test_scores_take_the_whole_text(spark, texts):
    """What stands at the very end of a long text counts."""
    tail = texts[0] + " " + "dreadful " * 20_000
    rows = spark.createDataFrame([(0, texts[0]), (1, tail), (2, texts[0]), (3, None), (4, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 140)], "doc_id bigint, quality int, toxic int")
    train = spark.createDataFrame([(i, ("dreadful awful " if i % 2 else "good fine ") * (5 + i % 7)) for i in range(100, 140)], "doc_id bigint, text string")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        machine = module.fit(train, labels, F.col("doc_id") > 0, label)
        got = {r["doc_id"]: r["score"] for r in module.score(rows, machine).collect()}
        assert got[0] == got[2] and got[3] == got[4] and got[1] != got[0] and all(0 <= s <= 1 for s in got.values())
        assert module.score(rows.limit(0), machine).count() == 0


def test_packing_asks_for_words_by_bytes(spark, monkeypatch):
    """A worker holds the words of TEXT_BYTES of texts at a time, however many texts travel together, and one vocabulary."""
    held, asked = [], []

    class Texts:
        def mapInArrow(self, run, schema):
            held.append(run)

    def encode_many(self, texts):
        asked.append(texts)
        return (b"" for _ in texts)

    monkeypatch.setattr(packing, "in_small_batches", lambda *_: Texts())
    monkeypatch.setattr(packing.WordCodec, "encode_many", encode_many)
    packing.token_pieces(spark.createDataFrame([], "doc_id bigint, text string"), queries.WORD_BPE)
    texts = ["word " * 1000] * 600 + ["b" * 300_000, None, ""]
    out = list(held[0]([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})]))
    assert [t for some in asked for t in some] == [t or "" for t in texts] and sum(b.num_rows for b in out) == len(texts)
    assert all(len(some) == 1 or sum(map(len, some)) <= 1 << 18 for some in asked)
    model = packing.word_codec(queries.WORD_BPE)
    assert model.words.get_vocab_size() == model.model.get_vocab_size(with_added_tokens=False)
