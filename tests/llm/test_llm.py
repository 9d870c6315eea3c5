"""The training-data operators against brute force, exact round trips and held-out rows, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxlake.llm import ann, bpe, html_text, labelled, line_dedup, minhash, packing, quality, queries, suffix_dedup, toxicity, vector_dedup
from voxlake.llm.common import crc32_text, pieces, table

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts, start)], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


AWKWARD = [None, "", " \n\t ", "a", "a", "x" * 30000, "one two three four five six seven", "One two THREE four five six seven", "é́ ß İ Σς 中文 \U0001f600", "<|endoftext|> and <|startoftext|>", "a b\x85c\x1cd", "don't we'll I'M 12³ ½"]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, repeated rows and ids, and columns whose names the operators use themselves."""
    rows = [(i, t, None, None if i % 3 else "h", None, 1.0, 7, "x") for i, t in enumerate(AWKWARD)] + [(None, "null id text of some words here", None, None, None, None, None, None), (3, "a", "en", "h", 1, 0.0, 0, "y"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", score double, row bigint, run string")


# --- 1: packing


def test_pack_against_tokenizer(spark, documents):
    got = queries.op1_pack(spark, SF).collect()
    model = Tokenizer.from_file(queries.WORD_BPE)
    pieces_of, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces_of[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces_of) == set(documents)
    for i, t in documents.items():
        ids = np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = sorted(pieces_of[i], key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 4096))
        for r in mine:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_every_row_once_and_little_air(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 400, 500)
    bins = packing.fill_bins(lengths, 1000)
    assert sorted(i for b in bins for i in b) == list(range(500)) and max(lengths[b].sum() for b in bins) <= 1000
    assert len(bins) <= -(-lengths.sum() // 1000) + 1
    assert len(packing.fill_bins(np.array([600, 600, 400]), 1000)) == 2


def test_pack_many_levels(spark):
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 97 + 1).alias("length"))
    out = packing.pack(rows, 200, 50).collect()
    fill = defaultdict(int)
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert len(out) == 600 and max(fill.values()) <= 200 and len(fill) <= -(-sum(fill.values()) // 200) + 2
    long = packing.pack(rows.withColumn("length", F.lit(150).cast("bigint")), 200, 50)
    assert long.select("sequence_id").distinct().count() == 600


@pytest.mark.parametrize("most", [packing.BROADCAST_ROWS, 0])
def test_pack_awkward(spark, awkward, monkeypatch, most):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", most)
    model = Tokenizer.from_file(queries.WORD_BPE)
    out = packing.pack_documents(awkward, queries.WORD_BPE, capacity=512).collect()
    text = {i: "" for i in range(len(AWKWARD))} | {i: t or "" for i, t in enumerate(AWKWARD)}
    for i in text:
        ids = [x for r in sorted((r for r in out if r["doc_id"] == i), key=lambda r: (r["piece"])) for x in r["ids"]]
        one = model.encode(text[i], add_special_tokens=False).ids + [1]
        assert ids == one if i != 3 else ids == one * 2
    assert packing.pack_documents(awkward.limit(0), queries.WORD_BPE).count() == 0


# --- 2: MinHash


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (t or "").encode()))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(texts, percent):
    """Smallest id reachable, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_query(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op2_minhash(spark, SF).collect()}
    assert got == linked(documents, 85)


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """A group of edited copies, in which most lists are long: leaders and cells find what all pairs find."""
    rng = random.Random(4)
    words = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        copy = list(words)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(f"y{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "CELL", 512)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs_of(spark, texts), 85).collect()}
    assert got == linked(dict(enumerate(texts)), 85)


def test_near_duplicates_awkward(spark, awkward):
    out = minhash.near_duplicates(awkward)
    rows = out.collect()
    assert len(rows) == len(AWKWARD) + 3
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[0]["kept"] and by[2]["component_id"] == 2
    assert by[4]["component_id"] == 3 and not by[4]["kept"] and by[7]["component_id"] == 6
    assert minhash.near_duplicates(awkward.limit(0)).count() == 0


# --- 3 and 4: classifiers


def auc(score, truth):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    ones = truth.sum()
    return (rank[truth == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(truth) - ones))


@pytest.mark.parametrize("name, label, least", [("op3_toxicity", "toxic", 0.85), ("op4_quality", "quality", 0.95)])
def test_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    rows = queries.QUERIES[name](spark, sf).collect()
    folds, held = (3, 1) if label == "toxic" else (5, 0)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.7 if label == "toxic" else 0.3)) for r in rows)
    mine = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc(np.array([r["score"] for r in mine]), np.array([truth[r["doc_id"]] for r in mine])) >= least


def test_classifiers_awkward(spark, awkward):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 1), (None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int")
    two = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(5, 0, 0)], "doc_id bigint, quality int, toxic int")
    for kind in (toxicity, quality):
        for labels in (none, one, two):
            out = kind.score(awkward, kind.fit(awkward, labels, F.lit(True)))
            rows = out.collect()
            assert len(rows) == len(AWKWARD) + 3 and all(0 <= r["score"] <= 1 for r in rows)
            assert sorted(out.columns) == sorted(awkward.columns)
        assert kind.score(awkward.limit(0), kind.fit(awkward, none, F.lit(True))).count() == 0


def test_machine_learns_a_pair():
    """Two terms that mean something only together: no sum of weights tells these texts apart."""
    rng = np.random.default_rng(0)
    sets, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        sets.append(np.array(sorted({10 + 10 * int(a), 50 + 10 * int(b), 1000 + int(rng.integers(0, 50))}), np.uint32).tobytes())
        y.append(int(a == 1 and b == 1))
    machine = toxicity.fit_machine(sets, np.array(y), {0: y.count(0), 1: y.count(1)})
    assert (machine.place[[20, 60]] >= 0).all() and machine.factor.shape[1] == toxicity.FACTORS
    score = lambda t: toxicity.sigmoid(machine.margin(machine.place[t].astype(int), np.zeros(len(t), int), 1))[0]
    assert score([20, 60]) > 0.7 and max(score([20]), score([60])) < 0.3


def test_sample_is_bounded_and_of_its_fold(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    chosen, counts = labelled.sample(labels, "toxic", crc32_text("doc_id") % 3 != 1, {0: 5, 1: 7})
    rows = chosen.collect()
    assert len(rows) == 12 and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in rows) and sum(counts.values()) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(100))


# --- 5: suffix dedup


def removed(texts, length=50):
    """(kept bytes, removed, spans) by looking every string up."""
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            first.setdefault(texts[i][p : p + length], i)
    out = {}
    for i, t in texts.items():
        flags = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                flags[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        out[i] = (bytes(np.frombuffer(t, np.uint8)[~flags]), int(flags.sum()), spans)
    return out


def test_substrings_query(spark, documents):
    want = removed({i: (t or "").encode() for i, t in documents.items()})
    got = {r["doc_id"]: r for r in queries.op5_suffix_dedup(spark, SF).collect()}
    assert {i: (hashlib.sha256(k).hexdigest(), n, s) for i, (k, n, s) in want.items()} == {i: (r["kept_sha256"], r["n_removed"], r["n_spans"]) for i, r in got.items()}


@pytest.mark.parametrize("seed", range(3))
def test_substrings_of_low_entropy(spark, seed):
    """Few letters, long runs and shared passages, in small runs and a shorter length."""
    rng = random.Random(seed)
    passage = "".join(rng.choice("ab") for _ in range(60))
    texts = []
    for _ in range(40):
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        if rng.random() < 0.5:
            t = t[:20] + passage[rng.randrange(20) :] + t[20:]
        texts.append(t + "z" * rng.randrange(0, 70) + "é" * rng.randrange(0, 3))
    for length in (50, 20):
        want = removed({i: t.encode() for i, t in enumerate(texts)}, length)
        got = suffix_dedup.dedup_substrings(docs_of(spark, texts), length, run_bytes=700).collect()
        assert {r["doc_id"]: (bytes(r["kept"]), r["n_removed"], r["n_spans"]) for r in got} == want
        assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_loser_tree():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))).encode() for _ in range(rng.randrange(0, 30))) for _ in range(k)]
        shared = [bytes([0, *[suffix_dedup._common(a, b, 0) for a, b in zip(r, r[1:], strict=False)]]) if r else b"" for r in runs]
        order, common = suffix_dedup.merge_runs(runs, shared)
        at, out = [0] * k, []
        for r in order:
            out.append(runs[r][at[r]])
            at[r] += 1
        assert out == sorted(x for r in runs for x in r)
        assert common[1:] == [suffix_dedup._common(a, b, 0) for a, b in zip(out, out[1:], strict=False)]
    v = np.array(sorted(rng.sample(range(1 << 26), 500)))
    assert (suffix_dedup.gap_decoded(suffix_dedup.gap_coded(v)) == v).all()


def test_substrings_awkward(spark, awkward):
    rows = suffix_dedup.dedup_substrings(awkward, 50, carry=["lang", "score", "run"]).collect()
    assert len(rows) == len(AWKWARD) + 3 and all(r["n_removed"] == 0 for r in rows) and {r["rest"]["run"] for r in rows} == {"x", "y", None}
    assert suffix_dedup.dedup_substrings(awkward.limit(0)).count() == 0


# --- 6: BPE


def test_bpe_is_the_librarys(spark, documents):
    model = Tokenizer.from_file(queries.BYTE_BPE)
    for r in queries.op6_bpe(spark, SF).collect():
        ids = model.encode(documents[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_random_text():
    model, codec = Tokenizer.from_file(queries.BYTE_BPE), bpe.ByteCodec(queries.BYTE_BPE)
    rng = random.Random(0)
    bits = [*"ab c'sdtre\n\t 中é\U0001f600०9.,!", "<|endoftext|>", "  ", "don't", "'ll", "‍", "́", "aaaaaaaaaaaaaaaa", "--------", "\r\n", "\x1c", "\x85", "　", "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        ids = model.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids and codec.decode(np.array(ids, np.int64)) == model.decode(ids, skip_special_tokens=False)


def test_bpe_awkward_and_round_trip(spark, awkward):
    coded = bpe.encode(awkward, queries.BYTE_BPE)
    back = bpe.decode(coded, queries.BYTE_BPE).collect()
    assert sorted(r["text"] for r in back) == sorted([t or "" for t in AWKWARD] + ["null id text of some words here", "a", ""])
    assert bpe.encode(awkward.limit(0), queries.BYTE_BPE).count() == 0


# --- 7: HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article class="post"><header><h1>Head &amp; line</h1></header><p><b>One<br>two&nbsp;three &#233;</b><p>Next
  block<ul><li>item 1<li>item 2</ul><div class="ad">Buy</div><form><p>Mail</p></form><pre>a  b</pre><table><tr><td>c1<td>c2</table></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><aside>Side</aside><footer>Foot</footer></body></html>"""


def test_html_blocks():
    text = html_text.main_text(html_text.blocks(PAGE), set())
    assert text == "Head & line\n\nOne two three é\n\nNext block\n\nitem 1\n\nitem 2\n\na b\n\nc1\n\nc2"
    for bad in (None, "", "<", "<p", "<!--", "<p>a<", "</p></div>", "<script>x", "a &amp b &#xZ; <b", "<![CDATA[x]]>", "<p>" * 2000 + "x"):
        html_text.blocks(bad)
    assert html_text.place("https://www.a.com/x/y/?q=1#z") == ("a.com", "/x/y") and html_text.place("http://[bad")[0] is None and html_text.place(None)[0] is None


def test_shared_blocks_is_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 9)), rng.integers(0, 4, rng.integers(0, 9))
        size = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
        assert html_text.shared_blocks(a, b).sum() == size[-1, -1]


def test_shared_blocks_of_large_pages():
    rng = np.random.default_rng(5)
    x = rng.permutation(40000)
    mine, other = x.copy(), x.copy()
    mine[rng.choice(40000, 400, replace=False)] = 10**6 + np.arange(400)
    assert html_text.shared_blocks(mine, other).sum() == 40000 - 400
    a, b = rng.integers(0, 40, 600), rng.integers(0, 40, 500)
    size = np.zeros((601, 501), int)
    for i in range(600):
        for j in range(500):
            size[i + 1, j + 1] = size[i, j] + 1 if a[i] == b[j] else max(size[i, j + 1], size[i + 1, j])
    hit = html_text.shared_blocks(a, b)
    rest = iter(b)
    assert hit.sum() == size[-1, -1] and all(any(x == y for y in rest) for x in a[hit])


@pytest.mark.parametrize("bad", ["<a ", "<" + "a" * 10, "<div>", "<b>", '<a "', "<a '>", "<", "<p>", "<li>", "<!", "<script>", "</div>", "&#9", "<p class='x"])
def test_malformed_pages_of_a_megabyte_are_read_at_once(bad):
    import time

    began = time.perf_counter()
    html_text.blocks(bad * (1_000_000 // len(bad)))
    html_text.blocks("<p>" + bad * (200_000 // len(bad)) + ">")
    assert time.perf_counter() - began < 5
    assert html_text.blocks("&#" + "9" * 5000 + ";&#" + "0" * 5000 + "65;") == [(html_text.OPEN, "\ufffdA")]
    assert html_text.blocks('<p title="a > b">x</p><a href="y>z</a>') == [(html_text.OPEN, "x"), (html_text.OPEN, "z")]


def test_neighbours_across_partitions(spark, monkeypatch):
    """Borders between partitions: one page a partition, the host's furniture still goes."""
    monkeypatch.setattr(html_text, "stored_bytes", lambda df: 40 * (8 << 20))
    rows = [(i, f"http://h.example/a/{i:03}", f"<div>Welcome</div><p>story {i}</p><div>Rights</div>") for i in range(40)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: f"story {i}" for i in range(40)}


def test_differencing_drops_what_neighbours_share(spark):
    page = lambda body: f"<html><body><div>Welcome to our site</div><p>{body}</p><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://h.example/a/{i}", page(f"story {i}")) for i in range(6)] + [(10, "http://alone.example/", page("lonely")), (11, None, page("nowhere")), (12, "http://h.example/a/3", None), (12, "http://h.example/a/3", None), (None, "http://h.example/b", page("x"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("page", F.lit("clash"))
    got = defaultdict(list)
    for r in html_text.extract(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert all(got[i] == [f"story {i}"] for i in (0, 1, 5)) and got[10] == ["Welcome to our site\n\nlonely\n\nAll rights reserved"] and got[12] == ["", ""] and len(got[11]) == 1
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_query(spark):
    import html

    got = {r["page_id"]: r["text"] for r in queries.op7_html_text(spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        plain = [re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(x for x in plain if x)


# --- 8 and 9: vectors


def vectors_of(spark, name="embeddings"):
    return {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in table(spark, SF, name).collect()}


def test_nearest_neighbours_recall(spark):
    mine = vectors_of(spark)
    asks = [i for i in mine if i % 20 == 0]
    want = defaultdict(dict)
    for q, _, i, s in ann.nearest_exact({i: v for i, (v, _) in mine.items()}, asks, 20):
        want[q][i] = s
    got = defaultdict(list)
    for r in queries.op8_ann(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in asks:
        assert [k for k, _, _ in got[q]] == list(range(1, 21)) and all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got[q], got[q][1:], strict=False))
        assert all(s == pytest.approx(float(mine[q][0] @ mine[i][0]), abs=1e-12) and i != q for _, i, s in got[q])
        hits += sum(i in want[q] for _, i, _ in got[q])
    assert hits >= 0.9 * 20 * len(asks)


def test_nearest_by_inner_product_with_norms_and_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.5, 3)).tolist()) for i in range(300)] + [(1000, None), (1001, [0.0] * 6), (1002, [None] + [1.0] * 5), (1003, [float("nan")] * 6), (1004, [1.0]), (None, [1.0] * 6), (1005, [2.0] * 6), (1006, [2.0] * 6), (1005, [2.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("asks", F.lit("clash"))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()
    valid = {i: v for i, v in rows if i is not None and (i < 1000 or i in (1005, 1006))}
    want = {(q, i) for q, _, i, _ in ann.nearest_exact(valid, [i for i in valid if i % 20 == 0], 5)}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)
    few = ann.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, 5).collect()
    assert {r["vec_id"] for r in few} == {1, 2}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_neighbours_touch():
    from voxlake.llm.hilbert import hilbert_keys

    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512)) and np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * 0.12 * (i % 4)).tolist(), i % 2 if i % 11 else None) for i in range(240)] + [(500, base[0].tolist(), 0), (501, base[0].tolist(), 0), (502, (base[0] * 3).tolist(), 0), (503, None, 0), (504, [0.0] * 16, 0), (505, [None] * 16, 0), (506, [float("inf")] * 16, 0), (507, [1.0], 0), (None, base[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("rep", F.lit(1))
    monkeypatch.setattr(vector_dedup, "CELL", 16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicate_vectors(df, 0.98).collect()}
    ok = [(i, np.array(v, float) / np.linalg.norm(v), k) for i, v, k in rows if i is not None and k is not None and (i < 500 or i in (500, 501, 502))]
    least, links = {i: i for i, _, _ in rows if i is not None}, defaultdict(int)

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    for n, (i, u, k) in enumerate(ok):
        for j, v, m in ok[n + 1 :]:
            if k == m and u @ v >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                least[max(a, b)] = min(a, b)
    assert {i: (links[i], find(i), find(i) == i) for i in least} == {i: g for i, g in got.items() if i is not None}
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


# --- 10: lines


def test_line_dedup_query_against_duckdb(spark, duck):
    got = queries.op10_line_dedup(spark, SF)
    want = duck.sql(queries.OP10_SQL)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_line_dedup_cases(spark, awkward):
    rows = [(i, f"menu\nown line {i}\nmenu\n \n \nend", "en", "big", None) for i in range(20)] + [(100 + i, "menu\nx", "en", "small", None) for i in range(4)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), "source").collect()}
    assert out[3]["text"] == "own line 3\n \n " and out[3]["n_dropped"] == 3 and out[3]["n_lines"] == 6
    assert out[100]["text"] == "menu\nx"
    kept = line_dedup.dedup_lines(awkward.withColumn("n_lines", F.lit(5)), "source").collect()
    assert len(kept) == len(AWKWARD) + 3 and [r for r in kept if r["doc_id"] == 0][0]["text"] is None
    assert line_dedup.dedup_lines(awkward.limit(0), "source").count() == 0
    odd = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(("_host", "_lines", "_kept", "_common", "_rest", "_text", "_hashes")):
        odd = odd.withColumn(name, F.lit(i))
    clashing = line_dedup.dedup_lines(odd, "source")
    assert clashing.columns == [c for c in odd.columns if c != "text"] + ["text", "n_lines", "n_dropped"]
    assert all([r[c] for c in ("_host", "_lines", "_kept", "_common", "_rest", "_text", "_hashes")] == list(range(7)) for r in clashing.collect())
    assert {r["doc_id"]: r["text"] for r in clashing.collect()} == {i: r["text"] for i, r in out.items()}


def test_copies_of_a_document_keep_its_lines(spark):
    """A third of a source is one document: the pipeline keeps it whole, once, and still drops the source's menu."""
    import corpus_pipeline as p

    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ale", "ino", "ort", "ush")]
    rng = random.Random(3)
    own = lambda: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(4))
    copied = own()
    rows = [(i, copied if i % 3 == 0 else f"menu of the site\n{own()}", "en", "big", None) for i in range(60)] + [(100 + i, copied if i < 4 else own(), "en", "small", None) for i in range(14)]
    df = p.written(p.drop_boilerplate(spark, spark.createDataFrame(rows, DOCS), SF), "t")
    lines = {r["doc_id"]: r["text"] for r in df.collect()}
    assert lines == {i: t.removeprefix("menu of the site\n") for i, t, _, _, _ in rows}
    kept = p.drop_near_duplicates(spark, df, SF).collect()
    assert [r["text"] for r in kept].count(copied) == 1 and len(kept) == 1 + 40 + 10


def test_line_dedup_uses_no_python(spark):
    plan = queries.op10_line_dedup(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- pipeline


def test_pipeline_against_a_plain_one(spark):
    """Each stage on its predecessor's rows: what it keeps and how it changes texts, by plain Python."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    read = lambda df: {r["doc_id"]: r for r in df.collect()}
    stages = dict(p.STAGES)
    before = read(docs)
    df = p.written(stages["quality_classifier"](spark, docs, sf), "t")
    scores = read(queries.op4_quality(spark, sf))
    assert set(read(df)) == {i for i in before if scores[i]["score"] >= p.LEAST_QUALITY} and df.columns == docs.columns
    kept = read(df)
    df = p.written(stages["line_dedup"](spark, df, sf), "t")
    pages, hosts = defaultdict(set), defaultdict(int)
    for i, r in kept.items():
        hosts[r["source"]] += 1
        for line in (r["text"] or "").split("\n"):
            pages[r["source"], line].add(i)
    lines = read(df)
    for i, r in kept.items():
        drop = lambda x: x.strip(" ") and hosts[r["source"]] >= line_dedup.MIN_HOST_PAGES and len(pages[r["source"], x]) >= line_dedup.MIN_PAGES and len(pages[r["source"], x]) > hosts[r["source"]] * line_dedup.RATIO  # noqa: E731, B023
        assert lines[i]["text"] == "\n".join(x for x in r["text"].split("\n") if not drop(x)) and lines[i]["n_chars"] == len(lines[i]["text"])
    df = p.written(stages["minhash_near_dedup"](spark, df, sf), "t")
    want = {i for i, (_, c) in linked({i: r["text"] for i, r in lines.items()}, p.SIMILARITY).items() if c == i}
    single = read(df)
    assert set(single) == want and all(single[i] == lines[i] for i in want)
    df = p.written(stages["suffix_array_dedup"](spark, df, sf), "t")
    cut = removed({i: r["text"].encode() for i, r in single.items()})
    last = read(df)
    assert {i: r["text"] for i, r in last.items()} == {i: k.decode("utf-8", "ignore") for i, (k, _, _) in cut.items()} and df.columns == docs.columns
    packed = stages["best_fit_packing"](spark, df, sf).collect()
    model = Tokenizer.from_file(queries.WORD_BPE)
    ids = defaultdict(list)
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["piece"])):
        ids[r["doc_id"]] += r["ids"]
    assert dict(ids) == {i: model.encode(r["text"], add_special_tokens=False).ids + [1] for i, r in last.items()}
    assert p.ORACLE_SQL is None and len(p.STAGES) == 5


def test_pipeline_stages_awkward(spark, awkward):
    import corpus_pipeline as p

    df = awkward
    for name, stage in p.STAGES[:4]:
        df = p.written(stage(spark, df, SF), name)
        assert df.columns == awkward.columns
    assert p.STAGES[4][1](spark, df, SF).count() >= df.count() > 0
    empty = awkward.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pieces_cover_all_rows():
    offsets = np.array([0, 3, 3, 10, 11, 11])
    assert [(i, j) for i, j, _, _ in pieces(np.zeros(11, np.uint8), offsets, 4)] == [(0, 2), (2, 3), (3, 5)]
    assert public_tokenizers.path("byte_bpe_50k.json") == queries.BYTE_BPE
