"""Near-duplicate documents: word shingles, MinHash signatures and a signature-coordinate inverted join.

Every document has the set of its distinct w-word shingles. Documents with equal sets are one class at once. Of each
class one signature of K minima is posted under its (coordinate, value) pairs. A pair of classes is a candidate if at
least `min_matches` coordinates agree. Prefix merging: with the values in order of rarity, such a pair shares one of
the first K - min_matches + 1, so only those are posted, and values seen once, which come first, post nothing. Skip
merging: the lists are not counted through; a pair that meets in one, and whose sets are of sizes that can link, is
compared on longer signatures of a byte a coordinate and given up below their threshold. Candidates are confirmed on
the full sets.

Lists with as many members as a third of all rows are no special case. The members of a list are first compared with a
leader (long lists: a few), the first by a hash of the document, so that the lists of a group share theirs; what is
linked is joined. Lists of over LONG members take more rounds of that. A list that still holds several components is
finished exactly: of up to SMALL members, all pairs between components are compared, each pair once; in longer ones
every member outside the commonest component meets all members in cells of bounded size, where intersections are counted through an
inverted list of the cell's shingles and only a spanning set of the links comes out. So no group is expanded into its
pairs, and a pair goes uncompared only if it is in one component already.

Null texts and texts without words have no shingles and link with nothing; texts shorter than w words are one shingle.
Links are exact on 64-bit shingle hashes. Rows with equal doc_id count as the same document. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import by_ids, dropped, in_small_batches, lowered, mix, pieces, prefix_hash, span_hash, string_buffers, trimmed, word_spans, written
from voxlake.llm.components import components

WORDS = 5
COORDINATES = 64
#: Bytes of the longer signatures, and how many standard deviations below their mean agreements a threshold is set.
BRIEF, POST_SPREAD, BRIEF_SPREAD = 128, 5.0, 4.2
#: Lists of over SMALL members have LEADERS leaders, over LONG in up to ROUNDS rounds.
SMALL, LONG, LEADERS, ROUNDS = 16, 4096, 4, 4
#: Shingles on either side of a cell.
CELL = 1 << 16

_RNG = np.random.default_rng(77)
_TURNS = _RNG.integers(1, 2**62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = (_RNG.integers(0, 2**31, 1024, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, 1024, dtype=np.uint32)


def least_matches(percent: int, coordinates: int, spread: float) -> int:
    """Agreements that a pair at the similarity stays under once in some ten thousand times (spread 4.2) or million (5)."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - spread * math.sqrt(coordinates * p * (1 - p))))


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all rows, sorted within each row, and the n + 1 offsets of the rows."""
    data = lowered(raw)
    starts, ends, rows = word_spans(data, offsets)
    n = len(offsets) - 1
    prefix = prefix_hash(data)
    each = span_hash(prefix, starts, ends)
    counts = np.bincount(rows, minlength=n)
    first = np.cumsum(counts) - counts
    at = np.arange(len(each))
    full = at + words <= (first + counts)[rows]  # a shingle of `words` words starts here
    short = (counts[rows] < words) & (at == first[rows])
    out = np.zeros(len(each), np.uint64)
    for k in range(words):
        inside = at + k < (first + counts)[rows]
        out[inside] += each[at[inside] + k] * _TURNS[k]
    out = mix(out + np.where(short, counts[rows], words).astype(np.uint64))
    take = full | short
    value, row = out[take], rows[take]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    sizes = np.bincount(row, minlength=n)
    return value, np.concatenate([[0], np.cumsum(sizes)])


def signatures(value: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """(rows with shingles, coordinates) minima of 32 bits; rows without shingles are left out."""
    filled = np.flatnonzero(np.diff(offsets))
    low = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(filled), coordinates), np.uint32)
    if len(filled):
        for k in range(coordinates):
            np.minimum.reduceat(low * _SCALE[k] + _SHIFT[k], offsets[filled], out=out[:, k])
    return out


def signed(docs: DataFrame, words: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, digest (128 bits of the set; null without shingles), signature (uint32 minima) and brief (a byte each of BRIEF minima) of each text."""
    fields = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary()), ("brief", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for i, j, part, at in pieces(raw, offsets):
                value, ends = shingle_hashes(part, at, words)
                sizes = np.diff(ends)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ _TURNS[8 + k]))]) for k in range(2)]
                both = np.stack([s[ends[1:]] - s[ends[:-1]] for s in sums], axis=1)
                sig = signatures(value, ends, max(coordinates, BRIEF))
                brief = (mix(sig[:, :BRIEF].astype(np.uint64)) >> np.uint64(56)).astype(np.uint8)
                digests, sigs, briefs, k = [None] * (j - i), [None] * (j - i), [None] * (j - i), 0
                for r in np.flatnonzero(sizes).tolist():
                    digests[r], sigs[r], briefs[r] = both[r].tobytes(), sig[k, :coordinates].tobytes(), brief[k].tobytes()
                    k += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(briefs, pa.binary())], schema=pa.schema(fields))
        trimmed()

    return in_small_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, signature binary, brief binary")


def _posts(classes: DataFrame, coordinates: int) -> DataFrame:
    """(rep, key) for every coordinate; key holds the coordinate above the 32-bit value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            raw, at = string_buffers(batch.column(1))
            for i in range(0, len(reps), 2000):
                some = reps[i : i + 2000]
                if len(some):
                    start = int(at[i])
                    keys = raw[start : start + len(some) * coordinates * 4].view(np.uint32).reshape(-1, coordinates).astype(np.int64) | top
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, coordinates), pa.int64()), pa.array(keys.ravel(), pa.int64())], names=["rep", "key"])

    return classes.select("rep", "signature").mapInArrow(run, "rep bigint, key bigint")


def _prefixes(classes: DataFrame, coordinates: int, min_matches: int) -> DataFrame:
    """(key, rep): each class under its rarest values, as many as a pair with enough matches must share one of."""
    posts = _posts(classes, coordinates)
    often = posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    mine = posts.join(often, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("shared"))
    prefix = coordinates - min_matches + 1
    long = F.lit(prefix - coordinates) + F.size("shared")  # the values seen once come first and post nothing
    lists = written(mine.where(long > 0).select("rep", F.explode(F.slice("shared", 1, long)).alias("post")).select("post.key", "rep"), "lists")
    return lists


def _matching(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are of sizes that can link and whose longer signatures agree in enough coordinates."""
    left = classes.select(F.col("rep").alias("a"), F.col("brief").alias("sa"), F.col("n_shingles").alias("na"))
    right = classes.select(F.col("rep").alias("b"), F.col("brief").alias("sb"), F.col("n_shingles").alias("nb"))
    least = least_matches(percent, BRIEF, BRIEF_SPREAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                sides = [string_buffers(batch.column(k)) for k in (2, 3)]
                x, y = (raw[at[0] : at[-1]].reshape(n, -1) for raw, at in sides)
                keep = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return met.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the full shingle sets of `nodes`, sorted uint64 as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for i, j, part, at in pieces(raw, offsets):
                value, ends = shingle_hashes(part, at, words)
                own = pa.array([value[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), own], names=["node", "hashes"])
        trimmed()

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return by_ids(texts, nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi").mapInArrow(run, "node bigint, hashes binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of `pairs` with 100 * intersection >= percent * union of the full sets."""
    full = written(_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, words), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            keep = []
            for p, q in zip(x, y, strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                small, large = min(len(p), len(q)), max(len(p), len(q))
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * small >= percent * large else 0
                keep.append(both > 0 and 100 * both >= percent * (small + large - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = full.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = full.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    out = written(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "confirmed")
    dropped(full)
    return out


def _cell(percent: int):
    """Links of the `asks` rows with all rows of a cell, reduced to a spanning set."""

    def run(frame: pa.Table) -> pa.Table:
        frame = frame.combine_chunks()
        asks = np.array(frame.column("asks"))
        rep, label = np.array(frame.column("rep")), np.array(frame.column("label"))
        raw = [np.frombuffer(x, np.uint64) for x in frame.column("hashes").to_pylist()]
        mine, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        found = []
        if len(mine) and len(theirs):
            value = np.concatenate([raw[i] for i in theirs])
            sizes = np.array([len(raw[i]) for i in theirs])
            order = np.argsort(value, kind="stable")
            value, owner = value[order], np.repeat(np.arange(len(theirs)), sizes)[order]
            for i in mine.tolist():
                lo, hi = np.searchsorted(value, raw[i], "left"), np.searchsorted(value, raw[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(theirs))
                linked = (both > 0) & (100 * both >= percent * (len(raw[i]) + sizes - both)) & (label[theirs] != label[i])
                for j in theirs[linked].tolist():
                    x, y = find(int(label[i])), find(int(label[j]))
                    if x != y:
                        root[x] = y
                        found.append((int(rep[i]), int(rep[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def _finished(member: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between the components of each list of `member` (key, rep, label, top), in cells."""
    full = written(_sets(member.select(F.col("rep").alias("node")), docs, words), "sets")
    sized = member.join(full.select(F.col("node").alias("rep"), (F.length("hashes") / 8).cast("bigint").alias("size")), "rep")
    split = sized.groupBy("key").agg(F.ceil(F.sum("size") / CELL).alias("down"), F.ceil(F.sum(F.when(F.col("label") != F.col("top"), F.col("size")).otherwise(0)) / CELL).alias("across"))
    rows = member.join(split, "key").where("across > 0")
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    theirs = rows.select("key", "rep", "label", F.lit(False).alias("asks"), slot("down").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("across") - 1)).alias("j"))
    mine = rows.where("label <> top").select("key", "rep", "label", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("down") - 1)).alias("i"), slot("across").alias("j"))
    cells = theirs.union(mine).join(full.withColumnRenamed("node", "rep"), "rep")
    out = written(cells.groupBy("key", "i", "j").applyInArrow(_cell(percent), "a bigint, b bigint").where("a is not null"), "confirmed")
    dropped(full)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept (doc_id = component_id) per row of docs."""
    all_rows = written(signed(docs, words, coordinates), "signed")
    by_set = all_rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.first("brief").alias("brief")).where("rep is not null")
    classes = written(by_set, "classes")
    lists = _prefixes(classes, coordinates, least_matches(percent, coordinates, POST_SPREAD))
    links = labels = None

    def joined(found: DataFrame) -> None:
        nonlocal links, labels
        links = found if links is None else links.union(found)
        labels = components(links)

    def opened(least: int) -> DataFrame:
        """(key, rep, label, top, n) of the lists of over `least` members that hold more than one component."""
        if labels is None:
            member = lists.withColumn("label", F.col("rep"))
        else:
            member = lists.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label"))
        by_label = member.groupBy("key", "label").agg(F.count("*").alias("n"))
        state = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"))
        state = state.where((F.col("labels") > 1) & (F.col("n") > least)).select("key", "n", F.col("top.label").alias("top"))
        return written(member.join(state, "key"), "members")

    def compare(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).groupBy("a", "b").agg(F.count("*").alias("lists")).select("a", "b")
        return _confirmed(written(_matching(pairs, classes, percent), "likely"), docs, words, percent)

    for turn in range(ROUNDS):
        member = opened(0 if turn == 0 else LONG)
        if turn and member.limit(1).count() == 0:
            break
        # the first of each hash slot: a partial aggregate, so that long lists stay spread
        first = F.min(F.struct(F.xxhash64("rep", F.lit(turn)).alias("o"), F.col("rep"), F.col("label"))).alias("x")
        slot = F.when(F.col("n") > SMALL, F.pmod(F.xxhash64("rep", F.lit(-1 - turn)), F.lit(LEADERS))).otherwise(0)
        some = member if turn == 0 else member.where("label <> top")
        lead = some.groupBy("key", slot.alias("slot")).agg(first).select("key", F.col("x.rep").alias("lead"), F.col("x.label").alias("lead_label"))
        joined(compare(member.select("key", "rep", "label").join(lead, "key").where("rep <> lead and label <> lead_label")))
    member = opened(0)
    short = member.where(f"n <= {SMALL}").select("key", "rep", "label")
    other = short.select("key", F.col("rep").alias("lead"), F.col("label").alias("lead_label"))
    found = compare(short.join(other, "key").where("rep < lead and label <> lead_label"))
    if member.where(f"n > {SMALL}").limit(1).count():
        found = found.union(_finished(member.where(f"n > {SMALL}"), docs, words, percent))
    joined(found)
    own = F.coalesce("component", "rep", "doc_id")
    out = all_rows.join(classes.select("digest", "rep"), "digest", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
