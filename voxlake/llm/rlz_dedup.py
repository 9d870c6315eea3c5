"""Substring dedup by relative Lempel-Ziv parsing: words in passages that stand anywhere else go, in every copy.

A word goes if a window of `length` consecutive words that covers it also starts elsewhere, in its document or another.

1. Documents are dealt to runs of some MB by a hash of the row. Of the K-word strings in any window the one with the
   least hash is its anchor, so that equal windows have equal anchors at the same place. Each run counts short prints of
   its anchors' hashes and sends them, sorted and gap-coded, to buckets, which tell each run the prints that stand twice
   or more anywhere. Prints only ever let too many anchors through.
2. A run sends the passage around each anchor left (length - K words before it, length from it on) to the reference
   block of the anchor's hash: each different passage once, as codes into the words it sends along.
3. A block indexes the passages of all runs as sorted suffixes and factors every one of them against all others,
   greedily from its start: the longest factor is the longest common prefix with a neighbour in the sorted order. Every
   window of a factor of `length` words or more is a duplicate. The parse goes on at the first window that crosses the
   factor's end, so that windows across factor boundaries are looked up as well; where no factor is long enough it goes
   on one word later. Passages that stand twice as a whole are one factor. Words are compared as words, not by hashes.
4. The duplicate windows go back to their runs, a few bits a passage, and the runs mark the words.

Passages about one anchor fall into one block. An anchor met more than `hot` times (a phrase of K words or more that very
many documents have between different words) sends its windows instead, as 128-bit hashes, each once a run, dealt by
their own hash, so that no block grows with it; there a window is a duplicate if its hash is counted twice.

Null texts have no words. Windows never cross documents. The order and values of ids don't matter: rows of a null id or of the same id
are documents like others, and each comes back. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.common import in_small_batches, mix, pieces, powers, prefix_hash, span_hash, string_buffers, trimmed, word_spans
from voxlake.llm.suffix_dedup import LEAST_BYTES, MOST_BYTES, PRINT_BITS, ROOT_BYTES, _placed, _sliding, gap_coded, gap_decoded

LENGTH = 35
#: Times an anchor may stand before its windows are dealt one by one.
HOT = 4096
#: Passages that are made at once.
STEP = 1 << 15
_NONE = np.uint32(0xFFFFFFFF)


def anchor_words(length: int) -> int:
    return max(1, length * 12 // 35)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _sums(hashes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=out[1:])
    return out


def anchors(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of all windows' anchors in documents with the given bounds, and the hashes of the K words there. Ties are all anchors."""
    k = anchor_words(length)
    width = length - k + 1
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = span_hash(_sums(hashes), np.arange(len(hashes) - k + 1), np.arange(k, len(hashes) + 1))
    key = np.minimum((full >> np.uint64(32)).astype(np.uint32), _NONE - np.uint32(1))
    for end in bounds[1:].tolist():  # no K words across documents
        key[max(0, end - k + 1) : end] = _NONE
    least = _sliding(key, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero((key == _sliding(padded, width, np.maximum)) & (key != _NONE))
    return at, mix(full[at] + np.uint64(0x5851F42D4C957F2D))


class Piece:
    """Some documents of a run as words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data = first, np.ascontiguousarray(data)
        self.starts, self.ends, rows = word_spans(data, offsets)
        self.bounds = np.searchsorted(rows, np.arange(len(offsets)))

    @cached_property
    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.starts, self.ends)

    @cached_property
    def words(self) -> pa.Array:
        if not len(self.starts):
            return pa.array([], pa.binary())
        edges = np.empty(2 * len(self.starts), np.int32)
        edges[0::2], edges[1::2] = self.starts, self.ends
        both = pa.Array.from_buffers(pa.binary(), 2 * len(self.starts) - 1, [None, pa.py_buffer(edges), pa.py_buffer(self.data)])
        return both.take(pa.array(np.arange(0, len(both), 2)))  # every second one is a gap

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        return anchors(self.hashes, self.bounds, length)

    def doc(self, at: np.ndarray) -> np.ndarray:
        """Which of its documents words belong to; those without words share bounds and own none."""
        return np.searchsorted(self.bounds, at, side="right") - 1


def _covered(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Places below n inside any of the spans."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


class Run:
    """The documents of a run, in an order that doesn't depend on how they came."""

    def __init__(self, docs: pa.Table):
        docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])) if docs.num_rows else docs
        self.ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        self.raw, self.offsets = string_buffers(docs.column("text").combine_chunks()) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def pieces(self) -> Iterator[Piece]:
        for i, _, data, offsets in pieces(self.raw, self.offsets):
            yield Piece(i, data, offsets)


def _prints(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        hashes = np.concatenate([np.zeros(0, np.uint64), *(p.anchors(length)[1] for p in Run(docs).pieces())])
        bucket, mark = _placed(hashes, buckets)
        both, count = np.unique(bucket << PRINT_BITS | mark, return_counts=True)
        cut = np.searchsorted(both >> PRINT_BITS, np.arange(buckets + 1))
        rows = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        low, count = both & ((1 << PRINT_BITS) - 1), np.minimum(count, 65535).astype("<u2")
        trimmed()
        return pa.table(
            {
                "bucket": pa.array(rows, pa.int32()),
                "run": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "prints": pa.array([gap_coded(low[cut[b] : cut[b + 1]]) for b in rows], pa.binary()),
                "counts": pa.array([_packed(count[cut[b] : cut[b + 1]]) for b in rows], pa.binary()),
            }
        )

    return run


def _shared(hot: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Which prints of each run stand twice or more, and which of those more than `hot` times."""
        lists = [gap_decoded(x) for x in rows.column("prints").to_pylist()]
        counts = [_unpacked(x, "<u2").astype(np.int64) for x in rows.column("counts").to_pylist()]
        _, where = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts))[where]
        out, end = [], 0
        for r, v in zip(rows.column("run").to_pylist(), lists, strict=True):
            mine = total[end : end + len(v)]
            end += len(v)
            for kind, keep in ((0, (mine > 1) & (mine <= hot)), (1, mine > hot)):
                if keep.any():
                    out.append((r, kind, gap_coded(v[keep])))
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"run": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "place": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array(cols[2], pa.binary())})

    return run


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows of non-negative int32 as byte strings in the same order."""
    return np.ascontiguousarray(rows, ">i4").view(f"S{4 * rows.shape[1]}").ravel()


def _told(told: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    rows = told.filter(pc.equal(told.column("kind"), kind)) if told.num_rows else told
    return list(zip(rows.column("place").to_pylist(), rows.column("payload").to_pylist(), strict=True))


class Passages:
    """The different passages about a run's shared anchors, and the windows of its hot ones, and where they stand.

    A passage is a row of its bucket, length - K words before the anchor and `length` from it on; 0 where the document ends.
    """

    def __init__(self, run: Run, told: pa.Table, buckets: int, length: int):
        self.length, self.before = length, length - anchor_words(length)
        wanted, hot = (np.sort(np.concatenate([np.zeros(0, np.int64), *((place << PRINT_BITS) + gap_decoded(x) for place, x in _told(told, kind))])) for kind in (0, 1))
        self.at, self.spots, held, words, high, low = [], [], [], [pa.array([], pa.binary())], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for piece in run.pieces():
            at, hashes = piece.anchors(length)
            bucket, mark = _placed(hashes, buckets)
            both = bucket << PRINT_BITS | mark
            keep, burning = np.isin(both, wanted), np.isin(both, hot)
            mine, doc = at[keep], piece.doc(at[keep])
            lower, upper = piece.bounds[doc], piece.bounds[doc + 1]
            around = _covered(np.maximum(mine - self.before, lower), np.minimum(mine + length, upper), len(piece.starts))
            words.append(piece.words.take(pa.array(around)))
            held.append((mine, bucket[keep], lower, upper, around, len(piece.starts)))
            spots = self._windows(piece, at[burning])
            self.at.append(mine)
            self.spots.append(spots)
            if len(spots):
                high.append(span_hash(_sums(piece.hashes), spots, spots + length))
                low.append(span_hash(_sums(mix(piece.hashes ^ np.uint64(0x2545F4914F6CDD1D))), spots, spots + length))
        named = pa.concat_arrays(words).dictionary_encode()
        self.vocabulary, code = named.dictionary, np.asarray(named.indices) + 1
        self._tables(held, code)
        self.hashes = np.stack([np.concatenate(high), np.concatenate(low)], axis=1)
        self.kinds, self.kind_of, count = np.unique(self.hashes, axis=0, return_inverse=True, return_counts=True)
        self.kind_of = self.kind_of.reshape(-1)
        self.kinds_several = count > 1
        self.kinds_part, _ = _placed(self.kinds[:, 0], buckets)

    def _tables(self, held: list[tuple], code: np.ndarray) -> None:
        """The different passages in order, whether they stand twice in this run, and which one each anchor has."""
        span = np.arange(-self.before, self.length)[None, :]
        rows, weights, index, made, done = [np.zeros((0, 1 + span.size), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
        for mine, bucket, lower, upper, around, n in held:
            codes = np.zeros(n, np.int32)
            codes[around] = code[done : done + len(around)]
            done += len(around)
            for a in range(0, len(mine), STEP):
                z = slice(a, a + STEP)
                place = mine[z, None] + span
                inside = (place >= lower[z, None]) & (place < upper[z, None])
                table = np.concatenate([bucket[z, None], np.where(inside, codes[np.clip(place, 0, n - 1)], 0)], axis=1).astype(np.int32)
                _, first, where, count = np.unique(_as_bytes(table), return_index=True, return_inverse=True, return_counts=True)
                rows.append(table[first])
                weights.append(count)
                index.append(made + where)
                made += len(first)
        every, weight = np.concatenate(rows), np.concatenate(weights)
        _, first, where = np.unique(_as_bytes(every), return_index=True, return_inverse=True)
        self.part, self.rows = every[first, 0], every[first, 1:]
        self.several = np.bincount(where, weight, len(first)) > 1
        self.index = where[np.concatenate(index)]

    def _windows(self, piece: Piece, at: np.ndarray) -> np.ndarray:
        """Starts of all windows about the anchors."""
        doc = piece.doc(at)
        begins = np.maximum(at - self.before, piece.bounds[doc])
        ends = np.minimum(at, piece.bounds[doc + 1] - self.length)
        some = ends >= begins
        return _covered(begins[some], ends[some] + 1, len(piece.starts) + 1)


def _passages(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        mine = Run(docs)
        found = Passages(mine, told, buckets, length)
        out = []
        for p in np.union1d(found.part, found.kinds_part).tolist():
            here, there = found.part == p, found.kinds_part == p
            used, where = np.unique(found.rows[here], return_inverse=True)
            names = found.vocabulary.take(pa.array(used[used > 0] - 1))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), b" ")[0].as_py()
            vocabulary = b" " + joined if (used == 0).any() else joined  # word 0 is empty, and no word holds a blank
            out.append((p, zstandard.ZstdCompressor(level=3).compress(vocabulary), _packed(where.astype("<i4")), _packed(found.several[here]), _packed(found.kinds[there]), _packed(found.kinds_several[there])))
        trimmed()
        cols = list(zip(*out, strict=True)) or [()] * 6
        names = ["vocabulary", "passages", "several", "windows", "windows_several"]
        return pa.table({"part": pa.array(cols[0], pa.int32()), "run": pa.array([key[0].as_py()] * len(out), pa.int64())} | {n: pa.array(cols[i + 1], pa.binary()) for i, n in enumerate(names)})

    return run


def factored(rows: np.ndarray, several: np.ndarray, length: int) -> np.ndarray:
    """For different passages of word codes, whether the window from each column on stands in another, or in one that stands twice."""
    before = length - anchor_words(length)
    starts = np.arange(before + 1)
    there = (rows[:, starts] > 0) & (rows[:, starts + length - 1] > 0)
    out = there & several[:, None]
    if not len(rows):
        return out
    _, group = np.unique(_as_bytes(rows[:, before:length]), return_inverse=True)
    alone = np.bincount(group)[group] == 1
    parse = np.where(several | alone, before + 1, 0)  # where each passage's parse stands
    for s in range(before + 1):
        turn = parse == s
        if not turn.any():
            continue
        live = np.flatnonzero(np.bincount(group, turn)[group] > 0)  # all passages that share an anchor with one whose turn it is
        suffix = rows[live, s:]
        order = np.argsort(_as_bytes(suffix), kind="stable")
        suffix = suffix[order]
        same = np.zeros((len(order) + 1, suffix.shape[1] + 1), bool)
        same[1:-1, :-1] = (suffix[1:] == suffix[:-1]) & (suffix[1:] > 0)
        common = same.argmin(axis=1)
        factor = np.zeros(len(rows), np.int64)
        factor[live[order]] = np.maximum(common[:-1], common[1:])
        for r in (here := np.flatnonzero(turn & (factor >= length))).tolist():
            out[r, s : s + factor[r] - length + 1] = True
        parse[turn] = s + 1
        parse[here] = s + factor[here] - length + 1
    return out & there


def _answers(length: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Of each run's passages the duplicate windows as bits, and of its windows which are duplicates."""
        runs, part = rows.column("run").to_pylist(), key[0].as_py()
        width = 2 * length - anchor_words(length)
        lists = pc.split_pattern(pa.array([zstandard.ZstdDecompressor().decompress(x) for x in rows.column("vocabulary").to_pylist()], pa.binary()), b" ")
        named = lists.flatten().dictionary_encode()
        empty = np.asarray(pc.equal(pc.binary_length(named.dictionary), 0))
        code = np.asarray(named.indices)
        code = np.where(empty[code], 0, code + 1).astype(np.int32)
        ends = np.asarray(lists.offsets)
        tables = [code[a:b][_unpacked(x, "<i4")].reshape(-1, width) for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), rows.column("passages").to_pylist(), strict=True)]
        several = np.concatenate([_unpacked(x, "?") for x in rows.column("several").to_pylist()])
        every = np.concatenate(tables)
        _, first, where = np.unique(_as_bytes(every), return_index=True, return_inverse=True)
        twice = np.bincount(where, 1 + several, len(first)) > 1
        bits = (factored(every[first], twice, length) @ (np.int64(1) << np.arange(length - anchor_words(length) + 1))).astype("<u8")[where]
        windows = [_unpacked(x, "<u8").reshape(-1, 2) for x in rows.column("windows").to_pylist()]
        again = np.concatenate([_unpacked(x, "?") for x in rows.column("windows_several").to_pylist()])
        _, of = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        of = of.reshape(-1)
        doubled = np.bincount(of, 1 + again)[of] > 1 if len(of) else np.zeros(0, bool)
        out, a, b = [], 0, 0
        for r, t, w in zip(runs, tables, windows, strict=True):
            if len(t):
                out.append((r, 2, _packed(bits[a : a + len(t)])))
            if len(w):
                out.append((r, 3, _packed(doubled[b : b + len(w)])))
            a, b = a + len(t), b + len(w)
        trimmed()
        cols = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"run": pa.array(cols[0], pa.int64()), "kind": pa.array(cols[1], pa.int32()), "place": pa.array([part] * len(out), pa.int32()), "payload": pa.array(cols[2], pa.binary())})

    return run


Derive = dict[str, tuple[str, Callable[[bytes, np.ndarray], object]]]
KEPT: Derive = {"kept": ("binary", lambda kept, spans: kept), "spans": ("array<struct<start:bigint,end:bigint>>", lambda kept, spans: [{"start": a, "end": b} for a, b in spans.tolist()])}


def _marked(length: int, buckets: int, derive: Derive, schema: pa.Schema):
    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        mine = Run(docs)
        found = Passages(mine, told, buckets, length)
        bits, doubled = np.zeros(len(found.rows), np.uint64), np.zeros(len(found.kinds), bool)
        for place, x in _told(told, 2):
            bits[found.part == place] = _unpacked(x, "<u8")
        for place, x in _told(told, 3):
            doubled[found.kinds_part == place] = _unpacked(x, "?")
        own, hot = bits[found.index], doubled[found.kind_of]
        out: dict[str, list] = {c: [] for c in schema.names}
        done = gone_by = 0
        for piece, at, spots in zip(mine.pieces(), found.at, found.spots, strict=True):
            some, burnt = own[done : done + len(at)], hot[gone_by : gone_by + len(spots)]
            done, gone_by = done + len(at), gone_by + len(spots)
            edge = np.zeros(len(piece.starts) + 1, np.int32)
            for begin in [spots[burnt], *(at[(some >> np.uint64(s)) & np.uint64(1) == 1] - found.before + s for s in range(found.before + 1))]:
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            left = np.concatenate([[0], np.cumsum(~gone)])[piece.bounds].astype(np.int32)
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), piece.words.filter(pa.array(~gone))), b" ").to_pylist()
            for r, (a, b) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True)):
                spans = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]]))).reshape(-1, 2)
                out["doc_id"].append(mine.ids[piece.first + r].as_py())
                out["n_words"].append(b - a)
                out["n_removed"].append(int(gone[a:b].sum()))
                for c, (_, f) in derive.items():
                    out[c].append(f(kept[r], spans))
        trimmed()
        return pa.table(out, schema=schema)

    return run


def dedup_passages(docs: DataFrame, length: int = LENGTH, derive: Derive | None = None, run_bytes: int | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and what `derive` makes of the kept words joined by blanks and the removed (start, end) spans of words: by default both."""
    derive = KEPT if derive is None else derive
    texts = in_small_batches(docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    schema = T._parse_datatype_string("doc_id bigint, n_words bigint, n_removed bigint" + "".join(f", {c} {t}" for c, (t, _) in derive.items()))
    total = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    run_bytes = run_bytes or min(MOST_BYTES, max(LEAST_BYTES, int(ROOT_BYTES * total**0.5)))
    runs = max(1, -(-total // run_bytes))
    buckets = 16
    while buckets < min(runs, 1 << 20):
        buckets *= 2
    by_run = texts.withColumn("run", F.pmod(F.xxhash64("doc_id", "text"), F.lit(runs))).groupBy("run")
    told = "run bigint, kind int, place int, payload binary"
    shared = by_run.applyInArrow(_prints(length, buckets), "bucket int, run bigint, prints binary, counts binary").groupBy("bucket").applyInArrow(_shared(hot), told)
    found = by_run.cogroup(shared.groupBy("run")).applyInArrow(_passages(length, buckets), "part int, run bigint, vocabulary binary, passages binary, several binary, windows binary, windows_several binary")
    answers = found.groupBy("part").applyInArrow(_answers(length), told)
    return by_run.cogroup(shared.union(answers).groupBy("run")).applyInArrow(_marked(length, buckets, derive, to_arrow_schema(schema)), schema)
