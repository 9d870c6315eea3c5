"""Exact substring dedup: a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Which strings do
is read off sorted suffixes, of which only a content-defined part is needed: of the K-byte strings in any window of
`length` bytes the one with the least hash is its anchor, so equal windows have the same anchor at the same place. A
suffix sorted from its anchor on, together with the length - K bytes before it, decides every window with that anchor.

1. Documents are dealt to runs of some MB by a hash of their id. Each run sends short prints of its anchors'
   hashes to buckets, sorted and gap-coded; a bucket tells each run which of its prints other documents have too. Prints
   only ever let too many anchors through.
2. Each run sorts the suffixes at the anchors left, once for each different one with the least document id, front-codes
   them (bytes shared with the suffix before, and the rest), and deals them to parts by the hash of their first K bytes,
   so that suffixes with a common prefix of K bytes meet however large the group: a run sends one of each.
3. A part merges its sorted runs through a loser tree over common-prefix lengths: two suffixes whose known common
   prefixes with the last winner differ are ordered by those alone, and if they agree only the bytes after them are
   compared. The same lengths cut the merged order into groups that share 50, 49, ... K bytes; with the bytes before the
   anchor, a group's least document id says for each of its windows whether a smaller document has it.
4. The answers go back to their runs, a few bits a suffix, and the runs mark the bytes.

Null texts are empty. Matches never cross documents. Rows of a null doc_id are neither cut nor sources; rows of the
same doc_id are not smaller than each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.common import in_small_batches, mix, pieces, powers, prefix_hash, string_buffers, trimmed

LENGTH = 50
#: Least and most bytes of text in a run, and as many times a bucket's share; between them it grows with the root of all bytes, so that runs times buckets grow as the input.
LEAST_BYTES, MOST_BYTES, ROOT_BYTES = 4 << 20, 256 << 20, 128
PRINT_BITS = 26
#: Suffixes that are made at once, and bytes of text that are hashed at once (longer single texts form a piece of their own).
STEP, HASHED_BYTES = 1 << 14, 1 << 18
_NONE = np.uint32(0xFFFFFFFF)


def anchor_bytes(length: int) -> int:
    return max(8, length * 16 // 25)


def _sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over every `width` neighbours, by doubling."""
    size = 1
    full = len(x) - width + 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:full], x[width - size : width - size + full]) if size < width else x


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all windows' anchors, and the hashes of the K bytes there. Ties are all anchors."""
    k = anchor_bytes(length)
    width = length - k + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    _, down = powers(len(data) + 1)
    full = mix((prefix[k:] - prefix[:-k]) * down[: len(data) - k + 1])
    key = np.minimum((full >> np.uint64(32)).astype(np.uint32), _NONE - np.uint32(1))
    for end in offsets[1:].tolist():  # no K bytes across documents
        key[max(0, end - k + 1) : end] = _NONE
    least = _sliding(key, width, np.minimum)
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint32)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero((key == _sliding(padded, width, np.maximum)) & (key != _NONE))
    return at, mix(full[at] + np.uint64(0x5851F42D4C957F2D))


def gap_coded(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as 16-bit gaps; 65535 adds to the next gap."""
    gaps = np.diff(values, prepend=0)
    fill = gaps // 65535
    out = np.full(len(gaps) + int(fill.sum()), 65535, np.uint16)
    out[np.arange(len(gaps)) + np.cumsum(fill)] = gaps % 65535
    return out.tobytes()


def gap_decoded(coded: bytes) -> np.ndarray:
    x = np.frombuffer(coded, np.uint16)
    return np.cumsum(x.astype(np.int64))[x != 65535]


def _placed(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and print of anchor hashes."""
    bits = buckets.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    return bucket, ((hashes >> np.uint64(64 - bits - PRINT_BITS)) & np.uint64((1 << PRINT_BITS) - 1)).astype(np.int64)


class Run:
    """The documents of a run, piece by piece."""

    def __init__(self, docs: pa.Table, length: int):
        self.length = length
        self.ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        self.known = np.array(self.ids.is_valid())
        self.doc = np.array(self.ids.fill_null(0))
        order = np.lexsort((self.doc, ~self.known))  # rows come in any order
        self.ids, self.known, self.doc = self.ids.take(pa.array(order)), self.known[order], self.doc[order]
        self.rest = docs.column("rest").combine_chunks().take(pa.array(order)) if "rest" in docs.column_names else None
        self.raw, self.offsets = string_buffers(docs.column("text").combine_chunks().take(pa.array(order))) if docs.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, bytes, offsets, anchor positions, their hashes, their rows in the run) without rows of a null id."""
        for i, _, data, offsets in pieces(self.raw, self.offsets, HASHED_BYTES):
            at, hashes = anchors(data, offsets, self.length)
            row = i + np.searchsorted(offsets, at, side="right") - 1
            use = self.known[row] if len(row) else np.zeros(0, bool)
            yield i, data, offsets, at[use], hashes[use], row[use]


def _prints(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        mine = Run(docs, length)
        hashes, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, _, _, h, row in mine.pieces():
            hashes.append(h)
            doc.append(mine.doc[row])
        hashes, doc = np.concatenate(hashes), np.concatenate(doc)
        bucket, mark = _placed(hashes, buckets)
        both = bucket << PRINT_BITS | mark
        order = np.argsort(both, kind="stable")
        both, doc = both[order], doc[order]
        first = np.ones(len(both), bool)
        first[1:] = both[1:] != both[:-1]
        at = np.flatnonzero(first)
        several = np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        both = both[at]
        cut = np.searchsorted(both >> PRINT_BITS, np.arange(buckets + 1))
        rows = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        low = both & ((1 << PRINT_BITS) - 1)
        trimmed()
        return pa.table(
            {
                "bucket": pa.array(rows, pa.int32()),
                "run": pa.array([key[0].as_py()] * len(rows), pa.int64()),
                "prints": pa.array([gap_coded(low[cut[b] : cut[b + 1]]) for b in rows], pa.binary()),
                "several": pa.array([np.packbits(several[cut[b] : cut[b + 1]]).tobytes() for b in rows], pa.binary()),
            }
        )

    return run


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """Which prints of each run another document has."""
    lists = [gap_decoded(x) for x in rows.column("prints").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(v)].astype(bool) for x, v in zip(rows.column("several").to_pylist(), lists, strict=True)]
    value = np.concatenate(lists)
    order = np.argsort(value, kind="stable")
    sorted_ = value[order]
    same = np.zeros(len(value), bool)
    same[1:] = sorted_[1:] == sorted_[:-1]
    same[:-1] |= same[1:].copy()
    mine = np.zeros(len(value), bool)
    mine[order] = same
    mine |= np.concatenate(several)
    # a print that is several documents' in one run is also another's in the runs that have it once
    ends = np.cumsum([len(v) for v in lists])
    runs = rows.column("run").to_pylist()
    out = [(r, gap_coded(v[mine[e - len(v) : e]])) for r, v, e in zip(runs, lists, ends, strict=True) if mine[e - len(v) : e].any()]
    trimmed()
    return pa.table({"run": pa.array([r for r, _ in out], pa.int64()), "kind": pa.array([0] * len(out), pa.int32()), "place": pa.array([key[0].as_py()] * len(out), pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})


class Contexts:
    """The different suffixes of a run with the bytes before them, in sorted order, and where they occur.

    A row holds the suffix (zero-filled), its length, the bytes before the anchor from the nearest on, and their number.
    """

    def __init__(self, run: Run, told: pa.Table, buckets: int):
        self.run, length = run, run.length
        k = anchor_bytes(length)
        self.before = length - k
        rows = told.filter(pa.compute.equal(told.column("kind"), 0)) if told.num_rows else told
        known = [(place << PRINT_BITS) + gap_decoded(x) for place, x in zip(rows.column("place").to_pylist(), rows.column("payload").to_pylist(), strict=True)]
        wanted = np.sort(np.concatenate(known)) if known else np.zeros(0, np.int64)
        width = length + self.before + 2
        rows_, leasts, index, docs, self.at, made = [np.zeros((0, 4 + width), np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
        for i, data, offsets, at, hashes, row in run.pieces():
            bucket, mark = _placed(hashes, buckets)
            both = bucket << PRINT_BITS | mark
            spot = np.minimum(np.searchsorted(wanted, both), max(0, len(wanted) - 1))
            keep = wanted[spot] == both if len(wanted) else np.zeros(len(both), bool)
            at, bucket, row = at[keep], bucket[keep], row[keep]
            self.at.append((i, len(data), at, row))
            docs.append(run.doc[row])
            for a in range(0, len(at), STEP):  # the different ones of each step are kept, so that repetitive texts stay small
                z = slice(a, a + STEP)
                table = np.concatenate([bucket[z].astype(">u4").view(np.uint8).reshape(-1, 4), self._around(data, offsets, at[z], row[z] - i)], axis=1)
                _, first, where = np.unique(_packed(table), return_index=True, return_inverse=True)
                rows_.append(table[first])
                leasts.append(docs[-1][z][first])  # documents come in order, so the first is the least
                index.append(made + where)
                made += len(first)
        every, least = np.concatenate(rows_), np.concatenate(leasts)
        _, first, where = np.unique(_packed(every), return_index=True, return_inverse=True)
        self.index = where[np.concatenate(index)]
        self.rows, self.part = every[first, 4:], every[first, :4].copy().view(">u4").ravel().astype(np.int64)
        self.least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.least, where, least)
        self.doc = np.concatenate(docs)

    def _around(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        length = self.run.length
        ahead = np.minimum(offsets[row + 1] - at, length)
        behind = np.minimum(at - offsets[row], self.before)
        span, back = np.arange(length)[None, :], np.arange(self.before)[None, :]
        right = data[np.minimum(at[:, None] + span, max(0, len(data) - 1))] * (span < ahead[:, None])
        left = data[np.maximum(at[:, None] - 1 - back, 0)] * (back < behind[:, None])
        return np.concatenate([right, ahead[:, None], left, behind[:, None]], axis=1).astype(np.uint8)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as byte strings, which sort as they do."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def front_coded(rows: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
    """(shared lengths, rest bytes) of sorted suffixes."""
    differ = np.ones((len(rows), rows.shape[1] + 1), bool)
    differ[1:, :-1] = rows[1:] != rows[:-1]
    shared = np.minimum(differ.argmax(axis=1), sizes)
    shared[1:] = np.minimum(shared[1:], sizes[:-1])
    shared[0] = 0
    span = np.arange(rows.shape[1])[None, :]
    return shared.astype(np.uint8).tobytes(), rows[(span >= shared[:, None]) & (span < sizes[:, None])].tobytes()


def front_decoded(shared: bytes, rest: bytes, sizes: np.ndarray) -> list[bytes]:
    out, last, at = [], b"", 0
    for s, n in zip(shared, sizes.tolist(), strict=True):
        last = last[:s] + rest[at : at + n - s]
        at += n - s
        out.append(last)
    return out


def _suffixes(length: int, buckets: int):
    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        mine = Contexts(Run(docs, length), told, buckets)
        cut = np.searchsorted(mine.part, np.arange(buckets + 1))
        out = []
        pack = zstandard.ZstdCompressor(level=3).compress
        for p in np.flatnonzero(np.diff(cut)).tolist():
            rows = mine.rows[cut[p] : cut[p + 1]]
            sizes = rows[:, length].astype(np.int64)
            shared, rest = front_coded(rows[:, :length], sizes)
            out.append((p, *map(pack, (rows[:, length].tobytes(), shared, rest, rows[:, length + 1 :].tobytes(), mine.least[cut[p] : cut[p + 1]].tobytes()))))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        names = ["sizes", "shared", "rest", "before", "least"]
        trimmed()
        return pa.table({"part": pa.array(columns[0], pa.int32()), "run": pa.array([key[0].as_py()] * len(out), pa.int64())} | {n: pa.array(columns[i + 1], pa.binary()) for i, n in enumerate(names)})

    return run


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be `start` at least."""
    if a[start:] == b[start:]:
        return len(a)
    most = min(len(a), len(b))
    while start + 8 <= most and a[start : start + 8] == b[start : start + 8]:
        start += 8
    while start < most and a[start] == b[start]:
        start += 1
    return start


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> tuple[list[int], list[int]]:
    """The merged order of sorted runs: the run each next suffix comes from, and the prefix it shares with the one before.

    A loser tree. Every waiting suffix knows its common prefix with the last winner of its way to the root; the longer
    one wins, and only between equal ones are the bytes behind compared. shared: each run's own common prefixes.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads = [0] * len(runs)
    loser, loser_shared = [-1] * k, [0] * k  # -1: nothing waits
    order, common = [], []

    def play(node: int, r: int, s: int) -> tuple[int, int]:
        """r against the one waiting at node; the winner goes on."""
        other = loser[node]
        if other < 0:
            return r, s
        t = loser_shared[node]
        if s == t:
            a, b = runs[r][heads[r]], runs[other][heads[other]]
            n = _common(a, b, s)
            if a[n:] < b[n:] or (len(a) == n and len(b) == n and r < other):
                loser_shared[node] = n
                return r, s
            loser[node], loser_shared[node] = r, n
            return other, t
        if s > t:
            return r, s
        loser[node], loser_shared[node] = r, s
        return other, t

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            r = node - k
            return (r, 0) if r < len(runs) and runs[r] else (-1, 0)
        a, b = build(2 * node), build(2 * node + 1)
        if a[0] < 0 or b[0] < 0:
            return a if b[0] < 0 else b
        loser[node], loser_shared[node] = b
        return play(node, *a)

    winner, s = build(1)
    while winner >= 0:
        order.append(winner)
        common.append(s)
        r = winner
        heads[r] += 1
        node = (r + k) // 2
        if heads[r] < len(runs[r]):
            s = shared[r][heads[r]]
        else:
            r, s = -1, 0
        while node:
            other = loser[node]
            if other >= 0:
                t = loser_shared[node]
                if r < 0 or t > s:
                    loser[node], loser_shared[node] = r, s
                    r, s = other, t
                elif t == s:
                    r, s = play(node, r, s)
            node //= 2
        winner = r
    return order, common


def _answers(length: int):
    before = length - anchor_bytes(length)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """For each suffix of each run, a bit for each place of the window's start before it: whether a smaller document has the window."""
        names = rows.column("run").to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        cols = [list(map(unpack, rows.column(c).to_pylist())) for c in ("sizes", "shared", "rest", "before", "least")]
        by_run = sorted(range(len(names)), key=lambda i: names[i])
        sizes = [np.frombuffer(cols[0][i], np.uint8).astype(np.int64) for i in by_run]
        order, common = merge_runs([front_decoded(cols[1][i], cols[2][i], n) for i, n in zip(by_run, sizes, strict=True)], [cols[1][i] for i in by_run])
        order, common = np.array(order), np.array(common)
        # entries one after another by run, in merged order through their run's next place
        counts = np.array([len(n) for n in sizes])
        start = np.cumsum(counts) - counts
        stable = np.argsort(order, kind="stable")
        entry = np.empty(len(order), np.int64)
        entry[stable] = np.repeat(start, counts) + np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.concatenate(sizes)[entry]
        left = np.concatenate([np.frombuffer(cols[3][i], np.uint8).reshape(-1, before + 1) for i in by_run])[entry]
        least = np.concatenate([np.frombuffer(cols[4][i], np.int64) for i in by_run])[entry]
        bits = np.zeros(len(order), np.uint32)
        near = common >= length - before
        alone = ~near & ~np.append(near[1:], False)
        hashed = np.zeros(len(order), np.uint64)
        for o in range(before + 1):
            if o:
                hashed = mix(hashed + left[:, o - 1].astype(np.uint64) + np.uint64(1 + 256 * o))
            here = np.flatnonzero((left[:, before] >= o) & (size >= length - o) & ~alone)
            if len(here):
                group = np.cumsum(common < length - o)[here].astype(np.uint64)
                both = mix(group * np.uint64(0x9E3779B97F4A7C15) + hashed[here])
                by = np.argsort(both, kind="stable")
                new = np.ones(len(by), bool)
                new[1:] = both[by[1:]] != both[by[:-1]]
                first = np.flatnonzero(new)
                smallest = np.minimum.reduceat(least[here[by]], first)[np.cumsum(new) - 1]
                hit = here[by][smallest < least[here[by]]]
                bits[hit] |= np.uint32(1 << o)
        back = np.zeros(len(order), np.uint32)
        back[entry] = bits
        part = key[0].as_py()
        out = [(names[i], back[a : a + n].tobytes()) for i, a, n in zip(by_run, start.tolist(), counts.tolist(), strict=True)]
        trimmed()
        return pa.table({"run": pa.array([r for r, _ in out], pa.int64()), "kind": pa.array([1] * len(out), pa.int32()), "place": pa.array([part] * len(out), pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})

    return run


Derive = dict[str, tuple[str, Callable[[bytes, np.ndarray], object]]]
KEPT: Derive = {"kept": ("binary", lambda kept, spans: kept), "spans": ("array<struct<start:bigint,end:bigint>>", lambda kept, spans: [{"start": a, "end": b} for a, b in spans.tolist()])}


def _marked(length: int, buckets: int, derive: Derive, schema: pa.Schema):
    def run(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        mine = Contexts(Run(docs, length), told, buckets)
        bits = np.zeros(len(mine.rows), np.uint32)
        cut = np.searchsorted(mine.part, np.arange(buckets + 1))
        rows = told.filter(pa.compute.equal(told.column("kind"), 1)) if told.num_rows else told
        for place, payload in zip(rows.column("place").to_pylist(), rows.column("payload").to_pylist(), strict=True):
            bits[cut[place] : cut[place + 1]] = np.frombuffer(payload, np.uint32)
        size, back = mine.rows[:, length].astype(np.int64), mine.rows[:, -1].astype(np.int64)
        every = np.zeros(len(bits), np.uint32)  # all windows of the suffix: its least document has them
        for o in range(mine.before + 1):
            every |= np.where((back >= o) & (size >= length - o), np.uint32(1 << o), np.uint32(0))
        own = np.where(mine.doc > mine.least[mine.index], every[mine.index], bits[mine.index]) if len(mine.index) else np.zeros(0, np.uint32)
        gone = np.zeros(len(mine.run.raw), bool)
        base, done = mine.run.offsets, 0
        for i, n, at, _ in mine.at:
            some = own[done : done + len(at)]
            done += len(at)
            edge = np.zeros(n + 1, np.int32)
            for o in range(mine.before + 1):
                begin = at[(some >> np.uint32(o)) & np.uint32(1) == 1] - o
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
            np.greater(np.cumsum(edge[:-1], out=edge[:-1]), 0, out=gone[base[i] : base[i] + n])
        out: dict[str, list] = {c: [] for c in schema.names}
        for r, (a, b) in enumerate(zip(base[:-1].tolist(), base[1:].tolist(), strict=True)):
            flags = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
            spans = edges.reshape(-1, 2)
            kept = mine.run.raw[a:b][~flags].tobytes()
            out["doc_id"].append(mine.run.ids[r].as_py())
            if mine.run.rest is not None:
                out["rest"].append(mine.run.rest[r].as_py())
            out["n_bytes"].append(b - a)
            out["n_removed"].append(b - a - len(kept))
            out["n_spans"].append(len(spans))
            for c, (_, f) in derive.items():
                out[c].append(f(kept, spans))
        trimmed()
        return pa.table(out, schema=schema)

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH, derive: Derive | None = None, carry: list[str] | None = None, run_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what `derive` makes of a document's kept bytes and removed (start, end) spans: by default both.

    carry: columns of `docs` that come with the rows, in a struct `rest`.
    """
    derive = KEPT if derive is None else derive
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []))
    rest = f", rest {texts.schema['rest'].dataType.simpleString()}" if carry else ""
    schema = T._parse_datatype_string(f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint{rest}" + "".join(f", {c} {t}" for c, (t, _) in derive.items()))
    in_small_batches(texts)
    total = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    run_bytes = run_bytes or min(MOST_BYTES, max(LEAST_BYTES, int(ROOT_BYTES * total**0.5)))
    runs = max(1, -(-total // run_bytes))
    buckets = 16
    while buckets < min(runs, 1 << 20):
        buckets *= 2
    dealt = texts.withColumn("run", F.pmod(F.xxhash64(F.coalesce("doc_id", F.octet_length("text").cast("bigint"))), F.lit(runs)))
    by_run = dealt.groupBy("run")
    told = "run bigint, kind int, place int, payload binary"
    shared = by_run.applyInArrow(_prints(length, buckets), "bucket int, run bigint, prints binary, several binary").groupBy("bucket").applyInArrow(_shared, told)
    suffixes = by_run.cogroup(shared.groupBy("run")).applyInArrow(_suffixes(length, buckets), "part int, run bigint, sizes binary, shared binary, rest binary, before binary, least binary")
    answers = suffixes.groupBy("part").applyInArrow(_answers(length), told)
    return by_run.cogroup(shared.union(answers).groupBy("run")).applyInArrow(_marked(length, buckets, derive, to_arrow_schema(schema)), schema)
