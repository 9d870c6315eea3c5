"""Best-fit packing of token sequences: minimum bin slack by subset sums.

Documents become token ids, ids become pieces of at most `capacity`, and pieces fill sequences. A bin takes the
longest piece left; a subset-sum table over the lengths left, a bitset in which bit s says that some of them add up
to s, then finds the fullest combination for the rest of the bin. Lengths, never ids, decide, and they are dealt to
buckets of about BUCKET_ROWS pieces by a hash, so that each bucket is a small task of the same mixture. What a bucket
can't fill to the brim is dealt again to fewer buckets, until one bucket holds all that is left.

Null texts are empty; an empty document is its end token alone. Repeated rows and null keys are packed like any other
row. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.llm.bpe import byte_alphabet
from voxlake.llm.common import dropped, in_small_batches, one_thread, pieces, string_buffers, trimmed, written

CAPACITY = 4096
#: Rows and bytes of text that travel to a worker at once: less than for others, since the words' ids take memory beside them.
ARROW_ROWS, ARROW_BYTES = 500, 2 << 20
BUCKET_ROWS = 4096
#: Places that a join may send to every executor: 24 MB at most.
BROADCAST_ROWS = 1_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 300_000
#: Bytes of texts whose new words are asked for in one call; a longer text is asked for alone.
TEXT_BYTES = 1 << 18

#: Characters on which Python's white space, case and composition agree with the tokenizers library; other texts go to it whole.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧]*")
#: What such a text's words are split into, in lower case.
_PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿā-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿā-ſ0-9²³¹¼½¾]+")
_CODECS: dict[str, WordCodec] = {}


class WordCodec:
    """Token ids of whole texts by the tokenizers library, asked once for each distinct white-space-free run.

    Holds for models that lower-case, drop white space and never merge across it. Ids come as little-endian uint32.
    New words go to the library's model in one call, split and mapped to its byte alphabet before, each ending in a
    word-end token; texts outside _PLAIN, and calls whose word ends don't add up, go to the whole tokenizer.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        one_thread()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.words = Tokenizer(self.model.model)  # the same vocabulary and merges in memory, without normalizer and added tokens
        self.words.pre_tokenizer = WhitespaceSplit()
        self.alphabet = {b: c for c, b in byte_alphabet().items() if b != 32}
        self.known: dict[str, bytes] = {}
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.cache_words = cache_words
        trimmed()  # what reading the file took

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Ids of new words; those of several parts from the parts' ids."""
        known = self.known
        split = {w: _PART.findall(w) for w in words if not w.isalpha()}
        new = {w for w in words if w not in split}
        new.update(p for ps in split.values() for p in ps if p not in known)
        parts = list(new)
        if parts:
            mapped = " ".join(parts).encode().decode("latin-1").translate(self.alphabet)
            ids = np.array(self.words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(parts):
                raw, at = ids.tobytes(), (ends * 4).tolist()
                known.update((p, raw[i:j]) for p, i, j in zip(parts, [0, *at], at, strict=False))
            else:
                known.update(zip(parts, self.whole(parts), strict=True))
        known.update((w, b"".join([known[p] for p in ps])) for w, ps in split.items())

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.cache_words:
            self.known.clear()
        known = self.known
        split = [t.lower().split() if _PLAIN.fullmatch(t) and not any(s in t for s in self.special) else None for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words or ())
        self.learn([w for w in new if w not in known])
        for text, words in zip(texts, split, strict=True):
            yield self.whole([text])[0] if words is None else b"".join([known[w] for w in words])

    def encode(self, text: str) -> bytes:
        return next(self.encode_many([text]))


def word_codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


PIECE_FIELDS = [("piece", pa.int32(), "int"), ("start", pa.int64(), "bigint"), ("length", pa.int64(), "bigint")]


def ids_list(ids: np.ndarray) -> np.ndarray:
    """The ids themselves, as an array column takes them without an object for each."""
    return ids.astype(np.int32)


def ids_crc32(ids: np.ndarray) -> int:
    """CRC of the little-endian unsigned 32-bit ids."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def token_pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, derive: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length and what `derive` makes of the piece's ids.

    derive: column -> (Spark type, function of the piece's uint32 ids); the ids themselves by default.
    """
    derive = derive or {"ids": ("array<int>", ids_list)}
    schema = T._parse_datatype_string("doc_id bigint, piece int, start bigint, length bigint" + "".join(f", {c} {t}" for c, (t, _) in derive.items()))
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_codec(path)
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for i, j, _, _ in pieces(*string_buffers(whole.column(1)), TEXT_BYTES):
                batch = whole.slice(i, j - i)
                out: dict[str, list] = {f: [] for f in arrow.names}
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, raw in zip(batch.column(0).to_pylist(), codec.encode_many(texts), strict=True):
                    ids = np.frombuffer(raw + tail, "<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out["doc_id"].append(doc_id)
                        out["piece"].append(k)
                        out["start"].append(start)
                        out["length"].append(len(part))
                        for c, (_, f) in derive.items():
                            out[c].append(f(part))
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        codec.known.clear()  # the worker may do other work next
        trimmed()

    return in_small_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), ARROW_ROWS, ARROW_BYTES).mapInArrow(run, schema)


def fill_bins(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of row numbers, each filled as full as the rows left allow once the longest of them is in.

    Bit s of `reach` after i kinds says that a multiset of the first i kinds of length sums to s; the search ends as
    soon as the bin's rest itself is reachable, and walks the kept bitsets back to the rows.
    """
    rows: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        rows.setdefault(int(lengths[i]), []).append(i)
    kinds = sorted(rows, reverse=True)
    bins = []
    while kinds:
        first = kinds[0]
        made = [rows[first].pop()]
        if not rows[first]:
            kinds.pop(0)
        rest = capacity - first
        if rest > 0 and kinds and kinds[-1] <= rest:
            mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
            for kind in kinds:
                if kind > rest:
                    continue
                for _ in range(min(len(rows[kind]), rest // kind)):
                    steps.append((kind, reach))
                    grown = (reach | reach << kind) & mask
                    if grown == reach:
                        steps.pop()
                        break
                    reach = grown
                    if reach >> rest:
                        break
                if reach >> rest:
                    break
            left = reach.bit_length() - 1
            for kind, before in reversed(steps):
                if left >= kind and not before >> left & 1:
                    made.append(rows[kind].pop())
                    left -= kind
            kinds = [k for k in kinds if rows[k]]
        bins.append(made)
    return bins


def _fill(level: int, capacity: int, names: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", *[c for c in ("doc_id", "piece", "row") if c in frame.columns]], kind="stable", na_position="first").reset_index(drop=True)
        lengths = frame["length"].to_numpy(np.int64)
        sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
        full = np.zeros(len(frame), bool)
        base = (level << 58) | (int(frame["bucket"].iloc[0]) << 20)
        for k, made in enumerate(fill_bins(lengths, capacity)):
            at = np.array(made)
            sequence[at] = base | k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
            full[at] = lengths[at].sum() == capacity
        return frame.assign(sequence_id=sequence, offset=offset, full=full)[names]

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`sized` (doc_id, piece, length and any other columns) with sequence_id and offset.

    Rows are told apart by their columns doc_id, piece and row, as far as there are such. Rows longer than `capacity` get a sequence of their own. Columns named bucket, full, sequence_id or offset are replaced.
    """
    keep = [c for c in sized.columns if c not in ("bucket", "full", "sequence_id", "offset")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.select(keep).schema)
    names = [*keep, "sequence_id", "offset", "full"]
    todo, done, level = sized.select(keep), [], 0
    while True:
        todo_rows = todo.count()
        buckets = max(1, -(-todo_rows // bucket_rows))
        salted = todo.withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "length", *[c for c in ("doc_id", "piece", "row") if c in keep]), F.lit(buckets)))
        filled = written(salted.groupBy("bucket").applyInPandas(_fill(level, capacity, names), f"{fields}, sequence_id bigint, offset bigint, full boolean"), "packed")
        if buckets == 1 or level == 15:
            done.append(filled)
            break
        done.append(filled.where("full"))
        left, level = filled.where("not full").select(keep), level + 1
        if left.count() > 0.7 * todo_rows:  # lengths that don't fill bins: dealing them again gains nothing
            done.append(filled.where("not full"))
            break
        todo = left
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("full")


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, derive: dict[str, tuple[str, Callable]] | None = None) -> DataFrame:
    """Pieces of all documents (see token_pieces) with the sequence and the place they are packed at.

    Only keys and lengths go through the packing; what was derived from the ids joins its place afterwards. Up to
    BROADCAST_ROWS places go to the pieces; more of them meet in a shuffle.
    """
    cut = written(token_pieces(docs, path, end_id, capacity, derive).withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pack(cut.select("row", "doc_id", "piece", "length"), capacity).select("row", "sequence_id", "offset")
    few = cut.count() <= BROADCAST_ROWS
    return cut.join(F.broadcast(placed) if few else placed, "row").drop("row")


__all__ = ["CAPACITY", "WordCodec", "dropped", "fill_bins", "ids_crc32", "pack", "pack_documents", "token_pieces"]
