"""Byte-level BPE without a merge loop: a backtracking encoder and an offset-table decoder.

An Aho-Corasick automaton over the reversed vocabulary gives the longest token at every byte of a pre-token. The
encoder takes the longest one, and steps back to a shorter token, or to the one before, while the pair it would leave
is one that merging in rank order could not have left; `PairTable` answers that and remembers. Each byte is entered at
most once per failed end, so the work is linear in the pre-token, and the result is that of the merges exactly.

Null texts are empty and give no tokens. Texts of any length are encoded whole. Rows of one id, of a null id and of equal
texts are rows of their own, and an empty table gives none. Only doc_id and text are read of other columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from voxlake.llm.common import in_small_batches, trimmed

#: The pre-token pattern of the byte-level family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs a worker remembers.
CACHE_RUNS = 400_000
_CODECS: dict[str, ByteCodec] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file -> the byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """Whether two neighbouring tokens can stand in an encoding. Ranks are token ids in merge order."""

    def __init__(self, split: list[tuple[int, int]], rank: list[int], merged: dict[tuple[int, int], int]):
        self.split, self.rank, self.merged = split, rank, merged
        self.known: dict[tuple[int, int], bool] = {}

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        got = self.known.get(key)
        if got is None:
            got = self.known[key] = self._fits(left, right)
            if len(self.known) > 2_000_000:
                self.known.clear()
        return got

    def _fits(self, left: int, right: int) -> bool:
        """Undoes merges from the latest on; a merge across the border that came before the one undone rules the pair out."""
        rank, split = self.rank, self.split
        bound = 1 << 40
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            if rank[left] > rank[right]:
                bound = rank[left]
                left = split[left][1]
            elif rank[right] < 0:  # both are single bytes
                return True
            else:
                bound = rank[right] + 1  # of equal merges the one further left comes first
                right = split[right][0]


class ByteCodec:
    """Vocabulary, automaton, pair table and offset table of one vocabulary file."""

    def __init__(self, path: str, cache_runs: int = CACHE_RUNS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for text, i in vocab.items():
            tokens[i] = bytes(alphabet[c] for c in text)
        for text, i in self.special.items():
            tokens[i] = text.encode()
        merged: dict[tuple[int, int], int] = {}
        joined: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = (vocab[a], vocab[b])
            merged.setdefault(key, r)
            joined[key] = vocab[a + b]
        single = {t: i for i, t in enumerate(tokens) if len(t) == 1 and i not in self.special.values()}
        split, rank = [(i, i) for i in range(size)], [-1] * size
        self.words: dict[bytes, int] = {}
        for i, t in enumerate(tokens):  # an entry that merging its own bytes doesn't give never occurs
            if not t or i in self.special.values():
                continue
            parts, last = [single[t[k : k + 1]] for k in range(len(t))], None
            while len(parts) > 1:
                r, k = min((merged.get(pair, size * 2), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
                if r == size * 2:
                    break
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [joined[last]]
            if parts == [i]:
                self.words[t] = i
                if last:
                    split[i], rank[i] = last, merged[last]
        self.pairs = PairTable(split, rank, merged)
        self.machine = ahocorasick.Automaton()
        for t, i in self.words.items():
            self.machine.add_word(t[::-1].decode("latin-1"), (len(t), i))
        self.machine.make_automaton()
        self.shorter = [-1] * size  # the longest token that a token starts with, itself excepted
        for t, i in self.words.items():
            self.shorter[i] = next((self.words[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.words), -1)
        self.length = [len(t) for t in tokens]
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array(self.length, np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.decimal = [str(i) for i in range(size)]
        self.pattern = regex.compile(PATTERN)
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.cache_runs = cache_runs

    def encode_pretoken(self, raw: bytes) -> list[int]:
        n = len(raw)
        longest = [-1] * n
        best = [0] * n
        for end, (length, token) in self.machine.iter(raw[::-1].decode("latin-1")):
            at = n - 1 - end
            if length > best[at]:
                best[at], longest[at] = length, token
        out: list[int] = []
        failed = bytearray(n + 1)  # ends that no valid encoding reaches the text's end from
        at, token = 0, longest[0]
        length, shorter, fits = self.length, self.shorter, self.pairs.fits
        while at < n:
            while token >= 0:
                end = at + length[token]
                if not failed[end] and (not out or fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                failed[at] = 1
                token = out.pop()
                at -= length[token]
                token = shorter[token]
        return out

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return [i for word in self.pattern.findall(text) for i in self.encode_pretoken(word.encode())]

    def encode(self, text: str) -> np.ndarray:
        """uint32 ids. Runs between single spaces that neither start nor end in white space are split alike wherever they stand, so they are remembered."""
        if self.cuts is not None and any(s in text for s in self.special):
            parts = [np.array([self.special[x]], np.uint32) if x in self.special else self._encode(x) for x in self.cuts.split(text) if x]
            return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return self._encode(text)

    def _encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        first, *rest = text.split(" ")
        known = self.known
        try:
            out = [known[" " + w] for w in rest]
        except KeyError:
            if len(known) > self.cache_runs:
                known.clear()
            out = []
            for w in rest:
                got = known.get(" " + w)
                if got is None:
                    if not w or w[0].isspace() or w[-1].isspace():
                        return np.array(self.encode_plain(text), np.uint32)
                    got = known[" " + w] = np.array(self.encode_plain(" " + w), "<u4").tobytes()
                out.append(got)
        if rest and (not first or first[-1].isspace()):
            return np.array(self.encode_plain(text), np.uint32)
        return np.frombuffer(np.array(self.encode_plain(first), "<u4").tobytes() + b"".join(out), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Copies each token's slice of the vocabulary blob."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that aren't UTF-8 become the replacement character."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def byte_codec(path: str) -> ByteCodec:
    if path not in _CODECS:
        _CODECS[path] = ByteCodec(path)
    return _CODECS[path]


Derive = dict[str, tuple[str, Callable[[ByteCodec, np.ndarray], object]]]
IDS: Derive = {"ids": ("array<bigint>", lambda codec, ids: ids.tolist())}


def encode(docs: DataFrame, path: str, derive: Derive | None = None) -> DataFrame:
    """doc_id and what `derive` makes of each text's ids: column -> (Spark type, function of codec and ids); by default the ids."""
    derive = IDS if derive is None else derive
    schema = T._parse_datatype_string("doc_id bigint" + "".join(f", {c} {t}" for c, (t, _) in derive.items()))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in derive}
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                for c, (_, f) in derive.items():
                    out[c].append(f(codec, ids))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | out, schema=arrow)
        trimmed()

    return in_small_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, schema)


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """doc_id and text of id lists; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(path)
        for batch in batches:
            texts = [None if x is None else codec.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("bigint"), F.col(ids).cast("array<bigint>")).mapInArrow(run, "doc_id bigint, text string")
