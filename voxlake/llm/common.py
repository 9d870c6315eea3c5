"""What the operators share: table access, tables written between jobs, Arrow helpers and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.tables import dropped, shared_dir, stored_bytes, table, written

__all__ = ["dropped", "shared_dir", "stored_bytes", "table", "written"]

#: Bytes of text that one vectorised step works on; longer single documents form a piece of their own.
PIECE_BYTES = 1 << 20


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    _, at, data = col.buffers()
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(raw: np.ndarray, offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows of at most `most` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SEED = np.random.default_rng(20240229)
BYTE_CODE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i mod 2**64 for i < n, kept while short."""
    if len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        both = []
        for base in (_P, _P_INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        if size > 4 * PIECE_BYTES:
            return both[0][:n], both[1][:n]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Wrapping prefix sums of code(byte i) * P**i; len + 1 values."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words, runs of bytes other than 0x20 and 0x09-0x0D that stay in their row."""
    word = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = word.copy(), word.copy()
    if len(data):
        first[1:] &= ~word[:-1] | cut[1:-1]
        last[:-1] &= ~word[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


#: Ids that a join may send to every executor: at most 32 MB.
BROADCAST_IDS = 4_000_000


def by_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """rows left_semi or left_anti joined with the different `key` values of `ids`; up to BROADCAST_IDS of them go to the rows, more meet them in a shuffle."""
    held = written(ids.select(key).where(F.col(key).isNotNull()).distinct(), "ids")
    return rows.join(F.broadcast(held) if held.count() <= BROADCAST_IDS else held, key, how)


def crc32_text(col) -> object:
    """Spark's crc32 of a key as decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary")) if isinstance(col, str) else F.crc32(col.cast("string").cast("binary"))


#: Rows and bytes of text that travel to a Python worker at once.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def in_small_batches(texts: DataFrame, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> DataFrame:
    """`texts`, with the session's Arrow batches bounded: Spark's defaults would hold 64 MB on both sides for each task."""
    conf = texts.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(str(conf.get(key)).removesuffix("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return texts


def trimmed() -> None:
    """Gives a worker's free memory back to its machine at the end of a task; workers are used again and share their executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def one_thread() -> None:
    """Python workers share their machine's cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
