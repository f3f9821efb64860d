"""Words of an Arrow text column and 64-bit hashes of word sequences, as flat numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. Hashes are polynomials over words (or bytes)
modulo 2**64, so the hash of any stretch of words comes from two prefix sums. All arithmetic wraps.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
#: Bytes of a batch between Spark and Python.
BATCH_BYTES = 4 << 20
#: Bytes of text that are worked on at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64 - 1, 256, dtype=U64)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2**64, grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; from now on its session sends batches of BATCH_BYTES to Python, where it sent larger ones.

    By default a batch is 10 000 rows or 64 MB, which a task holds twice beside its arrays: too much of an executor's memory
    where rows are whole texts.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        large = int(conf.get(name).rstrip("bB")) > BATCH_BYTES
    except ValueError:
        large = False  # somebody's own setting, with a unit
    if large:
        conf.set(name, str(BATCH_BYTES))
    return df


def lean(run):
    """A task function that gives free memory back when its task ends: a worker lives on between tasks, and its pools with it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


_INVERSE = pow(_BASE, -1, 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Hashes of stretches of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, dtype=U64)
        np.cumsum(values * _power(_BASE, self.n), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal stretches have equal hashes wherever they stand; the length is part of the hash."""
        raw = (self.sums[end] - self.sums[start]) * _power(_INVERSE, self.n + 1)[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 byte offsets of a string column; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not (pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type)):
        texts = texts.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    parts = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(parts[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], dtype=np.uint8) if parts[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, at least one row each."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end
        row = end


class Words:
    """The words of some documents: byte spans, hashes, and ``first``, the first word of each document (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        space = _SPACE[data]
        inside = ~space
        begin = inside.copy()
        begin[1:] &= space[:-1]
        last = inside.copy()
        last[:-1] &= space[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = inside[cut]  # a document ends where the next begins
        last[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = Prefix((_LOWER_BYTE if lower else _BYTE)[data]).hash(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)


def word_chunks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, Words]]:
    """(first row, end row, bytes, words) of stretches of a column."""
    data, offsets = buffers(texts)
    for row, end in chunks(offsets):
        part = data[offsets[row] : offsets[end]]
        yield row, end, part, Words(part, offsets[row : end + 1] - offsets[row], lower)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(U64)
