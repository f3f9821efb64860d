"""Sorted hash arrays in the shared folder, memory-mapped by the tasks that look keys up.

A store is a folder of shards by the leading bits of a 64-bit key. A shard is a file of sorted keys and one
file of equally many records. Tasks write under a name of their own and rename, so a repeated task leaves
whole files. Executors must reach ``spark.checkpoint.dir`` as a path (a mounted file system); another kind of
folder is an error, not a partial result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.session import scratch_path

U64 = np.uint64
#: Keys of a shard, about; a task holds a few shards at most.
SHARD_KEYS = 1_000_000


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared place; tasks make the folder itself."""
    path = scratch_path(spark, label)
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"executors must reach spark.checkpoint.dir as a path, not {path}")
    return path


def put(path: str, parts: list) -> None:
    """Write a file whole or not at all."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as out:
        for part in parts:
            out.write(part)
    os.replace(own, path)


def mapped(path: str, dtype, n: int | None = None) -> np.ndarray:
    """A file as a read-only array; pages are read when touched. ``n`` is the known number of entries: a missing or
    shorter file is an error then, and not an empty array."""
    if n == 0 or n is None and (not os.path.exists(path) or os.path.getsize(path) == 0):
        return np.zeros(0, dtype=dtype)
    out = np.memmap(path, dtype=dtype, mode="r")
    if n is not None and len(out) != n:
        raise OSError(f"{path} holds {len(out)} of {n} entries")
    return out


def gathered(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """All rows of a partition as arrays; for partitions whose size the caller has bounded."""
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for batch in batches:
        for k, name in enumerate(names):
            parts[k].append(np.array(batch.column(name).to_numpy(zero_copy_only=False)))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def shard_bits(rows: int, per_shard: int = SHARD_KEYS) -> int:
    """Leading bits that deal ``rows`` keys into shards of about ``per_shard``."""
    return max(3, int(np.ceil(np.log2(max(1, rows / per_shard)))))


def shard_of(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int")


def write_store(df: DataFrame, folder: str, key: str, record: str, dtype: str, rows: int) -> "HashStore":
    """Sort rows of distinct long ``key`` and numeric ``record`` into a store. ``rows`` sizes the shards.

    The driver gets the size of each shard, one number for about SHARD_KEYS rows.
    """
    bits = shard_bits(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, records = gathered(batches, ["k", "r"])
        keys = keys.astype(np.int64).view(U64)
        order = np.argsort(keys, kind="stable")
        keys, records = keys[order], records[order].astype(dtype)
        shards = (keys >> U64(64 - bits)).astype(np.int64)
        some = np.unique(shards)
        cuts = np.searchsorted(shards, [*some, 1 << bits])
        for shard, lo, hi in zip(some, cuts, cuts[1:], strict=False):
            put(f"{folder}/{shard}.records", [records[lo:hi].tobytes()])
            put(f"{folder}/{shard}.keys", [keys[lo:hi].tobytes()])
        yield sizes_batch(some, np.diff(cuts))

    wide = df.select(F.col(key).alias("k"), F.col(record).alias("r"), shard_of(F.col(key), bits).alias("s"))
    written = wide.repartition(1 << bits, "s").select("k", "r").mapInArrow(write, "s long, n long").collect()
    return HashStore(folder, bits, dtype, sizes_of(written, bits))


def sizes_batch(shards, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(sizes, pa.int64())], ["s", "n"])


def sizes_of(written: list, bits: int) -> np.ndarray:
    """Entries of each shard, 0 where none was written."""
    sizes = np.zeros(1 << bits, dtype=np.int64)
    for r in written:
        sizes[r["s"]] += r["n"]
    return sizes


class HashStore:
    """Look keys up in a store; usable in tasks. A shard that isn't there as it was written is an error."""

    def __init__(self, folder: str, bits: int, dtype: str, sizes: np.ndarray):
        self.folder, self.bits, self.dtype, self.sizes, self._open = folder, bits, dtype, sizes, {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def shard(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self._open:
            at, size = f"{self.folder}/{n}", int(self.sizes[n])
            self._open[n] = mapped(f"{at}.keys", U64, size), mapped(f"{at}.records", self.dtype, size)
        return self._open[n]

    def find(self, keys: np.ndarray, default=0) -> np.ndarray:
        """The record of each key, ``default`` where there is none. Sorted keys are fastest."""
        out = np.full(len(keys), default, dtype=self.dtype)
        order = None
        if len(keys) > 1 and not (keys[1:] >= keys[:-1]).all():
            order = np.argsort(keys)
            keys = keys[order]
        found = out if order is None else np.full(len(keys), default, dtype=self.dtype)
        edges = np.arange(1, 1 << self.bits, dtype=U64) << U64(64 - self.bits)
        cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        for n in np.flatnonzero(cuts[1:] > cuts[:-1]):
            have, records = self.shard(int(n))
            if len(have) == 0:
                continue
            part = keys[cuts[n] : cuts[n + 1]]
            at = np.minimum(np.searchsorted(have, part), len(have) - 1)
            hit = have[at] == part
            found[cuts[n] : cuts[n + 1]][hit] = records[at[hit]]
        if order is not None:
            out[order] = found
        return out


def write_blobs(df: DataFrame, folder: str, key: str, blob: str, shards: int) -> "BlobStore":
    """Sort rows of distinct long ``key`` and binary ``blob`` into ``shards`` (a power of two) files."""
    bits = max(1, int(np.ceil(np.log2(shards))))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for s, k, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(s, []).append((k % (1 << 64), b))
        for s, part in rows.items():
            part.sort()
            ends = np.cumsum([0, *(len(b) for _, b in part)]).astype("<i8")
            put(f"{folder}/{s}.data", [b for _, b in part])
            put(f"{folder}/{s}.ends", [ends.tobytes()])
            put(f"{folder}/{s}.keys", [np.array([k for k, _ in part], dtype=U64).tobytes()])
        yield sizes_batch(list(rows), [len(part) for part in rows.values()])

    wide = df.select(shard_of(F.col(key), bits).alias("s"), F.col(key).alias("k"), F.col(blob).alias("b"))
    written = wide.repartition(1 << bits, "s").mapInArrow(write, "s long, n long").collect()
    return BlobStore(folder, bits, sizes_of(written, bits))


class BlobStore:
    """Look the bytes of keys up. A shard that isn't there as it was written is an error."""

    def __init__(self, folder: str, bits: int, sizes: np.ndarray):
        self.folder, self.bits, self.sizes, self._open = folder, bits, sizes, {}

    def __getstate__(self):
        return {**self.__dict__, "_open": {}}

    def get(self, key: int, dtype) -> np.ndarray | None:
        """The bytes of an unsigned key as an array, mapped."""
        n = key >> (64 - self.bits)
        if n not in self._open:
            at, size = f"{self.folder}/{n}", int(self.sizes[n])
            ends = mapped(f"{at}.ends", "<i8", size + 1 if size else 0)
            self._open[n] = mapped(f"{at}.keys", U64, size), ends, mapped(f"{at}.data", np.uint8, int(ends[-1]) if size else 0)
        keys, ends, data = self._open[n]
        at = int(np.searchsorted(keys, U64(key)))
        if at == len(keys) or int(keys[at]) != key:
            return None
        return data[int(ends[at]) : int(ends[at + 1])].view(dtype)
