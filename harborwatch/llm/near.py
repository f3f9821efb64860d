"""MinHash near-dedup with sequential Bayesian verification.

Documents are sets of word shingles. Equal sets are one class, found by a hash of the set, so copies cost nothing further.
Each class has a signature of BANDS * ROWS minima; classes that share a band are candidates. Their signatures are compared
a batch of minima at a time; a pair goes as soon as the posterior probability that its similarity reaches the threshold,
given the matches so far and a uniform prior, is below ``miss``. Survivors are verified on their full sets, except pairs
that verified links have joined already: these can't change a component.

Signatures and the sets of classes that share a band are sorted arrays in the shared folder that tasks map, so shuffles
carry hashes only. A bucket of a band is cut into tiles of TILE classes and each pair of tiles is a task's work by itself,
so no task gathers a bucket; nothing is sampled or capped. A task returns as many links as join what it has compared.

With 30 bands of 5 rows a pair of similarity 0.85 shares no band with a probability of 3e-8.

Defined results: null and empty texts and texts without words have no shingles and link with nothing; texts under ``size``
words are one shingle; rows of equal doc_id are one document for links; rows of null doc_id link with nothing and are
kept; ties go to the smallest doc_id; other columns stay (``deduplicate``) or don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.graph import Joined, components, group_pairs
from harborwatch.llm.store import BlobStore, new_folder, write_blobs, write_store
from harborwatch.llm.words import Prefix, lean, mix, signed, small_batches, unsigned, word_chunks
from harborwatch.session import staged

U64, U32 = np.uint64, np.uint32
SIZE = 5
BANDS, ROWS = 30, 5
BATCH = 30
TILE = 128
#: Pairs that are compared at once.
PAIRS = 200_000
_SEED = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_XOR = (_SEED[: BANDS * ROWS] >> U64(32)).astype(U32)
_ODD = (_SEED[BANDS * ROWS :] >> U64(32)).astype(U32) | U32(1)


def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """(minima compared, least matches) that keep the posterior of similarity >= threshold at ``miss`` or more."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(batch, total + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        above = p[:, s >= threshold].sum(axis=1) / p.sum(axis=1)
        out.append((n, int(np.argmax(above >= miss))))
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes of each document in a row, their n + 1 edges)."""
    for row, end, _, words in word_chunks(column, lower=True):
        prefix = Prefix(words.hash)
        sets = []
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= size:
                at = np.arange(a, b - size + 1)
                sets.append(np.unique(prefix.hash(at, at + size)))
            else:
                sets.append(prefix.hash(np.array([a]), np.array([b])) if b > a else np.zeros(0, U64))
        edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        yield row, end, np.concatenate(sets), edges


def set_hashes(flat: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; sums, so that order doesn't matter. Empty sets have 0."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(flat ^ U64(salt)), dtype=U64)])
        part = sums[edges[1:]] - sums[edges[:-1]]
        out.append(np.where(np.diff(edges) > 0, mix(part + np.diff(edges).astype(U64)), U64(0)))
    return out[0], out[1]


def signatures(flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The minima of each set (sets x BANDS * ROWS); empty sets have the greatest value."""
    out = np.full((len(edges) - 1, BANDS * ROWS), U32(0xFFFFFFFF))
    some = np.diff(edges) > 0
    if some.any():
        x, at = (flat >> U64(32)).astype(U32), edges[:-1][some]
        block = np.empty_like(x)
        for k in range(BANDS * ROWS):
            np.bitwise_xor(x, _XOR[k], out=block)
            np.multiply(block, _ODD[k], out=block)
            out[some, k] = np.minimum.reduceat(block, at)
    return out


def _profiles(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, a, b, n, record): hashes and size of each set, its minima (a byte each) and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, flat, edges in shingle_sets(batch.column(1), size):
                a, b = set_hashes(flat, edges)
                minima = signatures(flat, edges)
                bands = np.empty((end - row, BANDS), dtype=U64)
                for k in range(BANDS):
                    value = np.full(end - row, k + 1, dtype=U64)
                    for j in range(ROWS):
                        value = mix(value ^ minima[:, k * ROWS + j].astype(U64)) + U64(j)
                    bands[:, k] = value
                short = ((minima * U32(0x9E3779B1)) >> U32(24)).astype(np.uint8)
                records = [bands[k].tobytes() + short[k].tobytes() for k in range(end - row)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row), pa.array(signed(a)), pa.array(signed(b)), pa.array(np.diff(edges)), pa.array(records, pa.binary()),
                    pa.array(list(signed(bands)), pa.list_(pa.int64())),
                ], ["doc_id", "a", "b", "n", "record", "bands"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, a long, b long, n long, record binary, bands array<long>")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays of a sorted partition, stretch by stretch, no group torn."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        now = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        if held:
            now = {k: np.concatenate([held[k], v]) for k, v in now.items()}
        n = len(now[keys[0]])
        if not n:
            continue
        same = np.ones(n, dtype=bool)
        for k in keys:
            same &= now[k] == now[k][-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield {k: v[:cut] for k, v in now.items()}
        held = {k: v[cut:] for k, v in now.items()}
    if held and len(held[keys[0]]):
        yield held


def group_starts(rows: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    new = np.zeros(len(rows[keys[0]]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= rows[k][1:] != rows[k][:-1]
    return np.flatnonzero(new)


def _links(tiles: DataFrame, profiles: BlobStore, sets: BlobStore, percent: int, miss: float) -> DataFrame:
    """(u, v): classes whose similarity is verified, enough of them to join all that are linked."""
    steps = least_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        keys = ["band", "low", "high"]
        for rows in _whole_groups(batches, keys):
            classes, which = np.unique(rows["a"].view(U64), return_inverse=True)
            table = np.stack([profiles.get(int(c), np.uint8) for c in classes])
            bands = np.ascontiguousarray(table[:, : 8 * BANDS]).view(np.int64)
            minima = table[:, 8 * BANDS :]
            u, v = [], []
            for left, right in group_pairs(group_starts(rows, keys), len(which), PAIRS):
                # In a pair of different tiles only what stands in different ones; the same tile is a task of its own.
                apart = (rows["low"][left] == rows["high"][left]) | (rows["tile"][left] != rows["tile"][right])
                left, right = left[apart], right[apart]
                x, y = which[left], which[right]
                # The first band that two classes share is where they are compared.
                here = rows["band"][left]
                first = np.argmax(bands[x] == bands[y], axis=1)
                mine = bands[x, first] == here
                x, y = x[mine], y[mine]
                matches = np.zeros(len(x), dtype=np.int64)
                for n, least in steps:
                    matches += (minima[x, n - BATCH : n] == minima[y, n - BATCH : n]).sum(axis=1)
                    keep = matches >= least
                    x, y, matches = x[keep], y[keep], matches[keep]
                best = np.argsort(-matches, kind="stable")
                for i, j in zip(x[best].tolist(), y[best].tolist(), strict=True):
                    if joined.root(int(classes[i])) == joined.root(int(classes[j])):
                        continue
                    one, two = sets.get(int(classes[i]), U64), sets.get(int(classes[j]), U64)
                    if len(one) > len(two):
                        one, two = two, one
                    if 100 * len(one) < percent * len(two):
                        continue
                    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                    common = int((two[at] == one).sum())
                    if 100 * common >= percent * (len(one) + len(two) - common):
                        joined.join(int(classes[i]), int(classes[j]))
                        u.append(classes[i])
                        v.append(classes[j])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(u, U64))), pa.array(signed(np.array(v, U64)))], ["u", "v"])

    return tiles.mapInArrow(lean(run), "u long, v long")


def near_groups(docs: DataFrame, percent: int = 85, size: int = SIZE, miss: float = 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    spark = docs.sparkSession
    every = staged(_profiles(docs, size), "profiles")
    usable = every.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")
    banded = classes.select("a", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    rows = staged(banded.join(shared, "band"), "bands")
    needed = classes.join(rows.select("a").distinct(), "a", "left_semi")
    n = needed.count()
    owners = write_store(needed.select("a", "id"), new_folder(spark, "owners"), "a", "id", "i8", n)

    def wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            for row, end, flat, edges in shingle_sets(batch.column(1), size):
                a, _ = set_hashes(flat, edges)
                order = np.argsort(a)
                owner = np.empty(len(a), dtype=np.int64)
                none = np.iinfo(np.int64).min
                owner[order] = owners.find(a[order], none)
                mine = np.flatnonzero((owner == ids[row:end]) & (owner != none) & (np.diff(edges) > 0))
                if len(mine):
                    blobs = [flat[edges[k] : edges[k + 1]].tobytes() for k in mine]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(a[mine])), pa.array(blobs, pa.binary())], ["a", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), n // 5_000)
    sets = write_blobs(texts.mapInArrow(lean(wanted_sets), "a long, set binary").dropDuplicates(["a"]), new_folder(spark, "sets"), "a", "set", parts)
    records = usable.join(needed.select("a", "b"), ["a", "b"], "left_semi").groupBy("a").agg(F.first("record").alias("record"))
    profiles = write_blobs(records, new_folder(spark, "records"), "a", "record", parts)
    tiles = rows.withColumn("parts", F.ceil(F.col("members") / TILE).cast("int"))
    tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("a"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("band", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "a")
    tiles = tiles.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "a")
    links = staged(_links(tiles, profiles, sets, percent, miss).distinct(), "links")
    ids = classes.select("a", "id")
    edges = links.join(ids.select(F.col("a").alias("u"), F.col("id").alias("x")), "u").join(ids.select(F.col("a").alias("v"), F.col("id").alias("y")), "v")
    roots = components(edges.select(F.col("x").alias("u"), F.col("y").alias("v")))
    # A class's component; an id with several texts takes the least of theirs.
    same = usable.join(classes.select("a", "b", "id"), ["a", "b"])
    again = same.filter("doc_id != id").groupBy("doc_id").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least != most")
    if again.limit(1).count():
        roots = components(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(same.join(again, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))))
    rooted = classes.select("a", "b", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("a", "b", F.coalesce("root", "id").alias("root"))
    out = every.select("doc_id", "a", "b", F.col("n").alias("n_shingles")).join(rooted, ["a", "b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, size: int = SIZE) -> DataFrame:
    """The documents of smallest doc_id of their groups; rows of equal doc_id stay or go together.

    The ids that go are a sorted array that tasks map, so texts aren't shuffled.
    """
    spark = docs.sparkSession
    groups = near_groups(docs, percent, size)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(unsigned(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(np.ones(len(keys), np.int64))], ["k", "one"])

    gone = staged(groups.filter(~F.col("kept")).select("doc_id").distinct().mapInArrow(lean(hashed), "k long, one long"), "gone")
    store = write_store(gone, new_folder(spark, "gone-ids"), "k", "one", "i1", gone.count())
    at = docs.columns.index("doc_id")

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            known = np.array(ids.is_valid())
            keep = store.find(mix(unsigned(ids.cast(pa.int64()).fill_null(0).to_numpy()))) == 0
            yield batch.filter(pa.array(keep | ~known))

    return small_batches(docs).mapInArrow(lean(stay), docs.schema)
