"""Substring dedup: windows of words that occur anywhere else, found by backward search in FM-indexes of shards.

1. Routing. The key of a window is the least hash of the K-word grams in it, so equal windows have equal keys wherever
   they stand. Consecutive windows of one key form a segment. Spark counts segments by (key, hash of the segment). A key
   that was seen once holds no repeat; a segment seen twice is repeated as a whole.
2. Search. Keys with several different segments are contested. Their distinct segments are dealt to shards by key; a shard
   is one text, indexed by its Burrows-Wheeler transform in a wavelet tree (bit vectors with rank counts). Segments seen
   once are streamed against the index: a window is matched backwards, word by word, as long as its suffix-array interval
   holds two places, which is its matching statistic; windows whose statistic reaches the threshold are repeated.
   A key with very many segments (a passage in a third of all documents, in front of as many different sentences) isn't
   dealt to one shard: its windows are counted by their own hash, so that no task gathers different windows of a key.
3. Removal. The findings are a sorted hash array in the shared folder that tasks map, so every text is only read, cut
   into the same segments and looked up; texts are never shuffled.

Everything is found on the input; windows never span documents; words aren't changed.

Defined results: null text has no words; documents shorter than a window keep all words; repeated rows repeat each other;
texts of any length are worked whole; other columns stay (``remove_repeats``) or don't matter (``removal_digests``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.store import HashStore, new_folder, write_store
from harborwatch.llm.words import Prefix, Words, lean, signed, small_batches, word_chunks

U64 = np.uint64
WINDOW = 35
K = 8
PLACE_BITS = 24
#: Windows of a segment are at most WINDOW - K + 1, so that a bit mask holds them; longer windows take longer grams.
LONGEST = 32
#: Words of a shard's text, about, and segments of a key that are still dealt together.
SHARD_WORDS = 300_000
HOT_SEGMENTS = 200


class Segments:
    """The segments of some documents: first word, number of windows, key, and hash."""

    def __init__(self, words: Words, window: int):
        n = len(words)
        self.words, self.prefix, self.window = words, Prefix(words.hash), window
        k = max(min(K, window), window - LONGEST + 1)
        lengths = np.diff(words.first)
        count = np.maximum(lengths - window + 1, 0)  # windows of each document
        if not count.sum():
            self.start = self.windows = np.zeros(0, np.int64)
            self.key = self.hash = np.zeros(0, U64)
            return
        places = np.arange(n - k + 1)
        grams = self.prefix.hash(places, places + k)
        # The least gram of the window from each place on (also across documents), the first of equals: its place rides
        # in the low bits. Windows with their least gram in one place are a segment, so no segment holds equal windows.
        low = U64((1 << PLACE_BITS) - 1)
        least = _sliding_least((grams & ~low) | (places.astype(U64) & low), window - k + 1)
        first = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place = first + (((least[first] & low).astype(np.int64) - first) & int(low))
        new = np.ones(len(first), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)
        run = np.flatnonzero(new)
        self.start, self.key = first[run], grams[place[run]]
        self.windows = np.diff(np.append(run, len(first)))
        self.hash = self.prefix.hash(self.start, self.start + self.windows + window - 1)

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, first word, hash) of each window of some segments."""
        count = self.windows[which]
        owner = np.repeat(which, count)
        first = self.start[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return owner, first, self.prefix.hash(first, first + self.window) ^ U64(1)  # not the hash of a segment of one window


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of each ``size`` neighbours, by doubling."""
    have, span = x, 1
    while span * 2 <= size:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = size - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


class BitVector:
    """Bits with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, dtype=U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Backward search over one text of small integers (0 ends a piece; only 0 isn't a word)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.n = len(text)
        order = _suffix_order(text, depth)
        last = text[order - 1]  # the transform; the text is a ring whose pieces all end in 0
        self.bits = max(1, int(text.max(initial=0)).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=(1 << self.bits)))])
        self.levels, self.zeros = [], []
        row = last
        for level in range(self.bits - 1, -1, -1):  # a wavelet tree kept level by level
            bit = (row >> level) & 1
            self.levels.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(len(row) - self.levels[-1].ones)
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros_like(at), at
        for k, (vector, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1 == 1
            low_ones, high_ones = vector.rank(low), vector.rank(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches one symbol longer to the left."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        at = self.first[symbol]
        return at + both[: len(symbol)], at + both[len(symbol) :]

    def matched(self, text: np.ndarray, ends: np.ndarray, longest: int) -> np.ndarray:
        """The matching statistic of each end: the longest stretch up to it that the index holds twice, ``longest`` at most."""
        found = np.zeros(len(ends), dtype=np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), self.n)
        for length in range(1, longest + 1):
            low, high = self.extend(low, high, text[ends[alive] - length])
            keep = high - low >= 2
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
            found[alive] = length
        return found


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of the ring ordered by the ``depth`` symbols from them on, or more: prefix doubling."""
    rank, span = text.astype(np.int64), 1
    while True:
        pair = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -span) if span < depth else rank
        order = np.argsort(pair, kind="stable")
        if span >= depth:
            return order
        pair = pair[order]
        new = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        rank = np.empty_like(rank)
        rank[order] = new
        span *= 2


def _search(hashes: list[np.ndarray], seen: np.ndarray, window: int) -> list[int]:
    """For each segment of a shard (32-bit word hashes), the mask of its windows that occur twice in the shard.

    A segment that was seen more than once is all repeated, and stands twice in the index.
    """
    lengths = np.array([len(h) for h in hashes])
    words, text = np.unique(np.concatenate(hashes), return_inverse=True)
    text = text + 1
    edges = np.concatenate([[0], np.cumsum(lengths + 1)])
    ring = np.zeros(edges[-1], dtype=np.int64)
    inner = np.ones(len(ring), dtype=bool)
    inner[edges[1:] - 1] = False
    ring[inner] = text
    windows = lengths - window + 1
    once = np.flatnonzero(seen == 1)
    ask = np.repeat(once, windows[once])
    first = edges[ask] + np.arange(len(ask)) - np.repeat(np.cumsum(windows[once]) - windows[once], windows[once])
    index = FMIndex(ring, window)
    # A window's own place is in the index; a second one makes it repeated. A place in a segment that was seen twice
    # is already one beside the window's own.
    hit = index.matched(ring, first + window, window) >= window
    masks = [(1 << int(w)) - 1 if s > 1 else 0 for w, s in zip(windows, seen, strict=True)]
    for segment, at in zip(ask[hit].tolist(), (first - edges[ask])[hit].tolist(), strict=True):
        masks[segment] |= 1 << at
    return masks


def _count_segments(texts: DataFrame, window: int) -> DataFrame:
    """(key, segment, n): segments of all texts, counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for _, _, _, words in word_chunks(batch.column(0), lower=False):
                s = Segments(words, window)
                keys.append(s.key)
                hashes.append(s.hash)
            if keys:
                keys, hashes = np.concatenate(keys), np.concatenate(hashes)
                some, at, n = np.unique(hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[at])), pa.array(signed(some)), pa.array(n)], ["key", "segment", "n"])

    found = texts.mapInArrow(lean(run), "key long, segment long, n long")
    return found.groupBy("key", "segment").agg(F.sum("n").alias("n"))


#: What the store says of a segment: search it, or look its windows up one by one.
SEARCH, WINDOWS = 1 << 62, 1 << 61


def _contested_rows(texts: DataFrame, store: HashStore, window: int) -> DataFrame:
    """(deal, id, n, words): segments to be searched with the key they are dealt by, and windows of hot keys, which are
    dealt by their own hash and need no words."""
    names = ["deal", "id", "n", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, words in word_chunks(batch.column(0), lower=False):
                s = Segments(words, window)
                order = np.argsort(s.hash)
                state = np.zeros(len(order), dtype=np.int64)
                state[order] = store.find(s.hash[order])
                short = (words.hash >> U64(32)).astype(np.uint32)
                some = np.flatnonzero((state & SEARCH) > 0)
                if len(some):
                    _, at, count = np.unique(s.hash[some], return_index=True, return_counts=True)
                    at = some[at]
                    ends = s.start[at] + s.windows[at] + window - 1
                    pieces = [short[a:b].tobytes() for a, b in zip(s.start[at].tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(s.key[at])), pa.array(signed(s.hash[at])), pa.array(count), pa.array(pieces, pa.binary())], names)
                hot = np.flatnonzero((state & WINDOWS) > 0)
                if len(hot):
                    some, count = np.unique(s.window_hashes(hot)[2], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(some)), pa.array(signed(some)), pa.array(count), pa.nulls(len(some), pa.binary())], names)

    return texts.mapInArrow(lean(run), "deal long, id long, n long, words binary")


def _search_shards(rows: DataFrame, window: int, shards: int) -> DataFrame:
    """(id, mask) of segments that repeat, by the index of each shard, and of windows (without words), by their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(ids: list, n: list, words: list) -> pa.RecordBatch:
            masks = _search([np.frombuffer(w, np.uint32) for w in words], np.array(n), window)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([m if m < 1 << 63 else m - (1 << 64) for m in masks], pa.int64())], ["id", "mask"])

        ids, n, words, size, now = [], [], [], 0, None
        for batch in batches:
            windows = batch.column(3).is_null()
            if windows.true_count:
                hot = batch.filter(windows)
                yield pa.RecordBatch.from_arrays([hot.column(1), pa.array(np.ones(len(hot), np.int64))], ["id", "mask"])
                batch = batch.filter(batch.column(3).is_valid())
            for d, i, k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if size > 4 * SHARD_WORDS and d != now:  # keys stay whole
                    yield shard(ids, n, words)
                    ids, n, words, size = [], [], [], 0
                now = d
                ids.append(i)
                n.append(k)
                words.append(w)
                size += len(w)
        if ids:
            yield shard(ids, n, words)

    # Equal windows have one id, so a window's count says all; those that stand once go before the shuffle.
    dealt = rows.select("deal", "id", "n", "words").filter("words is not null or n > 1").repartition(shards, "deal").sortWithinPartitions("deal")
    return dealt.mapInArrow(lean(run), "id long, mask long").filter("mask != 0")


def find_repeats(docs: DataFrame, window: int = WINDOW, text_col: str = "text") -> HashStore:
    """The sorted array of what repeats: segment hash to the mask of its repeated windows (or WINDOWS, and then window
    hash to 1)."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(text_col).alias("text"))
    path = new_folder(spark, "segments")
    _count_segments(texts, window).write.parquet(path)
    segments = spark.read.parquet(path)
    keys = segments.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("segment").alias("one")).filter("total > 1")
    keys_path = new_folder(spark, "keys")
    keys.write.parquet(keys_path)
    keys = spark.read.parquet(keys_path)
    # One segment under a key, seen more than once: all its windows repeat, and there is nothing to compare it with.
    alone = keys.filter("kinds = 1").select(F.col("one").alias("segment"), F.lit(-1).cast("long").alias("state"))
    several = segments.join(keys.filter("kinds > 1").select("key", "kinds"), "key").select(
        "segment", F.when(F.col("kinds") > HOT_SEGMENTS, F.lit(WINDOWS)).otherwise(F.lit(SEARCH)).cast("long").alias("state")
    )
    sizes = keys.agg(F.count("*").alias("n"), F.sum(F.when(F.col("kinds") > 1, F.col("kinds"))).alias("contested")).first()
    contested = sizes["contested"] or 0
    todo = write_store(several, new_folder(spark, "contested"), "segment", "state", "i8", contested)
    rows = _contested_rows(texts, todo, window)
    once = rows.groupBy("id").agg(F.first("deal").alias("deal"), F.sum("n").alias("n"), F.first("words").alias("words"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), contested * 50 // (4 * SHARD_WORDS))
    masks = _search_shards(once, window, shards).select(F.col("id").alias("segment"), F.col("mask").alias("state"))
    hot = several.filter(F.col("state") == WINDOWS)
    masks_path = new_folder(spark, "repeats")
    masks.unionByName(alone).unionByName(hot).write.parquet(masks_path)
    repeats = spark.read.parquet(masks_path)
    return write_store(repeats, new_folder(spark, "found"), "segment", "state", "i8", repeats.count())


def covered(words: Words, store: HashStore, window: int) -> np.ndarray:
    """Which words stand in a repeated window."""
    s = Segments(words, window)
    delta = np.zeros(len(words) + 1, dtype=np.int64)
    if not len(s.start):
        return delta[:-1] > 0
    order = np.argsort(s.hash)
    state = np.zeros(len(order), dtype=np.int64)
    state[order] = store.find(s.hash[order])
    first = []
    masked = np.flatnonzero((state != 0) & ((state & WINDOWS == 0) | (state == -1)))
    if len(masked):
        bits = (state[masked, None] >> np.arange(LONGEST)) & 1
        bits &= np.arange(LONGEST) < s.windows[masked, None]
        row, at = np.nonzero(bits)
        first.append(s.start[masked[row]] + at)
    hot = np.flatnonzero((state & WINDOWS > 0) & (state != -1))
    if len(hot):
        _, start, hashes = s.window_hashes(hot)
        order = np.argsort(hashes)
        first.append(start[order][store.find(hashes[order]) != 0])
    for begin in first:
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + window, -1)
    return np.cumsum(delta[:-1]) > 0


def removal_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): kept words joined by one space."""
    store = find_repeats(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, words in word_chunks(batch.column(1), lower=False):
                gone = covered(words, store, window)
                sums = np.concatenate([[0], np.cumsum(gone)])
                kept = [hashlib.sha256(t).hexdigest() for t in _kept(data, words, ~gone)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(np.diff(words.first)), pa.array(np.diff(sums[words.first])), pa.array(kept)],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(data: np.ndarray, words: Words, keep: np.ndarray) -> Iterator[bytes]:
    """Each document's kept words, joined by one space."""
    raw = data.tobytes()
    start, end = words.start.tolist(), words.end.tolist()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        yield b" ".join([raw[start[k] : end[k]] for k in (a + np.flatnonzero(keep[a:b])).tolist()])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, their texts without repeated words. A text without any is left as it is; one that loses words has
    the rest joined by one space."""
    store = find_repeats(docs, window)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, words in word_chunks(batch.column(at), lower=False):
                part = batch.slice(row, end - row)
                gone = covered(words, store, window)
                if gone.any():
                    touched = np.add.reduceat(np.append(gone, 0), words.first[:-1]) > 0
                    touched &= np.diff(words.first) > 0
                    texts = part.column(at).to_pylist()
                    for k, text in enumerate(_kept(data, words, ~gone)):
                        if touched[k]:
                            texts[k] = text.decode()
                    part = part.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
                yield part

    return docs.mapInArrow(lean(run), docs.schema)
