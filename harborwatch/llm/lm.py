"""Interpolated modified Kneser-Ney bigram model, counted in Spark, read from memory-mapped sorted arrays.

Counting takes three passes of bounded tasks. Words are counted by hash; the sorted array of word hashes numbers the
words. Pairs are counted by (number before, number): tasks count a stretch of text in numpy and send sorted runs to
shards by a hash of the pair, so a frequent word spreads over all shards and arrives as one row a run, not a row a
token. A shard merges its runs into one sorted array of pairs with counts, and sends on, by ranges of word numbers,
how many different words stand before each word (continuations) and how many pairs after it were seen once, twice and
more. A range's rows are summed in two steps, first those of some shards at a time, and each is added to the range's
arrays as it comes, so neither a task's work nor its memory grows with all pairs of a range. The driver gets a few sums a shard. Scoring maps the arrays and looks sorted keys up; nothing is broadcast.

The order is two: the model's store grows with the distinct pairs of the corpus, and so does the work.

Defined results: null text is empty, its only token is the end; words that training hasn't seen share one unknown
word; without training tokens every probability is 1; repeated rows count and are scored each; a null doc_id is
not held out; words are numbered in 32 bits, over 4.2e9 distinct words are an error; other columns don't matter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.store import HashStore, gathered, mapped, new_folder, put, shard_bits, write_store
from harborwatch.llm.words import Words, buffers, chunks, lean, mix, signed, small_batches, unsigned

U64 = np.uint64
END = U64(0x5BD1E9955BD1E995)
#: Tokens that a task counts before it sends a run, and tokens of a shard of pairs, about.
RUN_TOKENS = 2_000_000
SHARD_TOKENS = 3_000_000
#: Word numbers of a range.
RANGE = 1 << 20
SCORE_BYTES = 2 << 20


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text leaves 0 modulo 10."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes with END after each document, its n + 1 edges)."""
    data, offsets = buffers(column)
    for row, end in chunks(offsets, size):
        words = Words(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], lower=True)
        edges = words.first + np.arange(end - row + 1)
        out = np.empty(len(words) + end - row, dtype=U64)
        out[edges[1:] - 1] = END
        inner = np.ones(len(out), dtype=bool)
        inner[edges[1:] - 1] = False
        out[inner] = words.hash
        yield row, end, out, edges


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, for the shuffle's compression."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_run(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences, counts as they are."""
    return _planes(np.diff(keys, prepend=U64(0))), _planes(counts.astype(np.uint32))


def merge_runs(runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    keys = np.concatenate([np.cumsum(_unplanes(k, U64), dtype=U64) for k, _ in runs])
    counts = np.concatenate([_unplanes(c, np.uint32) for _, c in runs])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a partition sorted by its first column, group by group."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row["s"] != now:
                yield now, rows
                rows = []
            now = row["s"]
            rows.append(row)
    if rows:
        yield now, rows


def _kind_type(r: int):
    """Of the sums of a range (at most as many as there are words), and of the kinds of all pairs (range -1)."""
    return np.int64 if r < 0 else np.uint32


def _range_sums(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(range, sums by name) of rows (s, t, name, k, c) sorted by s and t, for each (s, t). A row is added as it comes."""
    now, sums = None, {}
    for batch in batches:
        for r, t, name, k, c in zip(*batch.columns, strict=True):
            r, t = r.as_py(), t.as_py()
            if now != (r, t):
                if now:
                    yield now[0], sums
                now, size = (r, t), min(RANGE, words + 1 - r * RANGE)
                sums = {"pairs": np.zeros(6, np.int64)} if r < 0 else {"before": np.zeros(size, np.int64), "after": np.zeros(size * 3, np.int64)}
            sums[name.as_py()][_unplanes(k.as_py(), np.uint32)] += _unplanes(c.as_py(), _kind_type(r))
    if now:
        yield now[0], sums


class Numbering:
    """Word hashes to numbers and counts, by the sorted array of all word hashes."""

    def __init__(self, store: HashStore, firsts: list[int]):
        self.store, self.firsts = store, firsts

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of sorted hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        bits = self.store.bits
        cuts = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=U64) << U64(64 - bits))
        cuts = np.concatenate([[0], cuts, [len(hashes)]])
        for n in np.flatnonzero(cuts[1:] > cuts[:-1]):
            keys, counts = self.store.shard(int(n))
            if not len(keys):
                continue
            part = hashes[cuts[n] : cuts[n + 1]]
            at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
            hit = keys[at] == part
            number[cuts[n] : cuts[n + 1]][hit] = at[hit] + self.firsts[n]
            count[cuts[n] : cuts[n + 1]][hit] = counts[at[hit]]
        return number, count

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some, at = np.unique(hashes, return_inverse=True)
        number, count = self.find(some)
        return number[at], count[at]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), top) for d, top in ((d1, 0.95), (d2, 1.95), (d3, 2.95)))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


@dataclass
class Model:
    """Where the arrays are, and the few numbers beside them."""

    folder: str
    numbering: Numbering
    pair_bits: int
    words: int
    total: int
    documents: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    continuations: int
    spread: float  # what the words' discounts leave to the uniform distribution
    pair_sizes: np.ndarray  # entries of each shard of pairs

    def ranged(self, name: str, numbers: np.ndarray, columns: int) -> np.ndarray:
        """Rows of the array by word number, read from its ranges. Numbers are sorted."""
        out = np.zeros((len(numbers), columns), dtype=np.int64)
        if not len(numbers):
            return out
        edges = np.flatnonzero(np.append(True, numbers[1:] // RANGE != numbers[:-1] // RANGE))
        for a, b in zip(edges, [*edges[1:], len(numbers)], strict=True):
            r = int(numbers[a]) // RANGE
            have = mapped(f"{self.folder}/{name}-{r}", np.uint32).reshape(-1, columns)
            if len(have):
                out[a:b] = have[numbers[a:b] - r * RANGE]
            elif self.total:  # a model that has learned from no text has no arrays
                raise OSError(f"{self.folder}/{name}-{r} is missing or empty")
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted pair keys."""
        store = HashStore(f"{self.folder}/pairs", self.pair_bits, "u4", self.pair_sizes)
        shard = (mix(keys) >> U64(64 - self.pair_bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        out = np.zeros(len(keys), dtype=np.int64)
        cuts = np.searchsorted(shard[order], np.arange((1 << self.pair_bits) + 1))
        for n in np.flatnonzero(cuts[1:] > cuts[:-1]):
            rows = order[cuts[n] : cuts[n + 1]]
            have, counts = store.shard(int(n))
            if len(have):
                at = np.minimum(np.searchsorted(have, keys[rows]), len(have) - 1)
                out[rows] = np.where(have[at] == keys[rows], counts[at], 0)
        return out

    def word_probability(self, number: np.ndarray) -> np.ndarray:
        """The lower order: continuation counts, discounted, over a uniform distribution. Numbers are sorted."""
        seen = np.zeros(len(number), dtype=np.int64)
        known = number >= 0
        seen[known] = self.ranged("before", number[known], 1)[:, 0]
        uniform = 1.0 / (self.words + 1)
        if not self.continuations:
            return np.full(len(number), uniform)
        return (seen - _discount(seen, self.word_discounts)) / self.continuations + self.spread * uniform

    def score(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, tokens, known tokens, base score, score) of stretches of a text column."""
        low = 0.1 / (self.total + 0.1 * (self.words + 1))
        for row, end, hashes, edges in tokens(column, SCORE_BYTES):
            some, at = np.unique(hashes, return_inverse=True)
            number, count = self.numbering.find(some)
            base = np.log10((count + 0.1) * (low / 0.1))
            order = np.argsort(number, kind="stable")
            lower = np.empty(len(some))
            lower[order] = self.word_probability(number[order])
            # What a word leaves to the lower order when it stands before.
            left, total = np.ones(len(some) + 1), np.zeros(len(some) + 1, dtype=np.int64)
            known = order[number[order] >= 0]
            total[known] = count[known]
            total[-1] = self.documents  # the beginning of a document, numbered after all words
            kinds = np.zeros((len(some) + 1, 3), dtype=np.int64)
            kinds[known] = self.ranged("after", number[known], 3)
            kinds[-1] = self.ranged("after", np.array([self.words]), 3)[0]
            some_total = total > 0
            left[some_total] = (kinds[some_total] @ np.array(self.pair_discounts)) / total[some_total]
            before = np.empty_like(at)
            before[1:] = at[:-1]
            before[edges[:-1]] = len(some)
            numbers = np.append(number, self.words)
            pair_known = (number[at] >= 0) & (numbers[before] >= 0)
            key = (numbers[before[pair_known]].astype(U64) << U64(32)) | number[at[pair_known]].astype(U64)
            keys, place = np.unique(key, return_inverse=True)
            c = np.zeros(len(at), dtype=np.int64)
            c[pair_known] = self.pairs(keys)[place]
            over = total[before]
            direct = np.where(over > 0, (c - _discount(c, self.pair_discounts)) / np.maximum(over, 1), 0.0)
            p = direct + left[before] * lower[at]
            add = lambda x: np.add.reduceat(x, edges[:-1])  # noqa: E731  every document has its end token
            yield row, end, np.diff(edges), add((count > 0)[at].astype(np.int64)), add(base[at]), add(np.log10(p))


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` into arrays in the shared folder."""
    spark = docs.sparkSession
    texts = small_batches(docs).select("text")
    folder = new_folder(spark, "ngrams")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def run() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], ["h", "n"])

        for batch in batches:
            for _, _, hashes, _ in tokens(batch.column(0), 1 << 20):
                parts.append(hashes)
                size += len(hashes)
                if size >= RUN_TOKENS:
                    yield run()
                    parts, size = [], 0
        if parts:
            yield run()

    counted = texts.mapInArrow(lean(count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    spark_counts = new_folder(spark, "words")
    counted.write.parquet(spark_counts)
    counted = spark.read.parquet(spark_counts)
    row = counted.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.max(F.when(F.col("h") == int(signed(np.array([END]))[0]), F.col("n"))).alias("d")).first()
    words, total, documents = row["v"], row["n"] or 0, row["d"] or 0
    if words >= 1 << 32:
        raise ValueError("more distinct words than 32 bits can number")
    store = write_store(counted, f"{folder}/words", "h", "n", "i8", words)
    sizes = {r["s"]: r["n"] for r in counted.groupBy(F.shiftrightunsigned("h", 64 - store.bits).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()}
    firsts = np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(1 << store.bits)])]).tolist()
    numbering = Numbering(store, firsts)
    bits = shard_bits(total, SHARD_TOKENS)
    salts = 1 << (bits + 1) // 2  # of a range's rows: the first sums take some shards, the second these sums, about equally many

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def run() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            shard = (mix(keys) >> U64(64 - bits)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order], shard[order]
            some, first = np.unique(shard, return_index=True)
            packed = [pack_run(keys[a:b], counts[a:b]) for a, b in zip(first, [*first[1:], len(keys)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(some), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], ["s", "k", "c"])

        for batch in batches:
            for _, _, hashes, edges in tokens(batch.column(0), 1 << 20):
                number, _ = numbering.of(hashes)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                before[edges[:-1]] = words
                parts.append((before.astype(U64) << U64(32)) | number.astype(U64))
                size += len(number)
                if size >= RUN_TOKENS:
                    yield run()
                    parts, size = [], 0
        if parts:
            yield run()

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_value(batches):
            keys, counts = merge_runs([(r["k"], r["c"]) for r in rows])
            put(f"{folder}/pairs/{shard}.records", [np.minimum(counts, 2**32 - 1).astype(np.uint32).tobytes()])
            put(f"{folder}/pairs/{shard}.keys", [keys.tobytes()])
            kinds = np.bincount(np.minimum(counts, 5), minlength=6)
            out = [(-1, "pairs", np.arange(6, dtype=np.uint32), kinds.astype(np.int64))]
            after, word = (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)
            out += [(r, "before", ids, n) for r, ids, n in _ranges(word)]
            out += [(r, "after", ids, n) for r, ids, n in _ranges(after * 3 + np.minimum(counts, 3) - 1, 3)]
            yield sums_batch(out, shard % salts)

    def sums_batch(rows: list[tuple[int, str, np.ndarray, np.ndarray]], salt: int) -> pa.RecordBatch:
        r, name, ids, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(r, pa.int64()), pa.array([salt] * len(rows), pa.int32()), pa.array(name, pa.string()),
            pa.array([_planes(x) for x in ids], pa.binary()), pa.array([_planes(x) for x in n], pa.binary()),
        ], ["s", "t", "name", "k", "c"])

    def sum_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, sums in _range_sums(batches, words):
            for name, n in sums.items():
                ids = np.flatnonzero(n)
                if len(ids):
                    yield sums_batch([(r, name, ids.astype(np.uint32), n[ids].astype(_kind_type(r)))], 0)

    def sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, sums in _range_sums(batches, words):
            if r < 0:
                yield pa.RecordBatch.from_arrays([pa.array(["pairs"]), pa.array([sums["pairs"].tolist()], pa.list_(pa.int64()))], ["name", "n"])
                continue
            seen = sums["before"]
            put(f"{folder}/before-{r}", [seen.astype(np.uint32).tobytes()])
            put(f"{folder}/after-{r}", [sums["after"].astype(np.uint32).tobytes()])
            n = [*np.bincount(np.minimum(seen, 5), minlength=6).tolist(), int(seen.sum())]
            yield pa.RecordBatch.from_arrays([pa.array(["words"]), pa.array([n], pa.list_(pa.int64()))], ["name", "n"])

    runs = texts.mapInArrow(lean(count_pairs), "s int, k binary, c binary").repartition(1 << bits, "s").sortWithinPartitions("s")
    fields = "s long, t int, name string, k binary, c binary"
    ranges = words // RANGE + 1
    some = runs.mapInArrow(lean(merge_pairs), fields).repartition(max(8, 2 * ranges * salts), "s", "t").sortWithinPartitions("s", "t").mapInArrow(lean(sum_some), fields)
    sums = some.repartition(max(8, 2 * ranges), "s").sortWithinPartitions("s", "t").mapInArrow(lean(sum_ranges), "name string, n array<long>")
    kinds = {"pairs": np.zeros(7, np.int64), "words": np.zeros(7, np.int64)}
    for r in sums.collect():  # a row for each range of a million words
        kinds[r["name"]][: len(r["n"])] += np.array(r["n"])
    pair_d, word_d = _discounts(kinds["pairs"][1:5].tolist()), _discounts(kinds["words"][1:5].tolist())
    continuations = int(kinds["words"][6])
    by_kind = kinds["words"]
    spread = (word_d[0] * by_kind[1] + word_d[1] * by_kind[2] + word_d[2] * by_kind[3:6].sum()) / continuations if continuations else 1.0
    files = [f"{folder}/pairs/{n}.records" for n in range(1 << bits)]
    pair_sizes = np.array([os.path.getsize(f) // 4 if os.path.exists(f) else 0 for f in files])
    if pair_sizes.sum() != kinds["pairs"].sum():
        raise OSError(f"{folder}/pairs holds {pair_sizes.sum()} of {kinds['pairs'].sum()} pairs")
    return Model(folder, numbering, bits, words, total, documents, pair_d, word_d, continuations, float(spread), pair_sizes)


def _ranges(keys: np.ndarray, per: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, keys from the range's beginning, how often) of keys that count ``per`` to a word number."""
    keys = np.sort(keys)
    if not len(keys):
        return
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    keys, sums = keys[first], np.diff(np.append(first, len(keys)))
    span = RANGE * per
    cut = np.flatnonzero(np.append(True, keys[1:] // span != keys[:-1] // span))
    for a, b in zip(cut, [*cut[1:], len(keys)], strict=True):
        r = int(keys[a] // span)
        yield r, (keys[a:b] - r * span).astype(np.uint32), sums[a:b].astype(np.uint32)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every text."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, n, known, base, score in model.score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, end - row), pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(end - row, model.total, np.int64)),
                    pa.array(base), pa.array(score), pa.array(10.0 ** np.minimum(-score / n, 300.0)),
                ], names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_held_out(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that aren't held out."""
    model = train(docs.filter(~held_out()))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
