"""Fingerprints by a randomised edit embedding.

A shared random function of (step, character) decides whether a walk over a text stays on its character or moves on;
the characters that the walk shows step by step are the embedding, in which an edit shifts the walk only until it
meets the other text's walk again, so edit distance becomes Hamming distance. The bits depend on the step modulo
PERIOD, so one table gives the steps that a character takes from each step on, and a walk is one look-up a character.

A fingerprint samples SLOTS steps of the embedding. Slot k takes the step below the walk's end whose shared random
rank is least, so texts of nearly equal length sample the same steps, and long texts are sampled to their end. It
keeps a byte of the (step, character) there. The share of equal bytes estimates the likeness.

Defined results: null text is empty; texts without characters have the fingerprint of zero bytes and a likeness of 1
to one another; equal texts have equal fingerprints; rows of equal doc_id are ordered by a hash of their text; null
doc_id comes last; one single row is its own next document; other columns don't matter; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.graph import Joined, components, group_pairs
from harborwatch.llm.near import TILE, _whole_groups, group_starts
from harborwatch.llm.store import BlobStore, new_folder, write_blobs
from harborwatch.llm.words import mix, signed, small_batches
from harborwatch.session import staged

U64 = np.uint64
PERIOD = 4096
SLOTS = 128
#: Characters that are walked at once; with fewer walks than FEW left, each goes on by itself.
SLICE = 6_000_000
FEW = 48
#: Pairs that are compared at once.
PAIRS = 50_000


def _steps() -> np.ndarray:
    """Steps that a character class takes from each step (modulo PERIOD): up to its next 'move on' bit."""
    bits = np.random.default_rng(7).integers(0, 2, (256, PERIOD), dtype=np.int8)
    bits[:, 0] = 1  # no character waits for ever
    out = np.zeros((256, PERIOD), dtype=np.uint8)
    wait = np.zeros(256, dtype=np.int64)
    for step in [*range(PERIOD - 1, -1, -1)] * 2:
        wait = np.where(bits[:, step] == 1, 1, wait + 1)
        out[:, step] = np.minimum(wait, 255)
    return out.ravel()


def _records() -> list[np.ndarray]:
    """For each slot the steps at which a random sequence sets a new least value: the sampled step of a walk of n
    steps is the last of them below n."""
    rng = np.random.default_rng(11)
    out = []
    for _ in range(SLOTS):
        at, steps = 0, [0]
        while at < 1 << 40:
            at = int((at + 1) / max(rng.random(), 1e-9))
            at = max(at, steps[-1] + 1)
            steps.append(at)
        out.append(np.array(steps))
    return out


_STEPS = _steps()
_RECORDS = _records()
_SALT = mix(np.arange(1, SLOTS + 1, dtype=U64) * U64(0xA24BAED4963EE407))


def _classes(codes: np.ndarray) -> np.ndarray:
    """A character's row in the table, as an index of its first entry."""
    return ((codes * np.uint32(2654435761)) >> np.uint32(24)).astype(np.int32) * PERIOD


def walk(classes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is reached, and the step at which each text ends. ``begin``: first steps."""
    reached = np.zeros(len(classes), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, now = offsets[order].copy(), begin[order].astype(np.int64)
    left = np.sort(lengths)
    n, i = len(order), 0
    while True:
        n = len(left) - int(np.searchsorted(left, i, side="right"))
        if n < FEW:
            break
        until = int(left[len(left) - n])  # all n walks go on till here
        p, s = at[:n], now[:n]
        for _ in range(i, until):
            reached[p] = s
            s += _STEPS[classes[p] + (s & (PERIOD - 1))]
            p += 1
        i = until
    table = memoryview(_STEPS)
    for k in range(n):
        a, step, length = int(at[k]), int(now[k]), int(lengths[order[k]])
        path = []
        for c in classes[a : a + length - i].tolist():
            path.append(step)
            step += table[c + (step & (PERIOD - 1))]
        reached[a : a + length - i] = path
        now[k] = step
    end = np.empty_like(now)
    end[order] = now
    return reached, end


def _sample(ends: np.ndarray) -> np.ndarray:
    """The sampled steps (texts x SLOTS) of walks of so many steps."""
    out = np.empty((len(ends), SLOTS), dtype=np.int64)
    for k, steps in enumerate(_RECORDS):
        out[:, k] = steps[np.maximum(np.searchsorted(steps, ends, side="left") - 1, 0)]
    return out


def _slots(steps: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return (mix(mix(steps.astype(U64) + _SALT) ^ chars.astype(U64)) >> U64(56)).astype(np.uint8)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, tuple]:
    """A row of SLOTS bytes for each text, and the walk for ``edited_fingerprints``."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    classes = _classes(codes)
    reached, ends = walk(classes, offsets[:-1], lengths, np.zeros(len(texts), np.int64))
    # One sorted sequence over all texts: which character shows at a step of a text.
    wide = int(ends.max(initial=0)) + 1
    key = reached + np.repeat(np.arange(len(texts)) * wide, lengths)
    steps = _sample(ends)
    ask = steps + (np.arange(len(texts)) * wide)[:, None]
    at = np.searchsorted(key, ask.ravel(), side="right") - 1
    chars = codes[at.clip(0)].reshape(ask.shape) if len(codes) else np.zeros(ask.shape, np.uint32)
    out = _slots(steps, chars)
    out[lengths == 0] = 0
    return out, (codes, classes, lengths, offsets, reached, key, wide, ends)


def edited_fingerprints(before: tuple, kept: np.ndarray, source: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Fingerprints of texts made of the first ``kept`` characters and the first ``added`` of text ``source``;
    the walk over what is kept isn't walked again."""
    codes, classes, lengths, offsets, reached, key, wide, ends = before
    n = len(kept)
    own = np.arange(n)
    padded = np.append(reached, 0)
    begin = np.where(kept < lengths[:n], padded[np.minimum(offsets[:n] + kept, len(reached))], ends[:n])
    new_offsets = np.concatenate([[0], np.cumsum(added)])
    take = np.repeat(offsets[source] - new_offsets[:-1], added) + np.arange(new_offsets[-1])
    tail_codes, tail_classes = codes[take], classes[take]
    tail, tail_ends = walk(tail_classes, new_offsets[:-1], added, begin)
    steps = _sample(tail_ends)
    in_tail = steps >= begin[:, None]
    at = np.searchsorted(key, (steps + (own * wide)[:, None]).ravel(), side="right") - 1
    chars = codes[at.clip(0)].reshape(steps.shape) if len(codes) else np.zeros(steps.shape, np.uint32)
    if len(tail_codes):
        span = max(wide, int(tail_ends.max()) + 1)
        tail_key = tail + np.repeat(own * span, added)
        at = np.searchsorted(tail_key, (steps + (own * span)[:, None]).ravel(), side="right") - 1
        chars = np.where(in_tail, tail_codes[at.clip(0)].reshape(steps.shape), chars)
    out = _slots(steps, chars)
    out[kept + added == 0] = 0
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: the share of equal slots, less what two random bytes share."""
    equal = (a == b).mean(axis=1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, extra, id, text) in tasks: descending ids cut into parts, each sorted, with a copy of the first row
    of the next part (``extra``) at its end, after the last part of the first row of all. One shuffle of the texts."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    share = [k / (4 * n) for k in range(1, 4 * n)]
    cuts = ids.select(F.percentile_approx("id", share, 20 * n).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))
    last = len(cuts)

    @F.pandas_udf("int")
    def part_of(i: pd.Series) -> pd.Series:
        known = i.notna().to_numpy()
        out = np.full(len(i), last, dtype=np.int32)
        out[known] = last - np.searchsorted(cuts, i[known].astype("int64").to_numpy(), side="left")
        return pd.Series(out)

    # One row for each part: bounded by the number of parts.
    firsts = sorted((r["part"], r["first"]) for r in ids.select(part_of("id").alias("part"), "id").groupBy("part").agg(F.max("id").alias("first")).collect())
    parts = [p for p, _ in firsts]
    copies = [(first, parts[k - 1]) for k, (_, first) in enumerate(firsts)]
    extra = spark.createDataFrame(copies, "first long, target int") if copies else spark.createDataFrame([], "first long, target int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("part", part_of("id"))
    targets = extra.groupBy("first").agg(F.collect_list("target").alias("targets"))  # several where an id spans parts
    rows = rows.join(F.broadcast(targets), F.col("id").eqNullSafe(F.col("first")), "left")
    own = F.struct(F.col("part"), F.lit(0).alias("extra"))
    more = F.transform(F.coalesce("targets", F.array().cast("array<int>")), lambda t: F.struct(t.alias("part"), F.lit(1).alias("extra")))
    rows = rows.select("id", "text", F.explode(F.concat(F.array(own), more)).alias("to")).select("to.part", "to.extra", "id", "text")
    return rows.repartition(n, "part").sortWithinPartitions(
        "part", "extra", F.col("id").desc_nulls_last(), F.xxhash64("text")
    )


def fingerprint_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text, and the
    text whose last third is replaced by the beginning of the next document's in descending order of ids."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(ids: list, texts: list[str], following: list[str], same: bool) -> pa.RecordBatch:
        """Rows of ``ids``; following: their next texts, which are texts[1:] and one more."""
        every = [*texts, following[-1]]
        prints, walked = fingerprints(every)
        n = len(texts)
        lengths = walked[2]
        cut = lengths[:n] // 3
        added = np.minimum(cut, lengths[1:])
        kept = lengths[:n] - cut
        edited = edited_fingerprints(walked, kept, np.arange(1, n + 1), added)
        digests = [hashlib.sha256((t[:k] + f[:a]).encode("utf-8", "surrogatepass")).hexdigest() for t, f, k, a in zip(texts, following, kept.tolist(), added.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(lengths[:n]), pa.array(digests),
            pa.array([x.tobytes().hex() for x in prints[:n]]), pa.array([x.tobytes().hex() for x in edited]),
            pa.array(likeness(prints[:n], edited)), pa.array(likeness(prints[:n], prints[1:])),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        part, closed, chars = None, True, 0
        for batch in batches:
            for p, extra, i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if extra and (closed or p != part):
                    continue  # a part has one next row, even if that row's id repeats
                t = t.as_py() or ""
                if extra or chars >= SLICE:
                    if texts:
                        yield finish(ids, texts, [*texts[1:], t], False)
                    ids, texts, chars = [], [], 0
                if extra:
                    closed = True
                    continue
                if p != part:
                    part = p
                closed = False
                ids.append(i)
                texts.append(t)
                chars += len(t)

    return _ordered(small_batches(docs), id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint hex) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2_000):
                texts = [t or "" for t in batch.column(1).slice(k, 2_000).to_pylist()]
                prints, _ = fingerprints(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 2_000), pa.array([x.tobytes().hex() for x in prints])], ["doc_id", "fingerprint"])

    return small_batches(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, fingerprint string")


def _least_equal(least: float) -> int:
    """Equal slots that a likeness of ``least`` takes; more than there are where no pair reaches it."""
    if least <= 0:
        raise ValueError("a likeness of 0 links everything")
    reach = np.clip((np.arange(SLOTS + 1) / SLOTS - 1 / 256) / (1 - 1 / 256), 0.0, 1.0) >= least
    return int(np.argmax(reach)) if reach.any() else SLOTS + 1


def _print_links(tiles: DataFrame, prints: BlobStore, edges: np.ndarray, need: int) -> DataFrame:
    """(u, v, likeness): classes with ``need`` equal slots or more, enough of them to join all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        keys = ["k", "value", "low", "high"]
        for rows in _whole_groups(batches, keys):
            classes, which = np.unique(rows["a"].view(np.uint64), return_inverse=True)
            table = np.stack([prints.get(int(c), np.uint8) for c in classes])
            u, v = [], []
            for left, right in group_pairs(group_starts(rows, keys), len(which), PAIRS):
                # In a pair of different tiles only what stands in different ones; the same tile is a task of its own.
                apart = (rows["low"][left] == rows["high"][left]) | (rows["tile"][left] != rows["tile"][right])
                left, right = left[apart], right[apart]
                x, y = which[left], which[right]
                equal = table[x] == table[y]
                # The first band that two classes share is where they are compared.
                first = np.argmax(np.logical_and.reduceat(equal, edges[:-1], axis=1), axis=1) if len(x) else x
                matches = equal.sum(axis=1)
                found = np.flatnonzero((first == rows["k"][left]) & (matches >= need))
                found = found[np.argsort(-matches[found], kind="stable")]
                one, two = classes[x[found]], classes[y[found]]
                for c, d in zip(one.tolist(), two.tolist(), strict=True):
                    if joined.join(c, d):
                        u.append(c)
                        v.append(d)
            if u:
                a = np.stack([prints.get(c, np.uint8) for c in u])
                b = np.stack([prints.get(d, np.uint8) for d in v])
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(u, U64))), pa.array(signed(np.array(v, U64))), pa.array(likeness(a, b))], ["u", "v", "likeness"])

    return tiles.mapInArrow(run, "u long, v long, likeness double")


def near_fingerprints(prints: DataFrame, least: float = 0.8, band: int = 8) -> DataFrame:
    """(doc_id, near_id, likeness): links of likeness ``least`` or more, enough of them to join all that are linked.

    Equal fingerprints are one class, by its least doc_id; ``fingerprint_groups`` gives the members. The slots are cut
    into one band more than a pair may differ in, of ``band`` bytes at most, so that a pair of likeness ``least`` shares
    a whole band: none is missed. All pairs of a bucket are compared, tile by tile, each in the first band it shares.
    Rows of null doc_id or fingerprint link with nothing. Which links join a group may depend on the partitions.
    """
    spark = prints.sparkSession
    need = _least_equal(least)
    edges = np.linspace(0, SLOTS, max(SLOTS - need + 1, -(-SLOTS // band)) + 1).astype(int)
    classes = prints.filter("doc_id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("id"))
    classes = staged(classes.select(F.xxhash64("fingerprint").alias("a"), "id", "fingerprint"), "prints")
    values = [F.struct(F.lit(k).alias("k"), F.xxhash64(F.substring("fingerprint", int(2 * a) + 1, int(2 * (b - a)))).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    banded = classes.select("a", F.explode(F.array(*values)).alias("at")).select("a", "at.k", "at.value")
    shared = banded.groupBy("k", "value").agg(F.count("*").alias("members")).filter("members > 1")
    rows = staged(banded.join(shared, ["k", "value"]), "print-bands")
    needed = classes.join(rows.select("a").distinct(), "a", "left_semi")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), needed.count() // 5_000)
    store = write_blobs(needed.select("a", F.unhex("fingerprint").alias("print")), new_folder(spark, "prints"), "a", "print", parts)
    tiles = rows.withColumn("parts", F.ceil(F.col("members") / TILE).cast("int"))
    tiles = tiles.withColumn("tile", F.pmod(F.xxhash64("a"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("k", "value", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "a")
    tiles = tiles.repartition("k", "value", "low", "high").sortWithinPartitions("k", "value", "low", "high", "a")
    links = staged(_print_links(tiles, store, edges, need), "print-links")
    ids = classes.select("a", "id")
    found = links.join(ids.select(F.col("a").alias("u"), F.col("id").alias("x")), "u").join(ids.select(F.col("a").alias("v"), F.col("id").alias("y")), "v")
    return found.filter("x != y").select(F.greatest("x", "y").alias("doc_id"), F.least("x", "y").alias("near_id"), "likeness")


def fingerprint_groups(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): every doc_id that isn't null, once, and the least doc_id that links of ``least`` reach."""
    known = prints.filter("doc_id is not null").select("doc_id", "fingerprint").distinct()
    classes = known.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("v"))
    equal = known.join(classes, "fingerprint").select(F.col("doc_id").alias("u"), "v")
    links = near_fingerprints(prints, least).select(F.col("doc_id").alias("u"), F.col("near_id").alias("v"))
    roots = components(links.unionByName(equal))
    return known.select("doc_id").distinct().join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component_id"))
