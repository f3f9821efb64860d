"""Vector best-fit packing of documents into sequences under token, document and attention-cost capacities.

A piece of n tokens takes (n tokens, 1 document, n**2 attention) from a sequence, so its size vector follows from
its length. Spark counts the pieces of each length (a table of at most ``max_tokens`` rows, whatever the corpus);
best-fit decreasing then runs over lengths with multiplicity: bins with the same residual vector are one state with
a count, so the number of states is bounded by the lengths, not by the pieces. Among the states that can take a
length under every constraint the one with the largest weighted dot-product of size and residual (or the smallest
weighted residual norm) is filled first. Pieces then find their place by their rank among pieces of equal length,
which Spark works out from counts of hash buckets, so no length is gathered in one task.

Defined results: null text is empty, a piece of the end token alone; empty tables give no rows; equal lengths (ties)
are ranked by doc_id, piece and check sum, repeated rows are pieces of their own; a text of any length is cut into
pieces of ``max_tokens``, the first takes the rest; other columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborwatch.llm.bpe import encoder, stretches
from harborwatch.llm.words import lean, small_batches
from harborwatch.session import staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The token pieces of each document, ids with the end id last; ``with_ids`` adds them as ids array<int>."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in stretches(batches):
            ids, bounds = coder.encode_column(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            # Pieces of a document of n tokens: the first takes what is left over full ones.
            sizes = np.diff(bounds)
            count = -(-sizes // max_tokens)
            owner = np.repeat(np.arange(len(sizes)), count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = np.maximum(0, sizes[owner] - (count[owner] - nth) * max_tokens)
            stop = sizes[owner] - (count[owner] - 1 - nth) * max_tokens
            at = bounds[owner]
            check = [zlib.crc32(ids[a:b]) for a, b in zip((at + start).tolist(), (at + stop).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(owner)), pa.array(nth, pa.int32()), pa.array(start), pa.array(stop - start), pa.array(check, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at + start, bounds[-1]), pa.int32()), pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECES + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], choose: str = "dot") -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over lengths with counts: rows (first bin, pieces, length, offset, each). ``pieces`` pieces of
    that length go to bins from ``first`` on, ``each`` to a bin (the last takes the rest), one after the other from ``offset``.

    A bin that was the best for a piece is the best for the next equal one too, as its residual only shrinks, so it
    takes as many as fit; that is what one piece after the other would give.
    """
    cap = np.array(capacity, dtype=float)
    scale = np.array(weights) / cap**2
    # A state: residual vector -> runs of bins (first, count) in it.
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    rows, made = [], 0

    def keep(state: tuple[int, ...], size: tuple[int, ...], taken: int, first: int, bins: int) -> None:
        after = tuple(a - taken * b for a, b in zip(state, size, strict=True))
        if bins and after[0] and after[1]:
            states.setdefault(after, []).append((first, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        size = (length, 1, length * length)
        if any(s > c for s, c in zip(size, capacity, strict=True)):
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            open_ = [s for s in states if all(a <= b for a, b in zip(size, s, strict=True))]
            if open_:
                rest = np.array(open_, dtype=float) - np.array(size)
                if choose == "dot":  # the fullest bin that lines up with the piece: least residual, by its dot with the size
                    score = (rest * scale * np.array(size)).sum(axis=1)
                else:
                    score = (rest**2 * scale).sum(axis=1)
                state = open_[min(range(len(open_)), key=lambda k: (score[k], open_[k][0]))]
                first, bins = states[state].pop()
                if not states[state]:
                    del states[state]
            else:
                state, first = capacity, made
            each = min(c // s for s, c in zip(size, state, strict=True))
            need = -(-left // each)
            if not open_:
                bins, made = need, made + need
            elif need < bins:
                states.setdefault(state, []).append((first + need, bins - need))
                bins = need
            pieces = min(left, bins * each)
            rows.append((first, pieces, length, capacity[0] - state[0], each))
            full, last = divmod(pieces, each)
            keep(state, size, each, first, full)
            keep(state, size, last, first + full, 1 if last else 0)
            left -= pieces
    return rows


def pack(found: DataFrame, max_tokens: int = 1024, max_documents: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), choose: str = "dot") -> DataFrame:
    """Add sequence_id and offset to pieces (``found`` must be a table that reads the same twice, such as a staged one)."""
    spark = found.sparkSession
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    rows, place = [], {}
    for first, n, length, offset, each in plan(counts, capacity, weights, choose):
        at = place.get(length, 0)
        rows.append((length, at, first, offset, each))
        place[length] = at + n
    if not counts:
        return found.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    # About sqrt(n) buckets of sqrt(n) pieces: neither a bucket nor the list of buckets of a length grows large.
    buckets = spark.createDataFrame([(k, math.isqrt(n) + 1) for k, n in counts.items()], "length long, buckets long")
    ranks = spark.createDataFrame(
        [(k, [r[1:] for r in rows if r[0] == k]) for k in counts], "length long, runs array<struct<at:long,first:long,offset:long,each:long>>"
    )
    # Rank by length: hash buckets of a bounded size, ranked each by itself, moved on by the buckets before.
    order = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = found.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*order), "buckets"))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.expr("filter(runs, r -> r.at <= rank)")
    placed = ranked.join(F.broadcast(ranks), "length").withColumn("run", F.element_at(run, -1))
    return placed.withColumn("sequence_id", F.expr("run.first + (rank - run.at) div run.each")).withColumn(
        "offset", F.expr("run.offset + (rank - run.at) % run.each * length")
    ).select(*found.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, max_tokens: int = 1024, end_id: int = 2, with_ids: bool = False, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of all documents."""
    return pack(staged(pieces(docs, vocabulary, max_tokens, end_id, with_ids), "pieces"), max_tokens, **limits)
