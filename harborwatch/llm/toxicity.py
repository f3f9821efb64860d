"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels.

A sentence's logit is a bias plus the weights of the words and word beginnings in it; a document is toxic unless every
sentence is harmless, so P(document) = 1 - prod(1 - P(sentence)). Only documents are labelled; the gradient shares a
document's label out over its sentences, and the fitted sentence scores locate the offending ones.

Fitting takes at most ``max_rows`` labelled rows (those of least hash of doc_id, equal texts once) and at most
``max_features`` features, so what the driver holds is bounded by these parameters. Scoring covers every document.

Defined results: null text is empty; a text without words is one sentence with the bias as logit; several labels of a
doc_id count as their largest; null labels are no labels; without any label of both kinds every score is 0;
repeated rows are scored each; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.words import Prefix, _LOWER_BYTE, buffers, chunks, lean, signed, small_batches, unsigned
from harborwatch.session import staged

U64 = np.uint64
#: Lengths in bytes of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the logit of a sentence without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(self.features >> U64(44)).astype(np.int64)] = True


class Sentences:
    """The letter words of some documents, the sentence of each, and the features of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter = _LETTER[data]
        begin, last = letter.copy(), letter.copy()
        begin[1:] &= ~letter[:-1]
        last[:-1] &= ~letter[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] = letter[cut]
        last[cut - 1] = letter[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        stops = np.flatnonzero(_STOP[data])
        place = np.searchsorted(stops, self.start) + self.doc  # grows at each stop and each document
        new = np.ones(len(place), dtype=bool)
        new[1:] = place[1:] != place[:-1]
        self.sentence = np.cumsum(new) - 1
        self.sentence_word = np.flatnonzero(new)
        self.sentence_doc = self.doc[self.sentence_word]
        self.prefix = Prefix(_LOWER_BYTE[data])

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, hashes), kind by kind: a whole word differs from a beginning of equal letters."""
        every = np.arange(len(self.start))
        yield every, self.prefix.hash(self.start, self.end) ^ U64(1)
        length = self.end - self.start
        for n in BEGINNINGS:
            which = every[length >= n]
            yield which, self.prefix.hash(self.start[which], self.start[which] + n)


def _sentences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Sentences]]:
    data, offsets = buffers(column)
    for row, end in chunks(offsets):
        part, own = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        yield row, end, part, own, Sentences(part, own)


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents."""
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # its size is the parameter's
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"))


def _feature_table(sample: DataFrame, max_features: int, least: int) -> np.ndarray:
    """Hashes of the features that mark toxic documents most, by a z-score of their log-odds over documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            label = batch.column(1).to_numpy()
            for row, end, part, own, s in _sentences(batch.column(0)):
                whole = Prefix(_LOWER_BYTE[part]).hash(own[:-1], own[1:])
                first = np.array([h not in seen and not seen.add(h) for h in whole.tolist()], dtype=bool)
                keys, owner = [], []
                for which, hashes in s.features():
                    keys.append(hashes)
                    owner.append(s.doc[which])
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                keep = first[owner] if len(owner) else np.zeros(0, bool)
                keys, owner = keys[keep], owner[keep]
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                keys, toxic = keys[new], label[row:end][owner[new]] > 0
                some, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(some)), pa.array(np.bincount(at, toxic, len(some)).astype(np.int64)), pa.array(np.bincount(at, ~toxic, len(some)).astype(np.int64))],
                    ["f", "pos", "neg"],
                )

    sums = sample.mapInArrow(lean(run), "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(F.col("pos") >= least)
    n = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return np.zeros(0, U64)
    odds = F.log((F.col("pos") + 0.5) / (pos + 1.0)) - F.log((F.col("neg") + 0.5) / (neg + 1.0))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    best = sums.withColumn("z", z).filter("z > 2").orderBy(F.desc("z"), "f").limit(max_features).select("f")
    return np.sort(unsigned(best.toArrow().column("f").to_numpy().astype(np.int64)))


def _hits(s: Sentences, table: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature number) of what is in the table, each once a sentence."""
    sentence, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(table):
        for which, hashes in s.features():
            could = maybe[(hashes >> U64(44)).astype(np.int64)]
            which, hashes = which[could], hashes[could]
            at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
            hit = table[at] == hashes
            sentence.append(s.sentence[which[hit]])
            number.append(at[hit])
    pair = np.unique(np.concatenate(sentence) * max(1, len(table)) + np.concatenate(number))
    return np.divmod(pair, max(1, len(table)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


#: Hits that a step of the fit works on at once.
BLOCK = 1 << 20


def _train(label: np.ndarray, sentences: np.ndarray, owner: np.ndarray, sizes: np.ndarray, feature: np.ndarray, n_features: int, rounds: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood. ``label`` and ``sentences`` are by bag, ``owner`` (the bag) and
    ``sizes`` (of its features, one or more) by sentence with features, ``feature`` holds those one after the other."""
    plain = np.maximum(1, sentences) - np.bincount(owner, minlength=len(label))
    ends = np.cumsum(sizes, dtype=np.int64)
    # Blocks of whole sentences, so that no float array has an entry for every hit.
    cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // BLOCK)) + 1).tolist(), len(ends)]
    blocks = [(a, b, int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    w, bias = np.zeros(n_features), -4.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    z, slopes = np.zeros(len(owner)), np.zeros(n_features)
    for t in range(1, rounds + 1):
        for a, b, lo, hi in blocks:
            z[a:b] = np.add.reduceat(w[feature[lo:hi]], ends[a:b] - sizes[a:b] - lo)
        z += bias
        rest = plain * _softplus(np.array(bias)) + np.bincount(owner, _softplus(z), len(label))  # -log P(harmless)
        p = -np.expm1(-rest)
        # d loss / d rest: 1 for harmless documents, -(1 - p) / p for toxic ones
        slope = np.where(label > 0, -(1 - p) / np.maximum(p, 1e-12), 1.0)
        by_sentence, base = slope[owner] / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        slopes[:] = ridge * w
        for a, b, lo, hi in blocks:
            slopes += np.bincount(feature[lo:hi], np.repeat(by_sentence[a:b], sizes[a:b]), n_features)
        g = np.append(slopes, by_sentence.sum() + (slope * plain * base).sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 20_000, least: int = 4, rounds: int = 400, ridge: float = 0.005) -> Model:
    """A model from labelled documents. Only text and toxic are inputs."""
    sample = staged(_sample(small_batches(docs), labels, max_rows).filter("text is not null"), "toxicity-sample")
    table = _feature_table(sample, max_features, least)
    if not len(table):
        return Model(table, np.zeros(0), -np.inf)
    maybe = Model(table, np.zeros(0), 0.0).maybe
    short = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            for row, end, part, own, s in _sentences(batch.column(0)):
                at, number = _hits(s, table, maybe)
                whole = Prefix(_LOWER_BYTE[part]).hash(own[:-1], own[1:])
                count = np.bincount(s.sentence_doc, minlength=end - row)
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(first, len(at))).astype("<u4")
                docs_of = np.arange(end - row + 1)
                owner = s.sentence_doc[at] if len(at) else np.zeros(0, np.int64)
                by_hit, by_sentence = np.searchsorted(owner, docs_of), np.searchsorted(owner[first], docs_of)
                number = number.astype(short)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(whole)), pa.array(label[row:end], pa.int32()), pa.array(count, pa.int32()),
                    pa.array([sizes[a:b].tobytes() for a, b in zip(by_sentence, by_sentence[1:], strict=False)], pa.binary()),
                    pa.array([number[a:b].tobytes() for a, b in zip(by_hit, by_hit[1:], strict=False)], pa.binary()),
                ], ["h", "label", "n", "sizes", "number"])

    bags = sample.mapInArrow(lean(run), "h long, label int, n int, sizes binary, number binary")
    once = bags.groupBy("h").agg(F.max(F.struct("label", "n", "sizes", "number")).alias("b")).select("b.*").toArrow()
    blobs = once.column("sizes").to_pylist()
    owner = np.repeat(np.arange(len(blobs)), [len(x) // 4 for x in blobs])
    sizes = np.frombuffer(b"".join(blobs), "<u4").astype(np.int64)
    feature = np.frombuffer(b"".join(once.column("number").to_pylist()), short)
    label, sentences = (once.column(c).to_numpy().astype(np.int64) for c in ("label", "n"))
    del once, blobs
    weights, bias = _train(label, sentences, owner, sizes, feature, len(table), rounds, ridge)
    return Model(table, weights, bias)


def _scores(s: Sentences, n: int, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each of n documents, and the sentences with features and their logits."""
    at, number = _hits(s, model.features, model.maybe)
    some, place = np.unique(at, return_inverse=True)
    z = model.bias + np.bincount(place, model.weights[number], len(some))
    count = np.maximum(np.bincount(s.sentence_doc, minlength=n), 1)
    owner = s.sentence_doc[some] if len(some) else np.zeros(0, np.int64)
    rest = (count - np.bincount(owner, minlength=n)) * _softplus(np.array(model.bias)) + np.bincount(owner, _softplus(z), n)
    return -np.expm1(-rest), some, z


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, offending: float = 0.5, with_spans: bool = False) -> DataFrame:
    """(doc_id, score, predicted), and with ``with_spans`` the offending sentences: array of (start, end, score) in code points."""
    fields = "doc_id long, score double, predicted int" + ", offending array<struct<start:long,end:long,score:double>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, part, own, s in _sentences(batch.column(1)):
                n = end - row
                score, some, z = _scores(s, n, model)
                columns = [batch.column(0).slice(row, n), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                names = ["doc_id", "score", "predicted"]
                if with_spans:
                    points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                    found: list[list[dict]] = [[] for _ in range(n)]
                    edges = np.append(s.sentence_word[1:], len(s.start)) if len(s.sentence_word) else s.sentence_word
                    for k, logit in zip(some.tolist(), z.tolist(), strict=True):
                        p = 1 / (1 + np.exp(-logit))
                        if p >= offending:
                            d = int(s.sentence_doc[k])
                            first = points[own[d]]
                            found[d].append({"start": int(points[s.start[s.sentence_word[k]]] - first), "end": int(points[s.end[edges[k] - 1]] - first), "score": float(p)})
                    columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))))
                    names.append("offending")
                yield pa.RecordBatch.from_arrays(columns, names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), fields)


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for row, end, _, _, s in _sentences(batch.column(at)):
                keep.append(_scores(s, end - row, model)[0] < threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no model has learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents by a model of the labels that aren't held out."""
    model = fit(docs, labels.filter(~F.coalesce(held_out(), F.lit(False))))
    return score_documents(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
