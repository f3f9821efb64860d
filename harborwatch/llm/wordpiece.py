"""Token counts by greedy longest-match word pieces, from a linear automaton.

The vocabulary's pieces form a trie over bytes and a closing mark. Each node has a failure link (where matching goes on
when no child fits) and the number of pieces that following it completes, both found breadth-first from its parent's. A
word then costs one move or one counted failure a byte, and no piece is ever built.

Defined results: null and empty texts have no words and no pieces; a word that no pieces can make up counts as one
unknown piece; words are runs without white space, A-Z lower-cased; rows are independent; a word of any length is
matched whole; other columns don't matter.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.bpe import _byte_letters
from harborwatch.llm.words import buffers, chunks, small_batches

END = 256
CACHE = 500_000


def read_pieces(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a vocabulary file as bytes, closed by END where they end a word."""
    letters = _byte_letters()
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    out = []
    for token in spec["model"]["vocab"]:
        closed = token.endswith(end)
        body = token[: -len(end)] if closed else token
        if body and all(c in letters for c in body):
            out.append(tuple(letters[c] for c in body) + (END,) * closed)
    return out


class Automaton:
    """Counts the greedy longest-match pieces of words."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.child: dict[int, int] = {}  # node * 257 + symbol -> node
        final, parent = [False], [(0, 0)]
        for piece in pieces:
            node = 0
            for symbol in piece:
                key = node * 257 + symbol
                if key not in self.child:
                    self.child[key] = len(final)
                    final.append(False)
                    parent.append((node, symbol))
                node = self.child[key]
            final[node] = True
        below: list[list[int]] = [[] for _ in final]
        for node in range(1, len(final)):
            below[parent[node][0]].append(node)
        #: Failure link, -1 where a piece can't be completed, and the pieces completed by following it.
        self.fail, self.pops = [-1] * len(final), [0] * len(final)
        todo = deque(below[0])
        while todo:
            node = todo.popleft()
            todo.extend(below[node])
            if final[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            up, symbol = parent[node]
            at, pops = self.fail[up], self.pops[up]
            while at >= 0 and at * 257 + symbol not in self.child:
                pops += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.child[at * 257 + symbol], pops
        self.cache: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if it has none that make it up."""
        child, fail, pops = self.child, self.fail, self.pops
        node = total = 0
        for symbol in (*word, END):
            then = child.get(node * 257 + symbol)
            while then is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                then = child.get(node * 257 + symbol)
            node = then
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def counts(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        for word in set(words):
            if word not in cache:
                cache[word] = self.count(word)
        return list(map(self.cache.__getitem__, words))


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    """The worker's own automaton of a vocabulary file, made once."""
    if path not in _automata:
        _automata[path] = Automaton(read_pieces(path))
    return _automata[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, longest): words, their pieces, and the most pieces of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = automaton(vocabulary)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for row, end in chunks(offsets):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes().lower().split() for k in range(row, end)]
                counts = np.array(matcher.counts([w for t in texts for w in t]), dtype=np.int64)
                n_words = np.fromiter(map(len, texts), np.int64, len(texts))
                sums = np.concatenate([[0], np.cumsum(counts)])
                edges = np.concatenate([[0], np.cumsum(n_words)])
                longest = np.zeros(len(texts), dtype=np.int64)
                some = n_words > 0
                if some.any():
                    longest[some] = np.maximum.reduceat(counts, edges[:-1][some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(n_words), pa.array(sums[edges[1:]] - sums[edges[:-1]]), pa.array(longest)],
                    ["doc_id", "n_words", "n_tokens", "longest"],
                )

    return small_batches(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, longest long")
