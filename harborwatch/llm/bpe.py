"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding.

A text is cut into pre-tokens by the vocabulary's pattern. The pairs of neighbouring symbols of a pre-token are
the leaves of a segment tree whose nodes hold the least ``rank * leaves + position``; its root is the leftmost
merge of lowest rank. A merge changes three leaves, each a climb of log2(leaves) nodes, until the root is empty.
Short pre-tokens of one tree size are merged side by side in numpy; a long one has a tree of its own.

Defined results: null text is empty and has no ids; ``<|endoftext|>`` and other added tokens in a text become
their own id, as in the library; rows are independent, so repeated rows repeat and an empty table stays empty;
texts of any length are encoded whole. Only ``id_col`` and ``text_col`` are read, other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.words import lean, small_batches

#: Entries of a generation of each cache of a worker.
CACHE = 300_000
#: Trees up to so many leaves are merged side by side.
WIDE = 64
SIDE_BY_SIDE = 4_000
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EMPTY = np.iinfo(np.int32).max
_MARKS = ".,!?;:"
#: In place of the ids of a piece whose text must be cut by itself.
_ODD = b"?"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, n in vocab.items():
            self.bytes[n] = bytes(letters[c] for c in token)
        for token, n in self.added.items():
            self.bytes[n] = token.encode()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, size)
        self.of_byte = np.zeros(256, dtype=np.int32)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.size = size
        keys = left * size + right
        # An open table of the pairs: a few probes instead of a binary search.
        self._bits = int(len(keys) * 4).bit_length()
        self._slot_keys = np.full(1 << self._bits, -1, dtype=np.int64)
        self._slot_ranks = np.full(1 << self._bits, _EMPTY, dtype=np.int32)
        todo, probe = np.arange(len(keys), dtype=np.int32), 0
        while len(todo):
            at = self._slot(keys[todo], probe)
            free = self._slot_keys[at] < 0
            self._slot_keys[at[free]] = keys[todo[free]]
            placed = self._slot_keys[at] == keys[todo]
            self._slot_ranks[at[placed]] = todo[placed]
            todo, probe = todo[~placed], probe + 1
        self.probes = probe
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        pairs = np.arange(1 << 16)
        #: Rank of each pair of bytes.
        self.byte_ranks = self.ranks(self.of_byte[pairs >> 8], self.of_byte[pairs & 255])

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed >>= np.uint64(64 - self._bits)
        return mixed.view(np.int64) if not probe else (mixed.view(np.int64) + probe) & ((1 << self._bits) - 1)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _EMPTY where it doesn't merge or one of the two is negative (nothing)."""
        keys = left.astype(np.int64) * self.size + right
        keys[(left < 0) | (right < 0)] = -2
        at = self._slot(keys, 0)
        have = self._slot_keys.take(at)
        found = have == keys
        out = np.where(found, self._slot_ranks.take(at), np.int32(_EMPTY))
        rest = np.flatnonzero(~found & (have >= 0) & (keys >= 0))
        for probe in range(1, self.probes):
            if not len(rest):
                break
            at = self._slot(keys[rest], probe)
            have = self._slot_keys.take(at)
            found = have == keys[rest]
            out[rest[found]] = self._slot_ranks.take(at[found])
            rest = rest[~found & (have >= 0)]
        return out


def merge_one(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """The ids of one pre-token, by a tree in a plain list."""
    n = len(symbols)
    if n < 2:
        return symbols
    leaves = 1 << (n - 1).bit_length()
    none = 1 << 62
    tree = [none] * (2 * leaves)
    rank_of, size, merged = vocab.rank_of, vocab.size, vocab.merged
    following = [*range(1, n), -1]
    before = list(range(-1, n - 1))

    def leaf(at: int) -> int:
        after = following[at]
        rank = rank_of.get(symbols[at] * size + symbols[after]) if after >= 0 else None
        return none if rank is None else rank * leaves + at

    for k in range(n - 1):
        tree[leaves + k] = leaf(k)
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(at: int, value: int) -> None:
        k = leaves + at
        tree[k] = value
        while k > 1:
            k >>= 1
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                return
            tree[k] = least

    while tree[1] != none:
        rank, at = divmod(tree[1], leaves)
        gone = following[at]
        symbols[at] = int(merged[rank])
        following[at] = after = following[gone]
        if after >= 0:
            before[after] = at
        put(gone, none)
        put(at, leaf(at))
        if before[at] >= 0:
            put(before[at], leaf(before[at]))
        symbols[gone] = -1
    return [s for s in symbols if s >= 0]


def merge_many(words: list[bytes], leaves: int, vocab: Vocabulary) -> list[bytes]:
    """Ids (little-endian uint32) of pre-tokens of at most ``leaves`` bytes, one tree each, side by side.

    All arrays are flat: word w has its symbols from w * (leaves + 1) on, where the last takes what falls off the end, and
    its tree from w * 2 * leaves on.
    """
    count, wide, shift = len(words), leaves + 1, leaves.bit_length() - 1
    lengths = np.fromiter(map(len, words), np.int64, count)
    data = np.frombuffer(b"".join(words), np.uint8)
    inside = np.arange(leaves) < lengths[:, None]
    symbol = np.full((count, wide), -1, dtype=np.int32)
    symbol[:, :leaves][inside] = vocab.of_byte[data]
    place = np.arange(leaves, dtype=np.int32)
    paired = np.arange(1, wide) < lengths[:, None]
    after = np.full((count, wide), leaves, dtype=np.int32)
    after[:, :leaves] = np.where(paired, place + 1, leaves)
    before = np.tile(np.arange(-1, leaves, dtype=np.int32), (count, 1))
    tree = np.full((count, 2 * leaves), _EMPTY, dtype=np.int32)  # rank * leaves + place is under 2**31 for trees this wide
    # A byte and the next one, but for the last byte of each word.
    last = np.zeros(len(data), dtype=bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rank = vocab.byte_ranks[data.astype(np.int64)[:-1] << 8 | data[1:]][~last[:-1]] if len(data) else data
    where = np.broadcast_to(place, paired.shape)[paired]
    tree[:, leaves:][paired] = np.where(rank < _EMPTY, rank << shift | where, _EMPTY)
    for k in range(leaves - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
    symbol, after, before, tree = symbol.ravel(), after.ravel(), before.ravel(), tree.ravel()

    rows = np.flatnonzero(tree[1 :: 2 * leaves] < _EMPTY)
    while len(rows):
        base, root = rows * wide, rows * (2 * leaves)
        least = tree.take(root + 1)
        at, made = least & (leaves - 1), vocab.merged.take(least >> shift)
        here = base + at
        gone = after.take(here)
        then = after.take(base + gone)
        prior = before.take(here)
        symbol[here] = made
        symbol[base + gone] = -1
        after[here] = then
        before[base + then] = at
        right = vocab.ranks(made, symbol.take(base + then))
        right = np.where(right < _EMPTY, right << shift | at, _EMPTY)
        first = prior < 0
        prior = np.where(first, at, prior)
        left = vocab.ranks(symbol.take(base + prior), made)
        left = np.where(first, right, np.where(left < _EMPTY, left << shift | prior, _EMPTY))
        # Three leaves change: the merged pair's, the one that is gone, and the one before.
        nodes = np.concatenate([root + leaves + at, root + leaves + gone, root + leaves + prior])
        tree[nodes] = np.concatenate([right, np.full(len(rows), _EMPTY, np.int32), left])
        roots = np.tile(root, 3)
        nodes -= roots
        for _ in range(shift):
            nodes >>= 1
            children = roots + 2 * nodes
            tree[roots + nodes] = np.minimum(tree.take(children), tree.take(children + 1))
        rows = rows[tree.take(root + 1) < _EMPTY]
    kept = symbol.reshape(count, wide)[:, :leaves]
    ends = np.cumsum((kept >= 0).sum(axis=1)) * 4
    ids = kept[kept >= 0].astype("<u4").tobytes()
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return [ids[a:b] for a, b in zip(starts, ends.tolist(), strict=True)]


class Cache:
    """What recurs, in two generations: a full one becomes the old one, and what is used again moves on."""

    def __init__(self):
        self.size, self.young, self.old = CACHE, {}, {}

    def get(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """The value of each key, and the places of unknown ones."""
        out = list(map(self.young.get, keys))
        places = [k for k, found in enumerate(out) if found is None] if None in out else []
        if not places or not self.old:
            return out, places
        unknown = []
        for k in places:
            found = self.old.get(keys[k])
            if found is None:
                unknown.append(k)
            else:
                self.young[keys[k]] = out[k] = found
        return out, unknown

    def put(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) + len(keys) > self.size:
            self.young, self.old = {}, self.young
        self.young.update(zip(keys, values, strict=True))


class Encoder:
    """Encodes columns of texts; equal pieces of a column are encoded once, and what recurs is looked up.

    A token never spans a space that stands before a non-space, except as its first character, so texts are cut at
    spaces, and the pieces are dictionary-encoded. A text with a space before white space or at its end, or with an
    added token in it, is cut by itself.
    """

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.split = regex.compile(_PATTERN)
        self.cut = re.compile(r"(?= \S)")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.vocab.added, key=len, reverse=True))) + ")") if self.vocab.added else None
        self.marks = list(self.vocab.added)
        self.spaced_marks = any(" " in m for m in self.marks)
        self.pieces = Cache()  # ids by piece that begins a text
        self.parts = Cache()  # ids by piece of a text that is cut by itself
        self.spaced = Cache()  # ids of a space and the piece
        self.tokens = Cache()  # ids by token of the pattern

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of different tokens of the pattern."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            by_size.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(k)
        for leaves, places in by_size.items():
            if leaves <= WIDE and len(places) >= 16:
                for k in range(0, len(places), SIDE_BY_SIDE):
                    part = places[k : k + SIDE_BY_SIDE]
                    for j, ids in zip(part, merge_many([raw[j] for j in part], leaves, self.vocab), strict=True):
                        out[j] = ids
            else:
                for j in places:
                    ids = merge_one(self.vocab.of_byte[np.frombuffer(raw[j], np.uint8)].tolist(), self.vocab)
                    out[j] = np.array(ids, dtype="<u4").tobytes()
        return out

    def _looked_up(self, cache: Cache, keys: list[str], make) -> list[bytes]:
        """Values of different keys; ``make`` gives those of the unknown ones."""
        out, places = cache.get(keys)
        if places:
            new = [keys[k] for k in places]
            values = make(new)
            cache.put(new, values)
            for k, found in zip(places, values, strict=True):
                out[k] = found
        return out

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        cut = [self.split.findall(t) for t in texts]
        tokens = list({t for ts in cut for t in ts})
        ids = dict(zip(tokens, self._looked_up(self.tokens, tokens, self._merge), strict=True)).__getitem__
        return [b"".join(map(ids, ts)) for ts in cut]

    def _spaced_words(self, words: list[str]) -> list[bytes]:
        return self._merge([" " + w for w in words])

    def _first(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that begin a text, or _ODD."""
        return [_ODD if any(m in p for m in self.marks) else ids for p, ids in zip(new, self._by_pattern(new), strict=True)]

    def _after_space(self, new: list[str]) -> list[bytes]:
        """Ids of a space and each piece, or _ODD. Most are letters, or letters and one closing mark, which need no pattern."""
        out: list[bytes] = [b""] * len(new)
        whole = [k for k, p in enumerate(new) if p.isalpha()]
        closed = [k for k, p in enumerate(new) if p and p[-1] in _MARKS and p[:-1].isalpha()]
        known = set(whole)
        known.update(closed)
        rest = [k for k in range(len(new)) if k not in known]
        for k, ids in zip(whole, self._spaced_words([new[k] for k in whole]), strict=True):
            out[k] = ids
        if closed:
            mine = {new[k]: out[k] for k in whole}
            stems = list({new[k][:-1] for k in closed} - mine.keys())
            mine.update(zip(stems, self._looked_up(self.spaced, stems, self._spaced_words), strict=True))
            marks = dict(zip(_MARKS, self._by_pattern(list(_MARKS)), strict=True))
            for k in closed:
                out[k] = mine[new[k][:-1]] + marks[new[k][-1]]
        for k, ids in zip(rest, self._by_pattern([" " + new[k] for k in rest]), strict=True):
            p = new[k]
            out[k] = _ODD if not p or p[0].isspace() or any(m in p for m in self.marks) else ids
        return out

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of any kind: cut at added tokens, then before a space that stands before a non-space."""
        plans = []
        for text in texts:
            parts = self.special.split(text) if any(m in text for m in self.marks) else [text]
            plans.append([part if k % 2 else self.cut.split(part) for k, part in enumerate(parts)])
        different = list({p for plan in plans for part in plan if isinstance(part, list) for p in part})
        ids = dict(zip(different, self._looked_up(self.parts, different, self._by_pattern), strict=True)).__getitem__
        out = []
        for plan in plans:
            blobs = []
            for part in plan:
                if isinstance(part, list):
                    blobs += map(ids, part)
                else:
                    blobs.append(self.vocab.added[part].to_bytes(4, "little"))
            out.append(np.frombuffer(b"".join(blobs), "<u4"))
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids end and the next one's start: one more than texts)."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        found = cut.flatten().dictionary_encode()
        which = found.indices.to_numpy().astype(np.int64)
        count = len(found.dictionary)
        # As one string, cut at the spaces, which no piece holds.
        entries = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), found.dictionary), " ")[0].as_py().split(" ")
        # The first piece of a text has no space before it.
        plain, of_text = np.unique(which[first], return_inverse=True)
        after = np.ones(len(which), dtype=bool)
        after[first] = False
        used = np.zeros(count, dtype=bool)
        used[which[after]] = True
        spaced = entries if used.all() else [entries[k] for k in np.flatnonzero(used).tolist()]
        blobs = self._looked_up(self.spaced, spaced, self._after_space)
        blobs += self._looked_up(self.pieces, [entries[k] for k in plain.tolist()], self._first)
        moved = np.cumsum(used) - 1
        which = moved[which]
        which[first] = len(spaced) + of_text
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        odd = sizes == len(_ODD)
        if odd.any():
            blobs = [b"" if b == _ODD else b for b in blobs]
        sizes = np.where(odd, 0, sizes // 4)
        flat = np.frombuffer(b"".join(blobs), "<u4")
        ids, ends = taken(flat, sizes, which)
        bounds = np.append(ends[first], ends[-1])
        alone = np.logical_or.reduceat(odd[which], first) if odd.any() else np.zeros(len(texts), dtype=bool)
        if self.spaced_marks:
            alone |= np.array([any(m in t for m in self.marks) for t in texts.to_pylist()])
        if not alone.any():
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        places = np.flatnonzero(alone)
        for k, found in zip(places, self._alone(texts.take(pa.array(places)).to_pylist()), strict=True):
            parts[k] = found
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode_column(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids in a row; bytes that aren't UTF-8 become replacement characters."""
        raw, ends = taken(self.vocab.flat, self.vocab.sizes, ids.astype(np.int64))
        raw, ends = raw.tobytes(), ends[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        """The text of ids."""
        found = np.frombuffer(ids, "<u4")
        return self.decode_column(found, np.array([0, len(found)]))[0]


def taken(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` in the order ``which``; and where each starts, with the end of the last."""
    counts = sizes[which]
    ends = np.concatenate([[0], np.cumsum(counts)])
    starts = (np.cumsum(sizes) - sizes)[which]
    return flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])], ends


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a vocabulary file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: Bytes of text that are encoded at once.
STRETCH = 4_000_000


def stretches(batches: Iterator[pa.RecordBatch], text: int = 1, size: int = STRETCH) -> Iterator[pa.RecordBatch]:
    """The rows of batches, cut and joined so that a batch has about ``size`` bytes in its column ``text``."""
    held: list[pa.RecordBatch] = []
    room = size

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        row = 0
        while row < len(batch):
            before = int(ends[row - 1]) if row else 0
            upto = min(len(batch), int(np.searchsorted(ends, before + room)) + 1)
            held.append(batch.slice(row, upto - row))
            room -= int(ends[upto - 1]) - before
            row = upto
            if room <= 0:
                yield joined()
                held, room = [], size
    if held:
        yield joined()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded): every text encoded, and decoded again from its ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in stretches(batches):
            ids, bounds = coder.encode_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view("<i4"))),
                pa.array(coder.decode_column(ids, bounds), pa.string()),
            ], schema=schema)

    return small_batches(docs).select(id_col, text_col).mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_documents`` gives, made beside it."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in stretches(batches):
            ids, bounds = coder.encode_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()),
                pa.array(np.diff(bounds), pa.int64()),
                pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)]),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in coder.decode_column(ids, bounds)]),
            ], names)

    return small_batches(docs).select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(ids: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of an array<int> column; null ids are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in batches:
            texts = [coder.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(F.col(id_col).cast("long"), ids_col).mapInArrow(lean(run), "doc_id long, text string")
