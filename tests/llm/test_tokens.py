"""BPE, packing and token counts against the tokenizers library and plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from harborwatch.llm import bpe, packing, wordpiece
from harborwatch.llm.queries import vocabulary

BYTE_BPE = vocabulary("byte_bpe_50k.json")
WORD_BPE = vocabulary("word_bpe_49k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "don't we'll I'M", "x y z", "\x1c \x1f\x85",
    "né 中文 😀é é", "12 345,678.90", "end<|endoftext|>of <|endoftext|> text", "!!!???", "the" * 5000, "ab" * 3000,
    "\t\ttabs\t", "A" * 70, "word line",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_equals_library_on_odd_texts(library):
    coder = bpe.Encoder(BYTE_BPE)
    texts = [t or "" for t in ODD]
    assert coder.encode(texts) == [ids_of(library, t) for t in texts]


def test_encoder_equals_library_on_random_texts(library):
    rng = random.Random(5)
    pool = list("ab \n\t'.,0é中😀\u0085 \x1c²Ⅷ") + ["the ", " ing", "'re", "<|endoftext|>", "  ", " \n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(60)) for _ in range(40)]
    coder = bpe.Encoder(BYTE_BPE)
    got = coder.encode(texts)
    assert [t for t, g in zip(texts, got, strict=True) if g != ids_of(library, t)] == []
    assert [coder.decode(g) for g in got] == [library.decode(list(np.frombuffer(g, "<u4")), skip_special_tokens=False) for g in got]


def test_both_trees_merge_alike():
    vocab = bpe.Vocabulary(BYTE_BPE)
    rng = random.Random(2)
    words = [bytes(rng.choice(b"theinraod ") for _ in range(rng.randint(1, 32))) for _ in range(300)]
    many = bpe.merge_many(words, 32, vocab)
    one = [np.array(bpe.merge_one(vocab.of_byte[np.frombuffer(w, np.uint8)].tolist(), vocab), dtype="<u4").tobytes() for w in words]
    assert many == one


def test_caches_may_run_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    coder = bpe.Encoder(BYTE_BPE)
    texts = [f"some words {k} and {k * 7} more of them" for k in range(60)]
    assert coder.encode(texts) == [ids_of(library, t) for t in texts]


def test_digests_and_round_trip(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, "again", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.encode_digests(docs, BYTE_BPE).collect()), key=repr)
    want = sorted(
        ((k, len(ids_of(library, t)) // 4, hashlib.sha256(ids_of(library, t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t, _ in rows), key=repr
    )
    assert got == want
    encoded = bpe.encode_documents(docs, BYTE_BPE)
    back = bpe.decode_documents(encoded, BYTE_BPE).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((k, t or "") for k, t, _ in rows if k is not None)
    assert bpe.encode_digests(docs.limit(0), BYTE_BPE).count() == 0


def fill(rows):
    """Sequence -> sorted (offset, length)."""
    out = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append((r.offset, r.length))
    return {k: sorted(v) for k, v in out.items()}


def check_gapless(rows, max_tokens):
    for spans in fill(rows).values():
        at = 0
        for offset, length in spans:
            assert offset == at
            at += length
        assert at <= max_tokens


def test_packing_is_whole_and_tight(spark, library):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["the", "of", "zzxq"]) for _ in range(rng.choice([0, 1, 5, 30, 60, 200]))), "s") for k in range(300)]
    rows += [(300, None, "s"), (301, "", "s"), (7, "again", "s"), (7, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, BYTE_BPE, max_tokens=64, with_ids=True).collect()
    check_gapless(got, 64)
    want = Counter()
    for k, t, _ in rows:
        ids = np.append(np.frombuffer(ids_of(library, t), "<u4"), 2).astype("<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(k, j, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    least = -(-sum(r.length for r in got) // 64)
    assert len(fill(got)) <= 1.02 * least + 1


def test_packing_keeps_every_capacity(spark):
    lengths = [3] * 500 + [20] * 90 + [40] * 17
    found = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECES)
    for choose in ("dot", "norm"):
        rows = packing.pack(found, max_tokens=64, max_documents=4, max_attention=1700, choose=choose).collect()
        check_gapless(rows, 64)
        for spans in fill(rows).values():
            assert len(spans) <= 4 and sum(n * n for _, n in spans) <= 1700
    with pytest.raises(ValueError):
        packing.pack(found, max_tokens=64, max_attention=100)


def plain_best_fit(lengths, capacity, weights, choose):
    """One piece after the other, longest first, into the best open bin."""
    scale = [w / c**2 for w, c in zip(weights, capacity, strict=True)]
    bins = []
    for n in sorted(lengths, reverse=True):
        size, best = (n, 1, n * n), None
        for residual, held in bins:
            if all(a <= b for a, b in zip(size, residual, strict=True)):
                rest = [b - a for a, b in zip(size, residual, strict=True)]
                score = sum(r * s * (a if choose == "dot" else r) for r, s, a in zip(rest, scale, size, strict=True))
                if best is None or (score, residual[0]) < best[0]:
                    best = (score, residual[0]), residual, held
        if best is None:
            bins.append([list(capacity), []])
            best = None, *bins[-1]
        for k, a in enumerate(size):
            best[1][k] -= a
        best[2].append(n)
    return sorted(residual for residual, _ in bins)


@pytest.mark.parametrize("choose", ["dot", "norm"])
@pytest.mark.parametrize(("capacity", "weights"), [((64, 64, 4096), (1.0, 0.05, 0.05)), ((64, 3, 2200), (1.0, 0.4, 0.7)), ((50, 50, 1300), (0.2, 0.1, 1.0))])
def test_plan_is_plain_best_fit(capacity, weights, choose):
    rng = random.Random(repr((capacity, choose)))
    for _ in range(20):
        most = min(capacity[0], int(capacity[2] ** 0.5))
        lengths = [rng.choice([rng.randint(1, most), rng.randint(1, 9), most]) for _ in range(rng.randint(0, 150))]
        bins, places = {}, {}
        for first, pieces, length, offset, each in packing.plan(dict(Counter(lengths)), capacity, weights, choose):
            for k in range(pieces):
                residual = bins.setdefault(first + k // each, list(capacity))
                assert offset + k % each * length == capacity[0] - residual[0]
                for j, a in enumerate((length, 1, length * length)):
                    residual[j] -= a
                places[length] = places.get(length, 0) + 1
        assert places == dict(Counter(lengths)) and all(min(r) >= 0 for r in bins.values())
        # Bins with the same residual can stand in for each other.
        assert sorted(bins.values()) == plain_best_fit(lengths, capacity, weights, choose)


def test_packing_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = packing.pack_documents(docs, BYTE_BPE)
    assert out.count() == 0 and out.columns[-2:] == ["sequence_id", "offset"]


def greedy(word, pieces):
    symbols, at, n = (*word, wordpiece.END), 0, 0
    while at < len(symbols):
        for end in range(len(symbols), at, -1):
            if symbols[at:end] in pieces:
                break
        else:
            return 1
        n, at = n + 1, end
    return n


def test_counts_equal_greedy_matching():
    pieces = wordpiece.read_pieces(WORD_BPE)
    matcher, known = wordpiece.Automaton(pieces), set(pieces)
    rng = random.Random(4)
    words = [b"hello", "né".encode(), b"worthless", b"|", bytes([255, 254])]
    words += [bytes(rng.choice(b"theinraodstw'1") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    assert [w for w in words if matcher.count(w) != greedy(w, known)] == []


def test_counts_with_gaps_in_the_vocabulary():
    rng = random.Random(9)
    for _ in range(200):
        pieces = {tuple(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) + (wordpiece.END,) * rng.randint(0, 1) for _ in range(rng.randint(1, 8))}
        matcher = wordpiece.Automaton(sorted(pieces))
        for n in range(1, 8):
            word = bytes(rng.choice(b"ab") for _ in range(n))
            assert matcher.count(word) == greedy(word, pieces), (pieces, word)


def test_token_counts_of_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "Hello hello", 0), (4, "Hello hello", 0), (None, "x" * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    known = set(wordpiece.read_pieces(WORD_BPE))
    want = [(k, len((t or "").split()), sum(greedy(w.lower().encode(), known) for w in (t or "").split())) for k, t, _ in rows]
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.count_tokens(docs, WORD_BPE).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert wordpiece.count_tokens(docs.limit(0), WORD_BPE).count() == 0
