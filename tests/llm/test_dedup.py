"""Substring, near and embedding dedup against plain loops."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import graph, near, substring, vectors

SF = "/root/testdata/sf0.01"


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# ---- substring


def plain_removal(rows, window):
    seen, words = collections.Counter(), []
    for _, t in rows:
        w = (t or "").encode().split()
        words.append(w)
        seen.update(tuple(w[a : a + window]) for a in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen[tuple(w[a : a + window])] > 1:
                gone[a : a + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    vocab = ["a", "b", "cc", "dé"] + [f"w{k}" for k in range(50)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(3, 40))] for _ in range(6)]
    rows = [(1, None), (2, ""), (3, "a " * 300), (4, "a b " * 100), (5, " a\n\tb  c ")]
    for k in range(60):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocab) for _ in range(rng.randint(1, 30))]
        rows.append((k + 6, " ".join(w)))
    return [*rows, (80, rows[10][1]), (80, rows[10][1]), (None, rows[11][1])]


@pytest.mark.parametrize(("hot", "window"), [(200, 9), (1, 9), (200, 35), (200, 40)])
def test_removal_equals_a_plain_count(spark, monkeypatch, hot, window):
    monkeypatch.setattr(substring, "HOT_SEGMENTS", hot)
    rows = repeated_texts(hot + window)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, segment string")
    got = sorted(map(tuple, substring.removal_digests(docs, window).collect()), key=repr)
    assert got == sorted(plain_removal(rows, window), key=repr)
    assert sum(r[2] for r in got) > 0


def test_no_deal_grows_with_a_template_of_one_varying_word(spark, monkeypatch):
    rng = random.Random(5)
    head, tail = ([f"{side}{k}" for k in range(17)] for side in "ht")
    rows = [(k, " ".join([*head, f"id{k}", *tail, *(f"r{rng.randint(0, 10**9)}" for _ in range(6))])) for k in range(400)]
    rows += [(400 + k, rows[k][1] + " end") for k in range(5)]
    largest, search = [], substring._search_shards

    def watched(dealt, window, shards):
        sizes = dealt.groupBy("deal").agg(F.countDistinct("id").alias("ids"))
        largest.append(sizes.agg(F.max("ids")).first()[0])
        return search(dealt, window, shards)

    monkeypatch.setattr(substring, "_search_shards", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring.removal_digests(docs, 35).collect()))
    assert got == sorted(plain_removal(rows, 35)) and sum(r[2] > 0 for r in got) == 10
    assert largest[0] <= substring.HOT_SEGMENTS


def test_texts_without_repeats_stay_as_they_are(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"one  two\n{passage} tail", "x"), (2, f"{passage} other", "y"), (3, "clean  text\n", "z"), (4, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mask string")
    got = {r.doc_id: (r.text, r.mask) for r in substring.remove_repeats(docs, 10).collect()}
    assert got == {1: ("one two tail", "x"), 2: ("other", "y"), 3: ("clean  text\n", "z"), 4: (None, "w")}


def test_removal_on_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring.removal_digests(docs).count() == 0 and substring.remove_repeats(docs).count() == 0


def test_index_counts_like_a_plain_search():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 5, rng.integers(1, 30)) for _ in range(20)]
    ring = np.concatenate([np.append(p, 0) for p in pieces])
    index = substring.FMIndex(ring, 6)
    for _ in range(200):
        want = rng.integers(1, 5, rng.integers(1, 6))
        low, high = np.array([0]), np.array([index.n])
        for symbol in want[::-1]:
            low, high = index.extend(low, high, np.array([symbol]))
        plain = sum((p[a : a + len(want)] == want).all() for p in pieces for a in range(len(p) - len(want) + 1))
        assert high[0] - low[0] == plain


# ---- near copies


def plain_groups(rows, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = sorted(sets)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * (n := len(sets[a] & sets[b])) >= percent * (len(sets[a]) + len(sets[b]) - n)
    ]
    up = roots(ids, links)
    return [(i, len(sets[i]), up[i], up[i] == i) for i in ids]


def edited_texts(seed, groups=12, size=12):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three four five"), (7, "ONE two three four five")]
    for _ in range(groups):
        text = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 200))]
        for _ in range(size):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 400)}"
            rows.append((len(rows) * 3 + 20, " ".join(copy)))
    return rows


@pytest.mark.parametrize(("percent", "tile"), [(85, 128), (80, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, percent, tile):
    monkeypatch.setattr(near, "TILE", tile)
    rows = edited_texts(percent)
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, band string")
    got = sorted(tuple(r) for r in near.near_groups(docs, percent).collect())
    assert got == plain_groups(rows, percent)
    kept = {r.doc_id for r in near.deduplicate(docs, percent).collect()}
    assert kept == {r[0] for r in got if r[3]}
    assert near.deduplicate(docs, percent).columns == docs.columns


def test_near_edge_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near.near_groups(docs).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, True)], key=repr)
    assert near.near_groups(docs.limit(0)).count() == 0 and near.deduplicate(docs.limit(0)).count() == 0


def test_pruning_bounds_keep_the_posterior():
    rng = np.random.default_rng(1)
    steps = near.least_matches(0.85, 1e-6)
    lost = 0
    for _ in range(20_000):  # pairs at the threshold
        hits = np.cumsum(rng.random(steps[-1][0]) < 0.85)
        lost += any(hits[n - 1] < least for n, least in steps)
    assert lost <= 10 and all(least > 0 for _, least in steps[1:])


# ---- components


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 560)] + [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = roots({n for e in links for n in e}, links)
    assert {n: got.get(n, n) for n in want} == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- embeddings


def plain_vectors(rows, cosine):
    sound = [(i, np.array(v, dtype=float), label) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0]
    count, links = collections.Counter(), []
    for k, (a, x, p) in enumerate(sound):
        for b, y, q in sound[k + 1 :]:
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((a, b))
                count.update((a, b))
    up = roots([i for i, _, _ in rows], links)
    return [(i, count[i], up[i], up[i] == i) for i, _, _ in rows]


def clustered(seed, n=400, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size))
    rows = []
    for k in range(n):
        v = centres[k % 12] + 0.08 * rng.standard_normal(size) if k % 3 else rng.standard_normal(size)
        rows.append((k, v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * size, [nan] * size, [None] * size, [inf] + [1.0] * (size - 1), [], [1.0, 2.0]]
    rows += [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 20, rows[1][1], None)]
    return rows + [(n + 30 + k, rows[1][1], rows[1][2]) for k in range(5)]


@pytest.mark.parametrize(("cell", "tile"), [(512, 256), (16, 8)])
def test_vectors_equal_all_pairs(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = clustered(cell)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = sorted(tuple(r) for r in vectors.near_vectors(frame, 0.95).collect())
    want = plain_vectors(rows, 0.95)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all_ > 100 and 0.995 * all_ <= found <= all_
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_bound_is_calibrated():
    rng = np.random.default_rng(2)
    size, cosine = 32, 0.98
    x = rng.standard_normal((4000, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, size))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    z = cosine * x + np.sqrt(1 - cosine**2) * y
    d = vectors.directions(size)[:, : vectors.DIRECTIONS]
    hits = (np.abs((x - z) @ d) <= vectors.NARROW * np.sqrt(2 - 2 * cosine)).sum(axis=1)
    assert (hits >= vectors.bound()).mean() > 0.9


# ---- stores


def test_a_missing_or_cut_shard_is_an_error(spark):
    import os

    from harborwatch.llm.store import new_folder, write_blobs, write_store

    rows = spark.createDataFrame([(k << 58, k, b"x" * 8) for k in range(-20, 20)], "k long, n long, b binary")
    numbers = write_store(rows, new_folder(spark, "store-test"), "k", "n", "i8", 40)
    blobs = write_blobs(rows, new_folder(spark, "store-test"), "k", "b", 8)
    key = np.array([3 << 58], dtype=np.uint64)
    assert numbers.find(key).tolist() == [3] and len(blobs.get(3 << 58, np.uint8)) == 8
    assert numbers.find(np.array([5], dtype=np.uint64), default=-1).tolist() == [-1]
    again, blobs_again = (type(s)(**{k: v for k, v in s.__getstate__().items() if k != "_open"}) for s in (numbers, blobs))
    for s in (again, blobs_again):
        for name in os.listdir(s.folder):
            if name.endswith(".keys"):
                os.truncate(f"{s.folder}/{name}", 0)
    with pytest.raises((OSError, ValueError)):
        again.find(key)
    with pytest.raises((OSError, ValueError)):
        blobs_again.get(3 << 58, np.uint8)
