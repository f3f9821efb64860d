"""Fingerprints, the n-gram model, secret scans and toxicity against plain loops and held-out rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import editsketch, lm, secret_scan, toxicity

SF = "/root/testdata/sf0.01"


# ---- fingerprints


def plain_embedding(text):
    """The walk step by step: (step, character) shown at each step."""
    bits = np.random.default_rng(7).integers(0, 2, (256, editsketch.PERIOD), dtype=np.int8)
    bits[:, 0] = 1
    out, step = [], 0
    for ch in text:
        row = ((ord(ch) * 2654435761) % 2**32) >> 24
        while True:
            out.append(ch)
            move = bits[row, step % editsketch.PERIOD]
            step += 1
            if move:
                break
    return out


def test_walk_is_the_embedding(monkeypatch):
    texts = ["", "a", "hello world", "né中😀" * 40, "the quick brown fox " * 30]
    for few in (0, 48):  # all side by side, and each by itself
        monkeypatch.setattr(editsketch, "FEW", max(1, few))
        _, walked = editsketch.fingerprints(texts)
        _, _, lengths, offsets, reached, _, _, ends = walked
        for k, text in enumerate(texts):
            shown = plain_embedding(text)
            assert ends[k] == len(shown)
            for j, ch in enumerate(text):
                assert shown[reached[offsets[k] + j]] == ch


def test_fingerprints_follow_edits(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8)))
    text = " ".join(word() for _ in range(400))
    edited = text[:700] + "inserted words" + text[720:]
    other = " ".join(word() for _ in range(400))
    prints, _ = editsketch.fingerprints([text, text, edited, other])
    like = lambda a, b: float(editsketch.likeness(prints[a : a + 1], prints[b : b + 1])[0])
    assert like(0, 1) == 1.0 and like(0, 2) > 0.6 and like(0, 3) < 0.35


def edited_rows(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest(), t[: len(t) - cut] + nxt[:cut], nxt)
    return out


@pytest.mark.parametrize("size", [6_000_000, 50])
def test_edited_documents(spark, monkeypatch, size):
    rng = random.Random(3)
    rows = [(k * 3, "".join(rng.choice("abc é😀\n") for _ in range(rng.choice([0, 1, 2, 3, 50, 400])))) for k in range(120)] + [(1000, None), (2000, "z" * 30000)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, part string")
    want = edited_rows(rows)
    got = editsketch.fingerprint_edited(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {k: v[:2] for k, v in want.items()} and len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        prints, _ = editsketch.fingerprints([texts[r.doc_id] or "", want[r.doc_id][2], want[r.doc_id][3]])
        assert r.fingerprint == prints[0].tobytes().hex() and r.edited_fingerprint == prints[1].tobytes().hex()
        assert r.near_edited == editsketch.likeness(prints[:1], prints[1:2])[0] and r.near_next == editsketch.likeness(prints[:1], prints[2:])[0]


def test_edited_edge_tables(spark):
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert editsketch.fingerprint_edited(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert editsketch.fingerprint_edited(one.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "aaa"), (1, "bbb"), (None, "ccc"), (None, None)], "doc_id long, text string")
    assert editsketch.fingerprint_edited(ties).count() == 4


def test_near_fingerprints(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(300))
    rows = [(1, text), (2, text), (3, text[:900] + text[200:400] + text[1100:])] + [(k, " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(300))) for k in range(10, 30)]
    prints = editsketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.near_id) for r in editsketch.near_fingerprints(prints).collect()] == [(3, 1)]


def slots_changed(rng, base, at):
    out = base.copy()
    out[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    return out


def test_links_beside_an_unlike_bucket_head(spark):
    rng = np.random.default_rng(4)
    b = rng.integers(0, 256, editsketch.SLOTS).astype(np.uint8)
    c = slots_changed(rng, b, rng.permutation(editsketch.SLOTS)[:25])  # as far as a likeness of 0.8 goes
    rows = [(1000, b), (1001, c)]
    for k in range(0, editsketch.SLOTS, 2):  # heads of lesser ids that share half of the slots with both
        head = rng.integers(0, 256, editsketch.SLOTS).astype(np.uint8)
        keep = np.flatnonzero(b == c)
        keep = np.unique(np.append(keep[(keep - k) % editsketch.SLOTS < 64], keep[rng.random(len(keep)) < 0.3]))
        head[keep] = b[keep]
        rows.append((k, head))
    for k in range(16):  # and what eight sampled bytes of either take
        head = rng.integers(0, 256, editsketch.SLOTS).astype(np.uint8)
        at = [(k * 37 + j * 29) % editsketch.SLOTS for j in range(8)]
        head[at] = b[at]
        rows.append((200 + k, head))
    prints = spark.createDataFrame([(k, x.tobytes().hex()) for k, x in rows], "doc_id long, fingerprint string")
    assert (1001, 1000) in [(r.doc_id, r.near_id) for r in editsketch.near_fingerprints(prints).collect()]


@pytest.mark.parametrize(("least", "tile"), [(0.8, 128), (0.8, 3), (0.95, 128)])
def test_fingerprint_groups_equal_all_pairs(spark, monkeypatch, least, tile):
    monkeypatch.setattr(editsketch, "TILE", tile)
    rng = np.random.default_rng(int(100 * least))
    rows = []
    for _ in range(12):
        base = rng.integers(0, 256, editsketch.SLOTS).astype(np.uint8)
        for _ in range(8):
            rows.append((int(rng.integers(1, 200)), slots_changed(rng, base, rng.permutation(editsketch.SLOTS)[: rng.integers(0, 20)])))
    rows += [(500, rows[0][1]), (500, rows[9][1]), (None, rows[20][1])]
    up = {k: k for k, _ in rows if k is not None}
    for k, x in rows:
        for j, y in rows:
            if None not in (k, j) and up[k] != up[j] and editsketch.likeness(x[None], y[None])[0] >= least:
                low, high = sorted((up[k], up[j]))
                up = {n: low if r == high else r for n, r in up.items()}
    prints = spark.createDataFrame([(k, x.tobytes().hex()) for k, x in rows], "doc_id long, fingerprint string")
    assert {r.doc_id: r.component_id for r in editsketch.fingerprint_groups(prints, least).collect()} == up
    assert editsketch.fingerprint_groups(prints.limit(0), least).count() == 0


# ---- n-gram model


def plain_scores(rows):
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), "end"]
    training = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    uni, bi = collections.Counter(), collections.Counter()
    for t in training:
        w = tokens(t)
        uni.update(w)
        bi.update(zip(["begin", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    kinds, before, total = collections.defaultdict(lambda: [0, 0, 0]), collections.Counter(), collections.Counter()
    for (a, b), c in bi.items():
        kinds[a][min(c, 3) - 1] += 1
        before[b] += 1
        total[a] += c
    of = lambda counts: lm._discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])
    d2, d1 = of(bi.values()), of(before.values())
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    all_ = sum(before.values())
    spread = sum(cut(c, d1) for c in before.values()) / all_ if all_ else 1.0
    low = lambda w: ((before[w] - cut(before[w], d1)) / all_ if all_ else 0.0) + spread / (v + 1)
    out = []
    for i, t in rows:
        w, score = tokens(t), 0.0
        for a, b in zip(["begin", *w], w, strict=False):
            c = bi[(a, b)]
            score += math.log10((c - cut(c, d2)) / total[a] + sum(x * y for x, y in zip(d2, kinds[a], strict=True)) / total[a] * low(b) if total[a] else low(b))
        base = sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(w), sum(uni[x] > 0 for x in w), n, base, score))
    return out, sum(low(w) for w in uni) + spread / (v + 1)


def test_scores_equal_a_plain_model(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(rng.choice(vocab[: rng.choice([5, 200])]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(500, None), (501, "Only HERE new words x"), (7, "repeated row"), (7, "repeated row"), (None, "no id")]
    want, mass = plain_scores(rows)
    assert abs(mass - 1) < 1e-9
    got = lm.score_held_out(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    got = sorted((tuple(r)[:7] for r in got), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[k] - w[k]) < 1e-6 for g, w in zip(got, want, strict=True) for k in (5, 6))


def test_a_range_of_words_is_summed_row_by_row():
    words, entries = 1 << 16, np.arange(1 << 16, dtype=np.uint32)
    ones = np.ones(len(entries), np.uint32)
    size = entries.nbytes + ones.nbytes

    def batches():
        for k in range(100):
            row = [[0], [k // 50], ["before"], [lm._planes(entries)], [lm._planes(ones)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], ["s", "t", "name", "k", "c"])

    tracemalloc.start()
    found = [(r, int(sums["before"].min()), int(sums["before"][:-1].max())) for r, sums in lm._range_sums(batches(), words - 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 50, 50), (0, 50, 50)]
    assert peak < 20 * size  # all rows of a range are 100 * size


def test_scores_do_not_depend_on_the_number_of_shards(spark, monkeypatch):
    rng = random.Random(9)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(60))) for k in range(80)], "doc_id long, text string")
    few = sorted(map(tuple, lm.score_held_out(docs).collect()))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 100)
    assert sorted(map(tuple, lm.score_held_out(docs).collect())) == few


def test_model_without_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_held_out(empty).count() == 0
    model = lm.train(empty)
    row = lm.score_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_held_out_rows_score_above_the_base(spark):
    rows = lm.score_held_out(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > 0.8 * rows.b


# ---- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def base_row(i, t):
    spans = base_spans(t or "")
    n = [sum(s[1] == k for s in spans) for k in range(3)]
    return (i, *n, hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest())


TEXTS = [
    None, "", "password = hunter22 and AKIA" + "A" * 16 + " é😀 token:'abc' secret=\"token\" = abcdef", "TOKEN = " + "0123456789abcdef" * 3,
    "secret:\"token\" = abcdef", "paſſword = abcdefgh api-key apikey=zzzzzzzz", "x" * 50000 + "AKIA" * 30 + " " * 300 + "deadbeef" * 4,
    "😀token=123456😀token=1234567", "token=api_key=abcdefgh", "f" * 23 + "g" + "f" * 24, "AKIAAKIA" + "B" * 15, "token" + " " * 2000 + ": value77",
]


def test_base_spans_equal_a_plain_scan(spark):
    rng = random.Random(6)
    bits = ["password", "Token", "api_key", "secret", "=", ":", " ", '"', "'", "abc", "abcdef", "deadbeef" * 3, "AKIA", "A1B2C3D4" * 2, "é", "😀", "\n"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "dup"), (3, "dup"), (None, "token=123456")]
    docs = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, kind string")
    got = [tuple(r)[:5] for r in secret_scan.scan(docs).collect()]
    assert sorted(got, key=repr) == sorted((base_row(*r) for r in rows), key=repr)


def test_base_spans_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r)[:5] for r in secret_scan.scan(docs).collect()) == sorted(base_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    assert secret_scan.scan(docs.limit(0)).count() == 0


def spans(spark, text, **kw):
    return secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).first().spans


def test_weak_parts_are_reported_together_only(spark):
    key = "Zx9" * 12
    assert spans(spark, "see http://x.example.com/a") == ""
    assert spans(spark, f"blob {key} alone") == ""
    assert spans(spark, "user: bob was here") == ""
    assert spans(spark, f"user: bob {key}") == f"ident:0:9,opaque:10:{10 + len(key)}"
    assert spans(spark, f"user: bob{' ' * 400}{key}") == ""
    text = f"http://x.example.com:80/ user: bob {key}"
    assert spans(spark, text).split(",")[0] == "endpoint:0:23" and len(spans(spark, text).split(",")) == 3
    many = "user: bob " * 300 + key
    assert spans(spark, many).count("ident") == 30  # those within 300 characters of the string


def test_redaction(spark):
    rows = [(1, "a token = 0123456789abcdef0123456789 b", "x"), (2, "clean é😀", "y"), (3, None, "z"), (1, "a token = 0123456789abcdef0123456789 b", "x"), (4, "password=abcdefg, AKIA" + "Z" * 16, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sorted(map(tuple, secret_scan.redact(docs).collect()), key=repr)
    assert got == sorted([(1, "a [assign] b", "x"), (2, "clean é😀", "y"), (3, None, "z"), (1, "a [assign] b", "x"), (4, "[assign], [access]", "w")], key=repr)
    assert secret_scan.redact(docs).columns == docs.columns


def test_a_long_identifier_is_reported_whole(spark):
    key, name = "Zx9" * 12, "client_id: " + "ab-1" * 25
    assert spans(spark, f"{name} {key}") == f"ident:0:{len(name)},opaque:{len(name) + 1}:{len(name) + 1 + len(key)}"
    docs = spark.createDataFrame([(1, f"{name} {key}")], "doc_id long, text string")
    assert secret_scan.redact(docs).first().text == "[ident] [opaque]"


def test_scan_runs_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = secret_scan.scan(docs)._jdf.queryExecution().toString() + secret_scan.redact(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# ---- toxicity


def toxic_rows(n=900, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        sentences = [[rng.choice(words) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 12))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 2)):
                rng.choice(sentences).insert(1, rng.choice(["grobble", "snurkish", "plonkers"]))
        rows.append((k, ". ".join(" ".join(s) for s in sentences), int(toxic)))
    return rows


def test_toxicity_holds_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_held_out(docs, labels).collect()}
    held = [(k, x) for k, _, x in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(got[k].held_out for k, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[k].predicted == x for k, x in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_not_learned(spark):
    rows = toxic_rows(300)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    label = lambda k, x: 1 - x if zlib.crc32(str(k).encode()) % 3 == 1 else x
    one = toxicity.score_held_out(docs, spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int"))
    two = toxicity.score_held_out(docs, spark.createDataFrame([(k, label(k, x)) for k, _, x in rows], "doc_id long, toxic int"))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_offending_sentences_are_found(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, x) for k, _, x in rows], "doc_id long, toxic int"))
    probe = spark.createDataFrame([(1, "é plain words. then a grobble here! and more")], "doc_id long, text string")
    row = toxicity.score_documents(probe, model, with_spans=True).first()
    assert [("é plain words. then a grobble here! and more"[s.start : s.end]) for s in row.offending] == ["then a grobble here"]
    assert [r.doc_id for r in toxicity.reject_toxic(probe, model).collect()] == []


def test_toxicity_edge_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (None, "words"), (3, "12 34 !!"), (4, "w " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_held_out(docs, none).collect()
    assert len(got) == 6 and all(r.score == 0 and r.predicted == 0 for r in got)
    odd = spark.createDataFrame([(1, 1), (1, None), (2, 0), (2, 1), (None, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score_held_out(docs, odd).count() == 6
    assert toxicity.score_held_out(docs.limit(0), odd).count() == 0


def test_fit_bounds():
    assert toxicity.fit.__defaults__[:2] == (20_000, 20_000)  # rows and features



CLEAN = [
    "see https://example.com/wiki/Abc123/Some/Long/Path/To/Page for more",
    "user=anna visited https://news.example.org/2024/05/Some-Long-Title/AndMore1/AndMore2/AndMore3 today",
    "login=Abc123Def456Ghi789Jkl012Mno345Pqr678",
    "account: harbour, see /usr/share/Lib1/python3/Site/Packages/harbour/Main on 10.0.0.1",
    "https://example.org/?q=Abcdefghijklmnop1234567890ABCDEFGHIJ and user=anna",
]


def test_clean_texts_stay(spark):
    docs = spark.createDataFrame(list(enumerate(CLEAN)), "doc_id long, text string")
    assert [r["spans"] for r in secret_scan.scan(docs).orderBy("doc_id").collect()] == [""] * len(CLEAN)
    assert [r["text"] for r in secret_scan.redact(docs).orderBy("doc_id").collect()] == CLEAN


def test_parts_that_complete_each_other_do_not_overlap(spark):
    """Against all pairs of parts."""
    rng = random.Random(12)
    key = "Abc1Def2Ghi3Jkl4Mno5Pqr6Stu7Vwx8"
    bits = ["user=anna ", f"login={key} ", f"{key}{key} ", "https://a.example.com/x ", "10.1.2.3:80 ", "AKIA" + "B" * 16 + " ", "deadbeef" * 3 + " ", "token=abcdefg ", "word " * 9, "x " * 30]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = secret_scan.link(secret_scan.parts(frame, ["doc_id"]), ["doc_id"], 40).filter("kind is not null").collect()
    roles = [r for _, _, r in secret_scan.KINDS]
    by_doc = collections.defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for r in found:
        near = {roles[o["kind"]] for o in by_doc[r["doc_id"]]
                if (o["end"] <= r["start"] and r["start"] - o["end"] <= 40) or (o["start"] >= r["end"] and o["start"] - r["end"] <= 40)}
        want = {"name": "secret" in near, "secret": bool(near & {"name", "endpoint"}), "endpoint": {"name", "secret"} <= near}[roles[r["kind"]]]
        assert r["reported"] == (want or r["kind"] < secret_scan.BASE)


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "password = hunter22", "keepme", "b", "s", "t")]
    out = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string, __a string, __B string, __s string, __t string"))
    assert [tuple(r) for r in out.collect()] == [(1, "[assign]", "keepme", "b", "s", "t")]


# ---- noisy-or


def test_a_document_is_the_noisy_or_of_its_sentences(spark):
    rng = np.random.default_rng(3)
    words = ["harbour", "idiots", "lantern", "stupid", "quiet", "vermin", "boat", "grey"]
    sentences = [" ".join(rng.choice(words, rng.integers(1, 6))).capitalize() + "." for _ in range(60)]
    docs = [(k, " ".join(rng.choice(sentences, rng.integers(1, 8)))) for k in range(80)]
    labels = spark.createDataFrame([(k, int("stupid" in t.lower() or "vermin" in t.lower())) for k, t in docs], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels, least=1)
    assert len(model.features)
    ones = spark.createDataFrame(list(enumerate(sentences)), "doc_id long, text string")
    alone = {sentences[r["doc_id"]]: r["score"] for r in toxicity.score_documents(ones, model).collect()}
    found = {r["doc_id"]: r["score"] for r in toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for k, text in docs:
        harmless = 1.0
        for s in re.findall(r"[^.]+\.", text):
            harmless *= 1 - alone[s.strip()]
        assert abs(found[k] - (1 - harmless)) < 1e-9


def test_training_follows_plain_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 7)  # several blocks
    rng = np.random.default_rng(4)
    bags = [(int(rng.integers(0, 2)), [sorted(set(rng.integers(0, 6, rng.integers(0, 4)).tolist())) for _ in range(rng.integers(1, 6))]) for _ in range(30)]
    hits = [(k, s) for k, (_, ss) in enumerate(bags) for s in ss if s]
    got = toxicity._train(
        np.array([b for b, _ in bags]), np.array([len(ss) for _, ss in bags]), np.array([k for k, _ in hits]),
        np.array([len(s) for _, s in hits]), np.array([f for _, s in hits for f in s], dtype="<u2"), 6, 25, 0.01)
    w, bias, m, v = np.zeros(6), -4.0, np.zeros(7), np.zeros(7)
    for t in range(1, 26):
        g = np.append(0.01 * w, 0.0)
        for label, sentences in bags:
            p = [1 / (1 + np.exp(-(bias + sum(w[f] for f in s)))) for s in sentences]
            harmless = np.prod([1 - x for x in p])
            slope = -harmless / (1 - harmless) if label else 1.0
            for x, s in zip(p, sentences, strict=True):
                g[6] += slope * x
                for f in s:
                    g[f] += slope * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:6], bias - step[6]
    assert np.allclose(got[0], w, atol=1e-9) and abs(got[1] - bias) < 1e-9
