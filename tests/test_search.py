"""Substring search and the watch-list."""

import re

import numpy as np
import pytest

from harborwatch.operators import search

DATA = "_id_data long, email_address string, phone_number string, ip_address string, username string, misc string"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([
        (1, "neo@example.com", "555", None, "Neo", '{"k":"100%"}'),
        (2, "trin@example.com", None, "192.0.2.1", "a_b", '{"k":"axb"}'),
        (3, None, None, None, None, None),
    ], DATA)


def ids(df, key="_id_data"):
    return sorted(r[key] for r in df.collect())


@pytest.mark.parametrize("fields,term,literal,want", [
    (["username"], "NEO", False, [1]),
    (["username", "email_address"], "n", False, [1, 2]),
    (["username", "misc"], "a_b", False, [2]),
    (["misc"], "a_b", False, [2]),
    (["misc"], "a_b", True, []),
    (["misc"], "0%", True, [1]),
    (["misc"], "\\%", False, [1]),
    (["misc"], "\\k", False, [1, 2]),
    (["username"], "o\\", False, []),
    (["ip_address"], "192", False, [2]),
])
def test_search_records(data, fields, term, literal, want):
    assert ids(search.search_records(data, fields, term, literal=literal)) == want


@pytest.mark.parametrize("fields,term", [([], "x"), (["username"], ""), (["username", "_id_data"], "x"), (["title"], "x")])
def test_refused_requests(data, fields, term):
    assert search.search_records(data, fields, term) is None


def test_search_all_reports_both_kinds(spark, data):
    threads = spark.createDataFrame([(7, "Neo leak", "x"), (8, "y", "z")], "_id_source_thread long, title string, description string")
    hits = search.search_all(data, threads, ["username", "email_address", "title"], "neo")
    got = {(r["kind"], r["id"]): sorted(r["matched_fields"]) for r in hits.collect()}
    assert got == {("data", 1): ["email_address", "username"], ("thread", 7): ["title"]}
    assert {r["kind"]: r["n"] for r in search.search_counts(hits).collect()} == {"data": 1, "thread": 1}
    assert search.search_all(data, threads, ["title"], "neo").columns == hits.columns
    assert search.search_all(data, threads, [], "neo") is None


@pytest.mark.parametrize("more", [0, 700])
def test_watch_list_equals_brute_force_for_any_list_size(spark, more):
    texts = ["The quick brown fox", "QUICK quack é", "a", "", None, "needle in hay " * 50, "über straße", "fox fox fox"]
    texts += ["a fox", "a fox"]
    terms = ["quick", "QU", "a", "é", "needle in", "fox", "zzz", "", "straße", "ick bro", "fox"] + [f"other{k}" for k in range(more)]
    ids = [*range(len(texts) - 2), 99, 99]  # rows of one key stay rows
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id long, text string")
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r["id"], r["term"]) for r in search.search_batch(docs, ["id"], "text", listed).collect())
    want = sorted((i, t) for i, x in zip(ids, texts, strict=True) if x is not None for t in set(terms) if t and t.lower() in x.lower())
    assert got == want


def test_watch_list_of_nothing(spark):
    docs = spark.createDataFrame([(1, "x")], "id long, text string")
    got = search.search_batch(docs, ["id"], "text", spark.createDataFrame([("",)], "term string"))
    assert got.columns == ["id", "term"] and got.count() == 0


def test_pattern_keeps_escapes():
    assert search.like_pattern("a%b") == "%a%b%"
    assert search.like_pattern("a%b", literal=True) == r"%a\%b%"
    assert search.like_pattern(r"\a") == "%a%"
    assert re.search(r"\\%\Z", search.like_pattern("a\\"))


@pytest.mark.parametrize("words", [1, 1 << 16])
def test_watch_list_with_a_crowded_sieve_and_astral_letters(spark, monkeypatch, words):
    """A sieve of 64 bits lets nearly every run through; the result stays the same."""
    monkeypatch.setattr(search, "_SIEVE_WORDS", words)
    texts = ["a😀b😀", "😀😀😀😀😀", "b😀", "x" * 5000 + "😀needle", "line\nbreak", "plain"] + [f"row {k:04d}" for k in range(200)]
    terms = ["😀b", "😀😀😀😀", "😀", "x😀need", "ne\nbr", "0007", "ow 01", "nothing like it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    listed = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r["id"], r["term"]) for r in search.search_batch(docs, ["id"], "text", listed).collect())
    assert got == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)


def test_only_runs_that_may_tie_a_term_are_written(spark, monkeypatch):
    written = {}
    staged = search.staged

    def keep(df, label):
        written[label] = staged(df, label)
        return written[label]

    monkeypatch.setattr(search, "staged", keep)
    docs = spark.createDataFrame([(k, f"text {k} of many runs") for k in range(300)] + [(300, "a needle")], "id long, text string")
    search.search_batch(docs, ["id"], "text", spark.createDataFrame([("needle",)], "term string"))
    rows = written["texts"].collect()
    assert [r["id"] for r in rows] == [300] and set(rows[0]["__runs"]) == {"need", "eedl", "edle"}


def test_held_runs_equal_a_loop_over_all_places(monkeypatch):
    """Runs of mixed lengths, cut into slices, with astral characters, nulls and empty texts at any place."""
    texts = ["", None, "abcabc", "a😀b😀a😀b", "ab", "", "é" * 9 + "￿\U0010ffff", None] * 3
    sieve = np.zeros(256, bool)
    sieve[::3] = True
    want = [
        sorted({t[i:i + n] for t in [x or ""] for n in (1, 2, 4) for i in range(len(t) - n + 1)
                if sieve[search._slots(search._codes([t[i:i + n]])[0], n, 256)[0]]})
        for x in texts
    ]
    assert sum(map(len, want)) > 20
    got = search._held_runs(texts, [1, 2, 4], sieve).to_pylist()
    assert [sorted(x) for x in got] == want


def test_held_runs_of_many_letters():
    """Too many letters for a row and a run to fit one number."""
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 20000))) + "\U00020000\U0010ffff"
    got = search._held_runs([text, "", text + text], [4], np.ones(64, bool)).to_pylist()
    assert [len(x) for x in got] == [len(text) - 3, 0, len(text)]
    assert got[0] == sorted({text[i:i + 4] for i in range(len(text) - 3)}) and set(got[0]) < set(got[2])
    many = [text[:9000]] * 40_000
    assert len(many) * 9000**4 > 1 << 63
    rows, heads, last = search._distinct(np.array([3, 1, 1]), [np.array([5, 8999, 8999])] * 4, len(many), 9000)
    assert rows.tolist() == [1, 3] and last.tolist() == [8999, 5] and [h.tolist() for h in heads] == [[8999, 5]] * 3
