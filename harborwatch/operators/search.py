"""Substring search over chosen fields, and a watch-list over whole texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.plans.skew import fence, spread_join
from harborwatch.session import staged

DATA_FIELDS = ["email_address", "phone_number", "ip_address", "username", "misc"]
THREAD_FIELDS = ["title", "description"]


def like_pattern(term: str, literal: bool = False) -> str:
    """Pattern for ``%term%``; wildcards of the term work as such unless ``literal``."""
    if literal:
        return "%" + re.sub(r"([\\%_])", r"\\\1", term) + "%"
    # An escape before an ordinary character is dropped; one at the end takes the closing wildcard.
    return re.sub(r"(?s)\\(.)", lambda m: m.group() if m.group(1) in "%_\\" else m.group(1), f"%{term}%")


def matched_fields(fields: list[str], term: str, literal: bool = False) -> Column:
    """The fields whose text holds the term in any case; a null field never matches."""
    pattern = like_pattern(term, literal)
    hits = [F.when(F.col(f).cast("string").ilike(pattern), F.lit(f)) for f in fields]
    return F.array_compact(F.array(*hits))


def _search(df: DataFrame, fields: list[str], allowed: list[str], term: str, literal: bool) -> DataFrame | None:
    if not fields or term == "" or any(f not in allowed for f in fields):
        return None
    pattern = like_pattern(term, literal)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.col(f).cast("string").ilike(pattern)
    return df.filter(hit)


def search_records(data: DataFrame, fields: list[str], term: str, allowed: list[str] | None = None, literal: bool = False) -> DataFrame | None:
    """``data`` rows where any chosen field holds the term; None for a refused request."""
    return _search(data, fields, allowed or DATA_FIELDS, term, literal)


def search_threads(threads: DataFrame, fields: list[str], term: str, allowed: list[str] | None = None, literal: bool = False) -> DataFrame | None:
    return _search(threads, fields, allowed or THREAD_FIELDS, term, literal)


def search_all(data: DataFrame, threads: DataFrame, fields: list[str], term: str, literal: bool = False) -> DataFrame | None:
    """Both searches with the fields sorted to their table: ``kind, id, matched_fields, payload``."""
    parts = []
    for kind, df, id_col, allowed in (
        ("data", data, "_id_data", DATA_FIELDS), ("thread", threads, "_id_source_thread", THREAD_FIELDS),
    ):
        chosen = [f for f in fields if f in allowed]
        found = _search(df, chosen, allowed, term, literal)
        if found is not None:
            parts.append(found.select(
                F.lit(kind).alias("kind"), F.col(id_col).alias("id"),
                matched_fields(chosen, term, literal).alias("matched_fields"),
                F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("payload"),
            ))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def search_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("kind").agg(F.count("*").alias("n"))


# ---- watch-list ----------------------------------------------------------------------------

_GRAM = 4
#: Bits of the sieve of wanted runs, in words of 64: half a megabyte for a list of any length.
_SIEVE_WORDS = 1 << 16


def _grams(text: Column, size: int) -> Column:
    """Distinct character runs of one length: what a look-ahead sees from every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


#: Characters of a slice that is looked at in one go; with at most as many rows a (row, run) pair fits 64 bits.
_SLICE_CHARS, _SLICE_ROWS = 1 << 20, 1 << 16
#: Odd factors, one for each character of a run and one for its length.
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, and where each text ends."""
    flat = np.frombuffer("".join(x or "" for x in texts).encode("utf-32-le"), np.uint32)
    return flat, np.cumsum([len(x or "") for x in texts], dtype=np.int64)


def _slots(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bit in the sieve of the run of ``size`` characters that starts at each place."""
    n = len(codes) - size + 1
    mixed = np.full(max(n, 0), (size * _FACTORS[_GRAM]) % (1 << 64), np.uint64)
    for k in range(size if n > 0 else 0):
        mixed += codes[k:k + n].astype(np.uint64) * np.uint64(_FACTORS[k])
    return ((mixed >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def _sieve(runs: DataFrame) -> np.ndarray:
    """``_SIEVE_WORDS`` words with the bits of all ``run`` set; their size doesn't depend on the number of runs."""
    bits = _SIEVE_WORDS * 64

    @F.arrow_udf("bigint")
    def slot(run: pa.Array) -> pa.Array:
        codes, ends = _codes(run.to_pylist())
        sizes = np.diff(ends, prepend=0)
        out = np.zeros(len(ends), np.int64)
        for size in np.unique(sizes):
            mine = sizes == size
            out[mine] = _slots(codes, int(size), bits)[ends[mine] - size]
        return pa.array(out)

    at = runs.select(slot("run").alias("at")).select(F.shiftright("at", 6).alias("id"), F.col("at").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    words = np.zeros(_SIEVE_WORDS, np.int64)
    for r in at.groupBy("id").agg(F.bit_or(one).alias("bits")).collect():  # at most _SIEVE_WORDS rows
        words[r["id"]] = r["bits"]
    return words


def _distinct(row: np.ndarray, part: list[np.ndarray], rows: int, letters: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The distinct (row, run) pairs: rows, the first three letters and the last, letters as numbers below ``letters``."""
    if rows * letters**_GRAM < 1 << 63:  # a pair fits one number
        pairs = row
        for letter in part:
            pairs = pairs * letters + letter
        pairs, back = np.sort(pairs), []  # np.unique hashes, which takes longer
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        for _ in part:
            pairs, letter = np.divmod(pairs, letters)
            back.append(letter)
        return pairs, back[:0:-1], back[0]
    # A letter has 21 bits: the first three fit one number, and that number's rank fits beside the row and the last.
    three, rank = np.unique(part[0] << 42 | part[1] << 21 | part[2], return_inverse=True)
    pairs = np.unique((row * len(three) + rank) << 21 | part[3])
    row, rank = np.divmod(pairs >> 21, max(len(three), 1))
    mask, first = (1 << 21) - 1, three[rank]
    return row, [first >> 42, first >> 21 & mask, first & mask], pairs & mask


def _held_runs(texts: list[str | None], sizes: list[int], sieve: np.ndarray) -> pa.Array:
    """The distinct runs of each text that the sieve (a flag per bit) holds; none for a null."""
    codes, ends = _codes(texts)
    alphabet = np.flatnonzero(np.bincount(codes, minlength=1))
    alphabet = alphabet if len(alphabet) else np.zeros(1, np.int64)
    place = np.zeros(alphabet[-1] + 1, np.int64)
    place[alphabet] = np.arange(len(alphabet))
    letters = place[codes]
    row_at = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    rows, chars, lengths = [], [], []
    for size in sizes:
        at = np.flatnonzero(sieve[_slots(codes, size, len(sieve))])
        row = row_at[at]
        inside = at + size <= ends[row]
        at, row = at[inside], row[inside]
        part = [letters[at + k] if k < size else np.zeros(len(at), np.int64) for k in range(_GRAM)]
        row_of, heads, last = _distinct(row, part, len(texts), len(alphabet))
        rows.append(row_of)
        chars.append(alphabet[np.stack([*heads, last], axis=1)])
        lengths.append(np.full(len(row_of), size))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    grid, length = np.concatenate(chars)[order], np.concatenate(lengths)[order]
    used = np.arange(_GRAM) < length[:, None]
    octets = np.where(used, 1 + (grid >= 0x80) + (grid >= 0x800) + (grid >= 0x10000), 0).sum(axis=1)
    data = grid[used].astype(np.uint32).tobytes().decode("utf-32-le").encode()
    starts = np.concatenate([[0], np.cumsum(octets)]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(grid), pa.py_buffer(starts), pa.py_buffer(data))
    bounds = np.searchsorted(row[order], np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), strings)


def _sifted(text: Column, sizes: list[int], words: np.ndarray) -> Column:
    """The distinct runs of a text that the sieve holds, and a few that share their bit."""
    @F.arrow_udf("array<string>")
    def held(text: pa.Array) -> pa.Array:
        sieve = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)
        texts = text.to_pylist()
        ends = np.cumsum([len(x or "") for x in texts], dtype=np.int64)
        out, at = [], 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, min(at + _SLICE_ROWS, int(np.searchsorted(ends, done + _SLICE_CHARS, side="right"))))
            out.append(_held_runs(texts[at:to], sizes, sieve))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    return held(text)


def search_batch(df: DataFrame, key: list[str], text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """``(*key, term)`` once for every row whose text holds the term, in any case.

    One way for a list of any size: every term is tied to one character run of its own (four long, or the
    term itself when shorter), the rarest one in the texts. A row keeps those of its runs that a sieve of
    fixed size lets through and is written with them, or dropped where none is left; so no run is exploded
    or shuffled that ties no term, but for the sieve's few errors. Texts meet terms by an equi-join on the
    run, and the pairs are then checked in full. Rows are numbered in the written table, so rows of equal
    key stay rows of their own.
    """
    listed = terms.select(F.col(term).alias("term"), F.lower(term).alias("low")).filter(F.col("low") != "").distinct()
    run = F.when(F.length("low") >= _GRAM, _grams(F.col("low"), _GRAM)).otherwise(F.array("low"))
    term_runs = staged(listed.select("term", "low", F.explode(run).alias("run")), "term-runs")
    lengths = term_runs.select(F.length("run").alias("n")).distinct()
    sizes = sorted(r.n for r in lengths.collect())  # at most _GRAM numbers
    if not sizes:
        return df.select(*key, F.lit(None).cast("string").alias("term")).limit(0)

    low = df.select(*key, F.lower(F.col(text)).alias("__text"))
    sifted = fence(low.withColumn("__runs", _sifted(F.col("__text"), sizes, _sieve(term_runs))))
    texts = staged(sifted.filter(F.size("__runs") > 0).withColumn("__row", F.monotonically_increasing_id()), "texts")
    weight = texts.select(F.explode("__runs").alias("run")).groupBy("run").agg(F.count("*").alias("texts"))
    tied = staged(
        term_runs.join(weight, "run")  # a run in no text has no weight; the term cannot be found
        .groupBy("term", "low")
        .agg(F.min(F.struct("texts", "run")).alias("rarest"))
        .select("term", "low", F.col("rarest.run").alias("run")),
        "tied",
    )
    text_runs = texts.select("__row", F.explode(_sifted(F.col("__text"), sizes, _sieve(tied))).alias("run"))
    pairs = spread_join(text_runs, tied, ["run"], ["__row"]).select("__row", "term", "low")
    return texts.drop("__runs").join(pairs, "__row").filter(F.col("__text").contains(F.col("low"))).select(*key, "term")
