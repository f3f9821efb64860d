"""Text column expressions: trimming, cell tests, keyword and length scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborwatch.config import BIG, DESCRIPTION_WORDS, MID, SMALL, check_semantics

# What the web platform treats as white space, as characters and as a regex class.
WHITE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WHITE_CLASS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Cell tests (name -> pattern, end of text written as \z).
CELL_TESTS = {
    "email_address": (
        r"[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
        r"@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
    ),
    "phone_number": (
        r"^((\+?\d{1,2}[" + WHITE_CLASS + r"])?\(?\d{2,3}\)?[" + WHITE_CLASS + r".-]\d{3,4}["
        + WHITE_CLASS + r".-]\d{4}|\+?\d{10,12})\z"
    ),
    "ip_address": (
        r"\b(?:(?:2(?:[0-4][0-9]|5[0-5])|[0-1]?[0-9]?[0-9])\.){3}"
        r"(?:(?:2([0-4][0-9]|5[0-5])|[0-1]?[0-9]?[0-9]))\b"
    ),
    "username": r"^[a-z,A-Z]{3,12}([0-9]{0,8})\z",
}


# Is there a match of the e-mail pattern at all? One character before the sign, one label, one dot and
# one character after it decide that, in time linear in the cell.
_EMAIL_FOUND = r"[a-z0-9!#$%&'*+/=?^_`{|}~-]@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.[a-z0-9]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def squash_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITE_CLASS}]+", " ")


def cell_test(name: str, cell: Column, semantics: str = "reference") -> Column:
    """Does the cell look like the standard field? A missing cell reads "undefined" as written."""
    missing = "" if check_semantics(semantics) else "undefined"
    text = F.coalesce(cell, F.lit(missing))
    if name == "email_address":
        return text.rlike(_EMAIL_FOUND)
    return text.rlike(CELL_TESTS[name])


def occurrences(text: Column, word: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty literal word."""
    w = F.lit(word) if isinstance(word, str) else word
    left = F.octet_length(F.replace(text, w, F.lit("")))
    return ((F.octet_length(text) - left) / F.octet_length(w)).cast("int")


def _points(matches: Column, points: int, cap: int | None) -> Column:
    return (F.least(matches, F.lit(cap)) if cap else matches) * F.lit(points)


def keyword_score(
    text: Column,
    good: list[str],
    bad: list[str],
    good_points: int = SMALL,
    bad_points: int = -SMALL,
    cap: int | None = None,
    extra: Column | None = None,
    semantics: str = "reference",
) -> Column:
    """Points for good and bad words in a text; ``extra`` is an array column of further good words.

    As written, only an empty text is looked at, so a word can match only by being empty (bad words
    are patterns, so one that matches nothing-at-all counts too), and with a cap points are given
    only below the cap. Intended: lower-case text, literal words, at most ``cap`` matches per word.
    """
    if check_semantics(semantics):
        def intended(low: Column) -> Column:
            score = F.lit(0)
            for word in good:
                if word:
                    score = score + _points(occurrences(low, word), good_points, cap)
            for word in bad:
                if word:
                    score = score + occurrences(low, word) * F.lit(bad_points)
            if extra is not None:
                words = F.filter(extra, lambda w: w != "")
                score = score + F.aggregate(
                    words, F.lit(0), lambda a, w: a + _points(occurrences(low, w), good_points, cap)
                )
            return score

        return let(F.lower(text), intended)
    per_empty = good_points if not cap or cap > 1 else 0
    fixed = good.count("") * per_empty + sum(len(re.findall(p, "")) for p in bad) * bad_points
    score = F.lit(fixed)
    if extra is not None and per_empty:
        score = score + F.size(F.filter(extra, lambda w: w == "")) * F.lit(per_empty)
    return F.when(F.length(text) == 0, score).otherwise(F.lit(0))


def title_words(title: Column) -> Column:
    """The trimmed title cut at every single space (two spaces give an empty word)."""
    return F.split(js_trim(title), " ", -1)


def title_score(
    text: Column, title: Column, good: list[str], bad: list[str], cap: int | None = 1,
    semantics: str = "reference",
) -> Column:
    return keyword_score(text, good, bad, cap=cap, extra=title_words(title), semantics=semantics)


def description_score(
    text: Column, title: Column, good: list[str], bad: list[str], semantics: str = "reference"
) -> Column:
    """+100 above 300 characters, else -100, plus keyword points; bad words raise it as written."""
    bad_points = -SMALL if check_semantics(semantics) else SMALL
    return F.when(F.length(text) > 300, BIG).otherwise(-BIG) + keyword_score(
        text, good + DESCRIPTION_WORDS, bad, SMALL, bad_points, extra=title_words(title), semantics=semantics
    )


def digit_share_points(text: Column) -> Column:
    digits = F.length(F.regexp_replace(text, "[^0-9]+", ""))  # a match for each run, not for each character
    return F.when(digits > F.length(text) - digits, MID).otherwise(-MID)


def ordered_numbers(text: Column, shortest: int = 2, longest: int = 8) -> Column:
    """Is there a run of rising digits (gaps allowed) whose length lies in the bounds?"""
    runs = F.regexp_extract_all(text, F.lit("(?=[0-9])(0?1?2?3?4?5?6?7?8?9?)"), F.lit(1))
    return F.exists(runs, lambda r: F.length(r).between(shortest, longest))


def supported_filetype(name: Column, filetypes: tuple[str, ...] | list[str]) -> Column:
    """Does the file name end in one of the extensions, in any case? No name: false."""
    hit = F.lit(False)
    for ext in filetypes:
        hit = hit | F.lower(name).endswith("." + ext)
    return F.coalesce(hit, F.lit(False))


def truncate_description(c: Column) -> Column:
    return F.left(c, F.lit(65535))


def channel_key(domain: Column) -> Column:
    """A minus sign and 13 digits is a numeric channel id, everything else a tag."""
    numeric = domain.rlike(r"^-[0-9]{13}\z")
    return F.struct(
        F.when(numeric, domain).try_cast("bigint").alias("id"),
        F.when(~numeric, domain).alias("tag"),
    )
