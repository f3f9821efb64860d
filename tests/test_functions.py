"""Text, URL and date expressions on hand-worked cases."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harborwatch.functions import dates, html_fold, text, urls


@pytest.mark.parametrize("name,cell,want", [
    ("email_address", "a.b@example.com", True),
    ("email_address", "A.B@EXAMPLE.COM", False),
    ("email_address", "see x@example.com now", True),
    ("email_address", "@" + "a" * 300_000 + " x.y@a-b.c", True),
    ("email_address", "a@" + "b." * 0 + "c", False),
    ("email_address", "a@-b.c", False),
    ("email_address", "a@b-.c d@e.", False),
    ("phone_number", "+1 (555) 010-1234", True),
    ("phone_number", "555-0100-1234", True),
    ("phone_number", "15550101234", True),
    ("phone_number", "15550101234\n", False),
    ("phone_number", "call 15550101234", False),
    ("ip_address", "at 192.0.2.1 today", True),
    ("ip_address", "999.1.1.1", False),
    ("username", "neo1999", True),
    ("username", "a,b", True),
    ("username", "neo1999\n", False),
    ("username", "ab", False),
])
def test_cell_tests(value, name, cell, want):
    assert value(text.cell_test(name, F.col("c")), c=("string", cell)) is want


def test_missing_cell_reads_undefined_as_written(value):
    assert value(text.cell_test("username", F.col("c")), c=("string", None)) is True
    assert value(text.cell_test("username", F.col("c"), "intended"), c=("string", None)) is False


def test_trim_is_unicode(value):
    assert value(text.js_trim(F.col("c")), c=("string", " ﻿\t x  ")) == "x"


@pytest.mark.parametrize("s,want", [
    ("124", True), ("1 2 3", False), ("9876", False), ("0123456789", False), ("x45y", True), ("", False), ("11", False),
])
def test_ordered_numbers(value, s, want):
    assert value(text.ordered_numbers(F.col("c")), c=("string", s)) is want


def test_keyword_score_as_written_only_sees_empty_text(value):
    score = text.keyword_score(F.col("c"), ["leak", ""], ["x*", "old"])
    assert value(score, c=("string", "leak leak")) == 0
    assert value(score, c=("string", "")) == 5 - 5
    capped = text.keyword_score(F.col("c"), ["", ""], [], cap=1)
    assert value(capped, c=("string", "")) == 0


def test_keyword_score_intended(value):
    c = ("string", "Leak leak LEAK old avatar a.com acom")
    assert value(text.keyword_score(F.col("c"), ["leak"], [], semantics="intended"), c=c) == 15
    assert value(text.keyword_score(F.col("c"), ["leak"], [], cap=1, semantics="intended"), c=c) == 5
    assert value(text.keyword_score(F.col("c"), [".com"], ["old", "avatar", "avatar"], semantics="intended"), c=c) == 5 - 15
    extra = F.array(F.lit(""), F.lit("leak"))
    assert value(text.keyword_score(F.col("c"), [], [], extra=extra, semantics="intended"), c=c) == 15


def test_description_score_bad_words_raise_as_written(value):
    long = "old " * 100
    score = lambda s: text.description_score(F.col("c"), F.lit("zzz"), [], ["old"], s)
    assert value(score("reference"), c=("string", long)) == 100
    assert value(score("intended"), c=("string", long)) == 100 - 500
    # An empty text with an empty title meets one empty title word.
    assert value(text.description_score(F.col("c"), F.lit(" "), [], []), c=("string", "")) == -100 + 5


@pytest.mark.parametrize("name,want", [
    ("A.CSV", True), ("a.csv.zip", False), (None, False), ("csv", False), ("x.csv", True),
])
def test_supported_filetype(value, name, want):
    assert value(text.supported_filetype(F.col("c"), ("csv",)), c=("string", name)) is want


def test_channel_key(value):
    assert value(text.channel_key(F.col("c")), c=("string", "-1234567890123")).asDict() == {"id": -1234567890123, "tag": None}
    assert value(text.channel_key(F.col("c")), c=("string", "-12345")).asDict() == {"id": None, "tag": "-12345"}


def test_semantics_name_is_checked():
    with pytest.raises(ValueError):
        text.keyword_score(F.lit(""), [], [], semantics="fixed")


BASE = "https://Forum.example:443/a/b/list.php?p=1#top"


@pytest.mark.parametrize("href,want", [
    ("thread/1", "https://forum.example/a/b/thread/1"),
    ("/t/1", "https://forum.example/t/1"),
    ("//Other.example/x", "https://other.example/x"),
    ("http://Other.example", "http://other.example/"),
    ("http://other.example:8080/a?x=1#f", "http://other.example:8080/a?x=1#f"),
    ("?p=2", "https://forum.example/a/b/list.php?p=2"),
    ("#end", "https://forum.example/a/b/list.php?p=1#end"),
    ("", "https://forum.example/a/b/list.php?p=1"),
    (None, "https://forum.example/a/b/list.php?p=1"),
    ("../up/./x/..", "https://forum.example/a/up/"),
    ("../../../x", "https://forum.example/x"),
    (" sp ace\n", "https://forum.example/a/b/sp%20ace"),
    ("/é?q=é", "https://forum.example/%C3%A9?q=%C3%A9"),
    ("mailto:x@example.com", "mailto:x@example.com"),
])
def test_resolve_url(value, href, want):
    assert value(urls.resolve_url(F.col("h"), F.col("b")), h=("string", href), b=("string", BASE)) == want


@pytest.mark.parametrize("url,want", [
    ("http://abc.onion/x", 2), ("http://abc.ONION:8080", 2), ("https://abc.example/x.onion", 0), ("junk", 0),
])
def test_origin_category(value, url, want):
    assert value(urls.origin_category(F.col("u")), u=("string", url)) == want


def when(*parts):
    return datetime(*parts)


@pytest.mark.parametrize("s,want", [
    ("14 March, 2023 - 12:05 AM", when(2023, 3, 14, 12, 5)),
    ("on 14 March, 2023 - 1:05 PM!", when(2023, 3, 14, 13, 5)),
    ("14 march, 2023 - 1:05 PM", None),
    ("31/02/2023 25:61", when(2023, 3, 4, 2, 1)),
    ("x 13/4/2023 5:07 y", when(2023, 4, 13, 5, 7)),
    ("14 Foo, 2023 - 1:05 PM 1/2/2023 3:04", when(2023, 2, 1, 3, 4)),
    ("", None),
])
def test_custom_date(value, s, want):
    got = value(F.date_format(dates.custom_date(F.col("s")), "yyyy-MM-dd HH:mm"), s=("string", s))
    assert got == (want and want.strftime("%Y-%m-%d %H:%M"))


def test_midnight_is_hour_zero_when_intended(value):
    got = value(F.date_format(dates.custom_date(F.col("s"), "intended"), "HH:mm"), s=("string", "14 March, 2023 - 12:05 AM"))
    assert got == "00:05"


@pytest.mark.parametrize("s,want", [
    ("2023-04-03", "2023-04-03 00:00:00"),
    ("2023-04-03T05:07:08Z", "2023-04-03 05:07:08"),
    ("2023-04-03T05:07:08.123+02:00", "2023-04-03 03:07:08"),
    ("3/4/2023 5:07", "2023-03-04 05:07:00"),
    ("3/4/2023 5:07 PM", "2023-03-04 17:07:00"),
    ("13/4/2023 5:07", None),
    ("Apr 3, 2023", "2023-04-03 00:00:00"),
    ("April 3, 2023 17:45", "2023-04-03 17:45:00"),
    ("Mon, 03 Apr 2023 10:00:00 -0130", "2023-04-03 11:30:00"),
    ("Mon Apr 3 2023 10:00:00 GMT+0200 (CEST)", "2023-04-03 08:00:00"),
    ("3 Foo 2023", None),
    ("hello", None),
    ("", None),
])
def test_native_date(value, s, want):
    assert value(F.date_format(dates.native_date(F.col("s")), "yyyy-MM-dd HH:mm:ss"), s=("string", s)) == want


def test_native_form_wins_over_custom(value):
    """Day 13 can only be the custom form; day 3 reads as a month first."""
    assert value(F.date_format(dates.parse_date(F.col("s")), "MM-dd"), s=("string", "13/4/2023 5:07")) == "04-13"
    assert value(F.date_format(dates.parse_date(F.col("s")), "MM-dd"), s=("string", "3/4/2023 5:07")) == "03-04"


def test_first_date_takes_the_first_that_parses(value):
    got = value(
        F.date_format(dates.first_date(F.col("a")), "yyyy"), a=("array<string>", ["by x", "13/4/2021 5:07", "2022-01-01"])
    )
    assert got == "2021"


@pytest.mark.parametrize("s,want", [
    ("2023-01-01 10:00:00", 50 + 50 + 50),
    ("2023-01-01", -50 + 50 + 50),
    ("2030-01-01 10:00:00", 50 - 100 + 50),
    ("14 March, 2023 - 12:05 AM", 50 + 50 - 50),
    ("", -50 - 100 - 50),
])
def test_date_score(value, s, want):
    assert value(dates.date_score(F.col("s"), F.to_timestamp(F.lit("2024-01-01"))), s=("string", s)) == want


def test_long_texts_are_scanned_once_for_dates_and_digits(value):
    long = "no date, 12 lines of words 3/4 and more\n" * 2000
    stamp = F.date_format(dates.custom_date(F.col("s")), "yyyy-MM-dd HH:mm")
    assert value(stamp, s=("string", long)) is None
    assert value(stamp, s=("string", f"{long} 14 March, 2023 - 11:05 PM, then 1/2/2020 3:04 {long}")) == "2023-03-14 23:05"
    assert value(text.digit_share_points(F.col("s")), s=("string", long)) == -50
    assert value(text.digit_share_points(F.col("s")), s=("string", long + "7" * (len(long) + 1))) == 50
    seen = str(dates.custom_date(F.col("s"))) + str(text.digit_share_points(F.col("s")))
    assert "rlike(s, '(?s)^.*?" not in seen and "[^0-9]+" in seen


def test_white_space_runs_become_one_space():
    """Single spaces aren't matched at all; whatever else is white space reads as one."""
    for s in ("a b", " a", "a ", "a  b", " \n ", "\t", "a\u2003 b", "a \ufeffb", "x\u00a0y", "a\n\nb  c d", ""):
        assert html_fold.SPACE_RUN.sub(" ", s) == re.sub("[\t\n\x0b\x0c\r \u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+", " ", s)
    assert not html_fold.SPACE_RUN.search("a b c")
