"""Date column expressions for text scraped from pages. All times are UTC.

Accepted by :func:`native_date`: ISO 8601 dates and date-times; ``M/D/YYYY``; ``Month D, YYYY``;
``D Month YYYY`` and RFC 2822 -- each with an optional time, and an optional zone where the form has
one. Parts out of range roll over into the next unit, as day 31 of February does in a browser.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborwatch.config import BIG, MID, check_semantics
from harborwatch.functions.text import digit_share_points, let

# Month names.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?\s*([aApP][mM])?"
_ZONE = r"\s*(Z|UTC|GMT|(?:GMT|UTC)?[+-]\d{2}:?\d{2})?(?:\s*\([^)]*\))?"
_DAY_NAME = r"(?:[A-Za-z]{3,9},?\s+)?"
_ISO = r"^\s*(\d{4})-(\d{2})(?:-(\d{2}))?(?:[T ]" + _TIME + _ZONE + r")?\s*\z"
_US = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+" + _TIME + _ZONE + r")?\s*\z"
_MONTH_FIRST = (
    r"^\s*" + _DAY_NAME + r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+" + _TIME + _ZONE + r")?\s*\z"
)
_DAY_FIRST = (
    r"^\s*" + _DAY_NAME + r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})(?:,?\s+" + _TIME + _ZONE + r")?\s*\z"
)
# The two custom forms, found anywhere in the text.
_CUSTOM_NAMED = r"(\d{1,2})\s+([A-Za-z]+),\s+(\d{4})\s+-\s+(\d{1,2}):(\d{2})\s+(AM|PM)"
_CUSTOM_SLASH = r"(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2})"


def rolled_timestamp(
    year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column
) -> Column:
    """Timestamp from parts; a part above its range moves on into the next unit."""
    year = F.when(year < 100, year + 1900).otherwise(year)
    first = F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1)
    days = F.unix_date(first).cast("bigint") + day - 1
    return F.timestamp_seconds(days * 86400 + hour * 3600 + minute * 60 + second)


def _number(part: Column) -> Column:
    return F.nullif(part, F.lit("")).cast("int")


def _parts(text: Column, forms: list[tuple[str, str]]) -> Column:
    """The groups of the first form that fits, in the order its template gives, as an array."""
    line = F.when(F.lit(False), F.lit(""))
    for pattern, template in forms:
        line = line.when(text.rlike(pattern), F.regexp_replace(text, pattern, template))
    return F.split(line, r"\|", -1)


def _month_number(part: Column) -> Column:
    """Number of a month given as digits or by the first three letters of its name."""
    short = F.lit([m[:3].lower() for m in MONTHS])
    named = F.nullif(F.array_position(short, F.lower(F.left(part, F.lit(3)))), F.lit(0)).cast("int")
    return F.when(part.rlike(r"^[0-9]+\z"), part.cast("int")).otherwise(named)


def _shift_seconds(zone: Column) -> Column:
    digits = F.regexp_replace(zone, "[^0-9]", "")
    seconds = F.coalesce(_number(F.left(digits, F.lit(2))), F.lit(0)) * 3600 + F.coalesce(
        _number(F.substr(digits, F.lit(3))), F.lit(0)
    ) * 60
    return F.when(zone.contains("-"), -seconds).otherwise(seconds)


# Year, month, day, hour, minute, second, half of the day, zone.
_NATIVE_FORMS = [
    (_ISO, "$1|$2|$3|$4|$5|$6|$7|$8"),
    (_US, "$3|$1|$2|$4|$5|$6|$7|$8"),
    (_MONTH_FIRST, "$3|$1|$2|$4|$5|$6|$7|$8"),
    (_DAY_FIRST, "$3|$2|$1|$4|$5|$6|$7|$8"),
]


def _native_stamp(p: Column) -> Column:
    hour, half = F.coalesce(_number(p[3]), F.lit(0)), F.upper(p[6])
    parts = F.struct(
        _month_number(p[1]).alias("month"), F.coalesce(_number(p[2]), F.lit(1)).alias("day"),
        F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour).alias("hour"),
        F.coalesce(_number(p[4]), F.lit(0)).alias("minute"), F.coalesce(_number(p[5]), F.lit(0)).alias("second"),
    )

    def stamp(d: Column) -> Column:
        ok = (
            d["month"].between(1, 12) & d["day"].between(1, 31)
            & (d["hour"] <= 24) & (d["minute"] < 60) & (d["second"] < 60)
        )
        second = d["second"] - _shift_seconds(p[7])
        return F.when(ok, rolled_timestamp(_number(p[0]), d["month"], d["day"], d["hour"], d["minute"], second))

    return let(parts, stamp)


def native_date(text: Column) -> Column:
    """What a browser's date constructor makes of the text, for the forms listed above; else null."""
    return let(_parts(text, _NATIVE_FORMS), _native_stamp)


def custom_date(text: Column, semantics: str = "reference") -> Column:
    """``D Month, YYYY - H:MM AM/PM`` anywhere in the text, else ``D/M/YYYY H:M``; else null.

    As written, 12 AM stays hour 12; intended, it is hour 0.
    """
    intended = check_semantics(semantics)

    def stamp(p: Column) -> Column:
        hour, half = _number(p[3]), p[5]
        hour24 = F.when((half == "PM") & (hour != 12), hour + 12)
        if intended:
            hour24 = hour24.when((half == "AM") & (hour == 12), 0)
        full = F.nullif(F.array_position(F.lit(MONTHS), p[1]), F.lit(0)).cast("int")
        month = F.when(p[1].rlike(r"^[0-9]+\z"), p[1].cast("int")).otherwise(full)
        return rolled_timestamp(_number(p[2]), month, _number(p[0]), hour24.otherwise(hour), _number(p[4]), F.lit(0))

    def found(pattern: str, template: str) -> Column:
        # The search for the bare form goes once over a text, a lazy match of what precedes it takes many times as long.
        whole = r"(?s)^.*?" + pattern + r".*\z"
        line = F.when(text.rlike(pattern), F.regexp_replace(text, whole, template))
        return let(F.split(line, r"\|", -1), stamp)

    return F.coalesce(found(_CUSTOM_NAMED, "$1|$2|$3|$4|$5|$6"), found(_CUSTOM_SLASH, "$1|$2|$3|$4|$5|"))


def parse_date(text: Column, semantics: str = "reference") -> Column:
    return F.coalesce(native_date(text), custom_date(text, semantics))


def first_date(texts: Column, semantics: str = "reference") -> Column:
    """The first text of the array that reads as a date."""
    parsed = F.transform(texts, lambda t: parse_date(t, semantics))
    return F.get(F.filter(parsed, lambda d: d.isNotNull()), F.lit(0))


def date_score(text: Column, as_of: Column, semantics: str = "reference") -> Column:
    """Length, a parsed date before ``as_of`` and the share of digits, 50 to 100 points each."""
    def points(t: Column) -> Column:
        return (
            F.when(F.length(t) < 15, -MID).otherwise(MID)
            + F.when(F.coalesce(parse_date(t, semantics) < as_of, F.lit(False)), MID).otherwise(-BIG)
            + digit_share_points(t)
        )

    return let(text, points)
