"""Settings and the fixed dictionaries the scorers use."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

# Scoring dictionaries. "avatar" counts twice on purpose.
GOOD_WORDS = [
    "data", "breach", "leak", "combo", "log", "list", "reply", "view", "replies", "topic", "title",
    "db", "csv", "database", "xls", "xlsx", "sql", ".com", "thread", "wallet", "email",
]
BAD_WORDS = ["announcement", "news", "update", "avatar", "old", "avatar"]
DESCRIPTION_WORDS = ["hidden", "content", "must", "view", "content"]
NEXT_PAGE_WORDS = ["next", "avanti", "pagenav"]

# Score steps.
BIG, MID, SMALL = 100, 50, 5

# Origin categories.
WEB, CHANNEL, DARK = 0, 1, 2

SEMANTICS = ("reference", "intended")


@dataclass(frozen=True)
class Settings:
    """Query parameters; the defaults are the documented ones."""

    filetypes: tuple[str, ...] = ("csv",)
    max_age: timedelta = timedelta(hours=12)
    link_offset: int = 5
    deadness_raise: int = 1
    good_words: list[str] = field(default_factory=lambda: list(GOOD_WORDS))
    bad_words: list[str] = field(default_factory=lambda: list(BAD_WORDS))
    explore_pages: int = 4
    classifier_rows: int = 1000
    path_parents: int = 3


DEFAULTS = Settings()


def check_semantics(value: str) -> bool:
    """True for the intended behaviour, False for the documented as-written one."""
    if value not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}, got {value!r}")
    return value == "intended"
