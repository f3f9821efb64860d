"""Captured messages, pages and origin lists as scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborwatch.functions.text import supported_filetype
from harborwatch.plans.skew import spread_join


def message_feed(messages: DataFrame, origin: DataFrame) -> DataFrame:
    """Messages of known channels with an id above the origin's ``last_checked`` (none yet: 0).

    ``messages``: ``domain, message_id, ...``. Order by id within a domain is the consumer's business;
    nothing here needs it.
    """
    known = origin.select("domain", "_id_origin", F.coalesce("last_checked", F.lit(0)).alias("__last"))
    return (
        spread_join(messages, known, ["domain"], ["message_id"])
        .filter(F.col("message_id") > F.col("__last"))
        .drop("__last")
    )


def with_supported_file(messages: DataFrame, filetypes: tuple[str, ...] | list[str]) -> DataFrame:
    return messages.filter(supported_filetype(F.col("file_name"), filetypes))


def pages_of(pages: DataFrame, label: str) -> DataFrame:
    """Captured pages of one kind: EXPLORE, EXPLORE_THREAD, THREAD_LIST or THREAD."""
    return pages.filter(F.col("label") == label)


def origins_by_category(origin: DataFrame, category: int | Column) -> DataFrame:
    """Start list of a category."""
    return origin.filter(F.col("category") == category).select(
        F.col("domain").alias("url"), F.lit("THREAD_LIST").alias("label")
    )


# The channel attributes kept, with where they stand in the raw information.
_CHANNEL_FULL = {
    "about": T.StringType(), "read_inbox_max_id": T.LongType(), "pts": T.LongType(),
    "hidden_prehistory": T.BooleanType(), "participants_count": T.LongType(), "admins_count": T.LongType(),
}
_CHANNEL_SCHEMA = T.StructType([
    T.StructField("full_chat", T.StructType([
        T.StructField("id", T.LongType()), *[T.StructField(n, t) for n, t in _CHANNEL_FULL.items()],
    ])),
    T.StructField("chats", T.ArrayType(T.StructType([
        T.StructField("date", T.StringType()), T.StructField("access_hash", T.LongType()),
    ]))),
])


def parse_channel_info(raw: Column) -> Column:
    """Nine attributes of a channel's raw JSON as a struct; null when the chat or its full form is missing."""
    info = F.from_json(raw, _CHANNEL_SCHEMA)
    chat = F.get(info["chats"], F.lit(0))
    picked = F.struct(
        info["full_chat"]["id"].alias("channel_id"),
        *[info["full_chat"][n].alias(n) for n in _CHANNEL_FULL],
        chat["date"].alias("date"),
        chat["access_hash"].alias("access_hash"),
    )
    return F.when(info["full_chat"].isNotNull() & chat.isNotNull(), picked)
