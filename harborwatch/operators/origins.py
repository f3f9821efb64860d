"""Origins: look-ups, newest history, freshness, deadness and check points."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.config import DEFAULTS, check_semantics
from harborwatch.plans.skew import pick_top, spread_join
from harborwatch.schemas import PATH_COLUMNS


def _seconds(age: timedelta) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(age.total_seconds()))


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return pick_top(df, keys, order)


def first_n(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    return pick_top(df, by, [F.col(c) for c in order], n)


def latest_history(origin: DataFrame, history: DataFrame, category: int | None = 1, ties: bool = True) -> DataFrame:
    """Origins of a category with their newest history row, or all of them on a tie."""
    chosen = origin if category is None else origin.filter(F.col("category") == category)
    newest = pick_top(history, ["_id_origin"], _newest_first(ties), ties=ties)
    return chosen.join(newest, "_id_origin")


def _newest_first(ties: bool = False) -> list[Column]:
    newest = F.col("updated_time").desc()
    return [newest] if ties else [newest, F.col("_id_origin_history").desc()]


def origin_profile(origin: DataFrame, history: DataFrame, paths: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Per category and domain: the origin, its newest history and its paths; none missing.

    ``keys`` (category, domain) limits the answer to these origins.
    """
    wanted = origin if keys is None else origin.join(keys.select("category", "domain").distinct(), ["category", "domain"], "left_semi")
    joined = latest_history(wanted, history, None, ties=False).join(paths, "_id_origin")
    one = pick_top(joined, ["category", "domain"], [*_newest_first(), F.col("_id_forum_path").desc()])
    return one.select(
        "category", "domain", "_id_origin", "updated_time", "additional_infos", "last_url", *PATH_COLUMNS
    )


def message_status(messages: DataFrame, origin: DataFrame, source: DataFrame, source_telegram: DataFrame) -> DataFrame:
    """``(domain, message_id, n, status)``: new, seen once, or stored several times.

    The probes' origins and message ids cut the stored tables down before these are joined.
    """
    asked = origin.select("_id_origin", "domain").join(messages.select("domain").distinct(), "domain", "left_semi")
    ids = source_telegram.select("_id_source", F.col("_id_source_telegram").alias("message_id")).join(
        messages.select("message_id").distinct(), "message_id", "left_semi"
    )
    stored = (
        spread_join(source.select("_id_source", "_id_origin"), asked, ["_id_origin"], ["_id_source"])
        .select("domain", "_id_source")
        .join(ids, "_id_source")
        .groupBy("domain", "message_id")
        .agg(F.count("*").alias("n"))
    )
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "new").when(n == 1, "seen").otherwise("corrupt")
    return messages.select("domain", "message_id").join(stored, ["domain", "message_id"], "left").select(
        "domain", "message_id", n.alias("n"), status.alias("status")
    )


def author_lookup(author: DataFrame, source: DataFrame, probes: DataFrame) -> DataFrame:
    """The author of an origin and tag if there is exactly one, else null: ``(_id_origin, tag, _id_author)``."""
    tagged = author.select("_id_author", "tag").join(probes.select("tag").distinct(), "tag", "left_semi")
    asked = source.select("_id_source", "_id_origin", "_id_author").join(probes.select("_id_origin").distinct(), "_id_origin", "left_semi")
    known = (
        spread_join(asked, tagged, ["_id_author"], ["_id_source"])
        .groupBy("_id_origin", "tag")
        .agg(F.min("_id_author").alias("lo"), F.max("_id_author").alias("hi"))
    )
    only = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return probes.join(known, ["_id_origin", "tag"], "left").select("_id_origin", "tag", only.alias("_id_author"))


def origin_lookup(origin: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of the probed ``(category, domain)`` pairs."""
    return origin.join(probes.select("category", "domain").distinct(), ["category", "domain"], "left_semi").select(*origin.columns)


def forum_path_lookup(paths: DataFrame, ids: DataFrame) -> DataFrame:
    return paths.join(ids.select("_id_origin").distinct(), "_id_origin", "left_semi").select(*paths.columns)


def stale_origins(latest: DataFrame, as_of: Column, max_age: timedelta = DEFAULTS.max_age) -> DataFrame:
    """Origins whose newest history is older than ``max_age``, strictly."""
    return latest.filter(F.col("updated_time") < as_of - _seconds(max_age))


def refresh_history(
    history: DataFrame, checks: DataFrame, as_of: Column, max_age: timedelta = DEFAULTS.max_age, channel: bool = False
) -> DataFrame:
    """The history after one round of checks ``(_id_origin, additional_infos)``.

    A stale origin with unchanged information has its newest rows moved to ``as_of``; with changed
    information (or any, for channels) a new row is added; a fresh origin is left alone.
    """
    newest = pick_top(history, ["_id_origin"], _newest_first())
    seen = checks.select("_id_origin", F.col("additional_infos").alias("new_infos"))
    stale = stale_origins(newest, as_of, max_age).join(seen, "_id_origin")
    same = F.lit(False) if channel else F.col("new_infos").eqNullSafe(F.col("additional_infos"))
    moved = stale.filter(same).select("_id_origin", "updated_time", F.lit(True).alias("__moved"))
    # One row per origin and time on the right; the pair of keys spreads a hot origin by itself.
    kept = history.join(moved, ["_id_origin", "updated_time"], "left").select(
        "_id_origin_history", "additional_infos",
        F.when(F.col("__moved"), as_of).otherwise(F.col("updated_time")).alias("updated_time"), "_id_origin",
    )
    added = stale.filter(~same).select(
        F.xxhash64("_id_origin", as_of.cast("timestamp")).alias("_id_origin_history"),
        F.col("new_infos").alias("additional_infos"), as_of.alias("updated_time"), "_id_origin",
    )
    return kept.unionByName(added)


def deadness(
    origin: DataFrame, checks: DataFrame, mode: str = "web", semantics: str = "reference", raise_by: int = DEFAULTS.deadness_raise
) -> DataFrame:
    """``(_id_origin, is_dead_score)`` after a log of checks ``(_id_origin, ts, reachable, stale)``.

    Channels: reachable and stale resets to 0, unreachable adds one. Web as written: reachable and
    stale *adds* one, and unreachable changes nothing, since the origin is looked up by host name.
    Web as intended: like channels.
    """
    if mode not in ("web", "channel"):
        raise ValueError(f"mode must be web or channel, got {mode!r}")
    score = F.coalesce("is_dead_score", F.lit(0))
    reset = F.col("reachable") & F.col("stale")
    if mode == "web" and not check_semantics(semantics):
        raised = checks.groupBy("_id_origin").agg(F.sum(F.when(reset, 1).otherwise(0)).alias("up"))
        return origin.join(raised, "_id_origin", "left").select(
            "_id_origin", (score + F.coalesce("up", F.lit(0))).cast("bigint").alias("is_dead_score")
        )
    resets = checks.filter(reset).groupBy("_id_origin").agg(F.max("ts").alias("last_reset"))
    later = spread_join(checks.filter(~F.col("reachable")), resets, ["_id_origin"], ["ts"], "left").filter(
        F.col("last_reset").isNull() | (F.col("ts") > F.col("last_reset"))
    )
    failures = later.groupBy("_id_origin").agg(F.count("*").alias("up"))
    start = F.when(F.col("last_reset").isNull(), score).otherwise(0)
    step = raise_by if mode == "web" else 1
    return (
        origin.select("_id_origin", "is_dead_score")
        .join(resets, "_id_origin", "left")
        .join(failures, "_id_origin", "left")
        .select("_id_origin", (start + F.coalesce("up", F.lit(0)) * step).cast("bigint").alias("is_dead_score"))
    )


def advance_checkpoint(origin: DataFrame, seen: DataFrame) -> DataFrame:
    """Origins with ``last_checked`` moved to the highest id seen; never moved back, supported file or not."""
    top = seen.groupBy("_id_origin").agg(F.max("message_id").alias("__top"))
    return origin.join(top, "_id_origin", "left").select(
        *[
            F.greatest("last_checked", "__top").alias(c) if c == "last_checked" else F.col(c)
            for c in origin.columns
        ]
    )


def advance_last_url(origin: DataFrame, last: DataFrame) -> DataFrame:
    """Origins with the new ``last_url`` (``origin_id, last_url``); unchanged where there is none."""
    new = last.select(F.col("origin_id").alias("_id_origin"), F.col("last_url").alias("__url"))
    return origin.join(new, "_id_origin", "left").select(
        *[F.coalesce("__url", "last_url").alias(c) if c == "last_url" else F.col(c) for c in origin.columns]
    )
