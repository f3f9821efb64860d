"""Replay a log of checks: which of them were due, and what they did to the history.

A check is due if it is later than the last due one by more than ``max_age``. That is a walk from check to check, but
the step from each check (to the first one that is late enough) doesn't depend on where the walk came from, so all steps are
found at once and doubled: after k rounds each step spans 2**k due checks. A step ends in the next span of ``max_age`` or
at the first check of a later one, so it is found inside one origin's span, and a hot origin's log is many groups.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborwatch.config import DEFAULTS
from harborwatch.plans.skew import pick_top
from harborwatch.session import staged


def next_due(checks: DataFrame, age: int) -> DataFrame:
    """(_id_origin, us, next): the first check later than each by more than ``age`` microseconds; none where there is none.

    ``checks`` are distinct pairs (_id_origin, us).
    """
    nodes = checks.select("_id_origin", "us", F.expr(f"us div {age} - int(us % {age} < 0)").alias("span"))
    # The first check of the spans after the next one, by span: one row for a span that isn't empty.
    in_order = Window.partitionBy("_id_origin").orderBy("span")
    spans = nodes.groupBy("_id_origin", "span").agg(F.min("us").alias("first"))
    lead = [F.lead(F.struct("span", "first"), k).over(in_order) for k in (1, 2)]
    spans = spans.select("_id_origin", "span", lead[0].alias("one"), lead[1].alias("two"))
    later = F.when(F.col("one.span") > F.col("span") + 1, F.col("one.first")).otherwise(F.col("two.first"))
    spans = spans.select("_id_origin", "span", later.alias("later"))
    # Inside the next span: checks and the earliest times that the steps ask for, side by side from late to early.
    no = F.lit(None).cast("long")
    asked = nodes.select("_id_origin", (F.col("span") + 1).alias("key"), (F.col("us") + age).alias("at"), no.alias("check"), "us", "span")
    there = nodes.select("_id_origin", F.col("span").alias("key"), F.col("us").alias("at"), F.col("us").alias("check"), no.alias("us"), no.alias("span"))
    late_first = Window.partitionBy("_id_origin", "key").orderBy(F.desc("at"), F.col("check").isNotNull())
    found = asked.unionByName(there).withColumn("near", F.last("check", ignorenulls=True).over(late_first))
    steps = found.filter("check is null").join(spans, ["_id_origin", "span"])
    return steps.select("_id_origin", "us", F.coalesce("near", "later").alias("next")).filter("next is not null")


def due_checks(first: DataFrame, steps: DataFrame) -> DataFrame:
    """(_id_origin, us) that a walk along ``steps`` meets from ``first`` on. Every round is a table in the shared folder."""
    reached, steps = staged(first, "due"), staged(steps, "steps")
    while True:
        new = staged(reached.join(steps, ["_id_origin", "us"]).select("_id_origin", F.col("next").alias("us")), "due-new")
        if new.isEmpty():
            return reached
        reached = staged(reached.unionByName(new), "due")
        on = steps.select("_id_origin", F.col("us").alias("next"), F.col("next").alias("after"))
        steps = staged(steps.join(on, ["_id_origin", "next"]).select("_id_origin", "us", F.col("after").alias("next")), "steps")


def _micros(age: timedelta) -> int:
    return age // timedelta(microseconds=1)


def replay_checks(history: DataFrame, log: DataFrame, max_age: timedelta = DEFAULTS.max_age, channel: bool = False) -> DataFrame:
    """The history after all checks ``(_id_origin, ts, additional_infos)`` of a log, as if applied one after the other.

    A due check with unchanged information moves the origin's newest rows to its time; with changed information (or any, for
    channels) it adds a row; a check that isn't due does nothing. Of checks of one origin at one time the one with the least
    information counts, null before others. Origins without history, and checks without a time, are left out.
    """
    newest = pick_top(history, ["_id_origin"], [F.col("updated_time").desc(), F.col("_id_origin_history").desc()])
    newest = newest.select("_id_origin", F.unix_micros("updated_time").alias("t0"), F.struct("additional_infos").alias("old"))
    age = _micros(max_age)
    infos = F.min(F.struct(F.col("additional_infos").isNotNull(), "additional_infos"))["additional_infos"]
    known = log.filter("ts is not null").select("_id_origin", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "additional_infos")
    once = known.groupBy("_id_origin", "us").agg(infos.alias("infos"))
    once = staged(once.join(newest, "_id_origin").filter(F.col("us") > F.col("t0") + age), "checks")
    due = due_checks(once.groupBy("_id_origin").agg(F.min("us").alias("us")), next_due(once.select("_id_origin", "us"), age))
    # Due checks are more than ``max_age`` apart, so an origin has few; runs of equal information are one row.
    order = Window.partitionBy("_id_origin").orderBy("us")
    before = F.coalesce(F.lag(F.struct(F.col("infos").alias("additional_infos"))).over(order), F.col("old"))["additional_infos"]
    changed: Column = F.lit(True) if channel else ~F.col("infos").eqNullSafe(before)
    runs = once.join(due, ["_id_origin", "us"]).withColumn("changed", changed.cast("int"))
    runs = runs.withColumn("run", F.sum("changed").over(order)).groupBy("_id_origin", "t0", "run").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.first("infos").alias("infos")
    )
    runs = staged(runs, "runs")
    moved = runs.filter("run = 0").select("_id_origin", F.timestamp_micros("t0").alias("updated_time"), F.timestamp_micros("last").alias("__to"))
    kept = history.join(moved, ["_id_origin", "updated_time"], "left").select(
        "_id_origin_history", "additional_infos", F.coalesce("__to", "updated_time").alias("updated_time"), "_id_origin"
    )
    added = runs.filter("run > 0").select(
        F.xxhash64("_id_origin", F.timestamp_micros("first")).alias("_id_origin_history"), F.col("infos").alias("additional_infos"),
        F.timestamp_micros("last").alias("updated_time"), "_id_origin",
    )
    return kept.unionByName(added)
