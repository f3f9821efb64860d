"""Joins and picks that stay even under hot keys, and a fence for costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS_CONF = "harborwatch.skew.salts"
_SALT = "__salt"
#: Rows that one task groups or sorts where the tasks are dealt by ``buckets``.
ROWS_PER_TASK = 1 << 19


def salts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(SALTS_CONF, "1"))


def spread_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join of a large side with one that holds at most a few rows per key.

    By default a plain join: adaptive execution splits the partitions of a hot key by their measured size
    and repeats only the few rows of the other side that meet them. Where that is switched off, setting
    ``harborwatch.skew.salts`` above 1 deals the rows of every key over so many buckets by a hash of the
    ``spread`` columns, at the price of repeating the other side as often.
    Valid for joins that keep rows of the left side only (inner, left, left_semi, left_anti).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"spread_join cannot do a {how} join")
    n = salts(fact)
    if n <= 1:
        return fact.join(dim, on, how)
    left = fact.withColumn(_SALT, F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(n)).cast("int"))
    right = dim.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def buckets(rows: int) -> int:
    """Tasks for so many rows. Sizes in bytes don't bound a task's memory: packed keys take a few bits each."""
    return max(1, -(-rows // ROWS_PER_TASK))


def key_counts(df: DataFrame, keys: list[str], tasks: int = 1) -> DataFrame:
    """Rows per key: ``(*keys, n)``.

    With one task's worth of distinct keys, a plain count, summed up inside each input partition. With more,
    ``tasks`` says over how many the rows are dealt before any is counted, so no task holds the keys of a whole
    input partition; the input partition is part of the deal, so a hot key goes to many tasks, and its counts
    are added up by a second one.
    """
    if tasks <= 1:
        return df.groupBy(*keys).agg(F.count("*").alias("n"))
    dealt = df.select(*keys, F.spark_partition_id().alias(_SALT)).repartition(tasks, *keys, _SALT)
    parts = dealt.groupBy(*keys, _SALT).agg(F.count("*").alias("n"))
    return parts.repartition(tasks, *keys).groupBy(*keys).agg(F.sum("n").alias("n"))


def pick_top(df: DataFrame, by: list[str], order: list[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """The first ``n`` rows of every group (all ties of them with ``ties``).

    Spark limits each group inside every input partition before the shuffle (window group limit),
    so a hot group sends ``n`` rows per partition, not all of its rows.
    """
    rank = F.rank() if ties else F.row_number()
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rank", rank.over(w)).filter(F.col("__rank") <= n).drop("__rank")


def fence(df: DataFrame) -> DataFrame:
    """The same rows, behind a generator.

    A filter on a computed column is otherwise pushed below it by repeating its expression, which for
    element scores means scoring every page twice, with shared parts worked out once per element.
    """
    packed = F.explode_outer(F.array(F.struct(*df.columns))).alias("__row")
    return df.select(packed).select("__row.*")
