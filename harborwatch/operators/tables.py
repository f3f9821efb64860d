"""Table maintenance as set operations: what a table looks like after the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.plans.skew import pick_top, spread_join
from harborwatch.schemas import PATH_COLUMNS, TABLES


def upsert_authors(current: DataFrame, new: DataFrame) -> DataFrame:
    """Authors after the batch: known (tag, username) pairs keep their row, rows without tag always add one.

    ``new`` has ``tag, username`` and, for the rows without tag, a ``row_key`` that tells them apart.
    """
    tagged = new.filter(F.col("tag").isNotNull()).select("tag", "username").distinct()
    fresh = tagged.join(current.select("tag", "username"), ["tag", "username"], "left_anti").withColumn(
        "_id_author", F.xxhash64("tag", "username")
    )
    untagged = new.filter(F.col("tag").isNull()).select(
        "tag", "username", F.xxhash64(F.lit("untagged"), "username", "row_key").alias("_id_author")
    )
    added = fresh.unionByName(untagged).withColumn("description", F.lit(None).cast("string"))
    return current.unionByName(added.select(*current.columns))


def add_origins(current: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New ``origin`` rows and their first history rows for unknown (category, domain) pairs.

    ``new``: ``category, domain, additional_infos``; of repeated pairs the least information text stays.
    """
    unknown = new.join(current.select("category", "domain"), ["category", "domain"], "left_anti")
    once = pick_top(unknown, ["category", "domain"], [F.col("additional_infos")])
    keyed = once.withColumn("_id_origin", F.xxhash64("category", "domain"))
    origin = keyed.select(
        "_id_origin", "domain", F.lit(None).cast("string").alias("name"), F.lit(0).alias("is_dead_score"),
        "category", F.lit(None).cast("bigint").alias("last_checked"), F.lit(None).cast("string").alias("last_url"),
    )
    history = keyed.select(
        F.xxhash64("_id_origin", as_of).alias("_id_origin_history"), "additional_infos",
        as_of.alias("updated_time"), "_id_origin",
    )
    return origin, history


def split_messages(messages: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """``source`` and ``source_telegram`` rows of new messages, both keyed by domain and message id."""
    key = F.xxhash64("domain", "message_id")
    source = messages.select(
        key.alias("_id_source"), F.lit(0).alias("spam_score"), F.col("ts").alias("published_time"),
        as_of.alias("crawled_time"), as_of.alias("updated_time"), "_id_origin",
        F.lit(None).cast("bigint").alias("_id_author"),
    )
    child = messages.select(
        F.col("message_id").alias("_id_source_telegram"), F.col("text").alias("message_text"),
        F.col("views").alias("views_count"), F.col("forwards").alias("shares_count"), key.alias("_id_source"),
    )
    return source, child


def upsert_paths(current: DataFrame, new: DataFrame) -> DataFrame:
    """Path rows after exploration: replaced where the origin has one, else added."""
    fields = [*PATH_COLUMNS, "is_auto_generated"]
    renamed = new.select("_id_origin", *[F.col(c).alias(f"__{c}") for c in fields], F.lit(True).alias("__new"))
    joined = current.join(renamed, "_id_origin", "full_outer")
    picked = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in fields}
    key = F.coalesce("_id_forum_path", F.xxhash64(F.lit("path"), "_id_origin")).alias("_id_forum_path")
    return joined.select(*[picked.get(c, key if c == "_id_forum_path" else F.col(c)) for c in current.columns])


def cascade_delete(data: DataFrame, deleted: DataFrame) -> DataFrame:
    """``data`` rows left after deleting metadata rows by hash."""
    return spread_join(data, deleted.select("_og_hashmd5").distinct(), ["_og_hashmd5"], ["_id_data"], "left_anti")


def refused_deletes(parent_keys: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """Keys that may not be deleted since a child row still points at them, with the number of rows."""
    return child.groupBy(key).agg(F.count("*").alias("n")).join(parent_keys.select(key).distinct(), key, "left_semi")


def reset_tables(spark: SparkSession, paths: dict[str, str]) -> None:
    """Overwrite every named table with no rows; the order does not matter."""
    for name, path in paths.items():
        spark.createDataFrame([], TABLES[name]).write.mode("overwrite").parquet(path)
