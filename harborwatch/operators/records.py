"""Record standardisation: which column is which, and the canonical ``data`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.config import DEFAULTS, check_semantics
from harborwatch.functions.text import CELL_TESTS, cell_test
from harborwatch.plans.skew import pick_top, spread_join
from harborwatch.schemas import LENGTH_RULES, STANDARD_FIELDS


def field_match_counts(
    cells: DataFrame, key: str = "file_hash", lines: int = DEFAULTS.classifier_rows, semantics: str = "reference"
) -> DataFrame:
    """Matches per file, test and field over the first ``lines`` rows: ``(key, test, pos, field, n)``.

    The fields are those of row 0. Each file gives at most ``lines`` rows here, whatever its size.
    """
    sample = cells.filter(F.col("row_no") < lines)
    fields = sample.filter(F.col("row_no") == 0).select(key, F.map_keys("cells").alias("fields"))
    wide = sample.join(fields, key).select(key, "cells", F.posexplode("fields").alias("pos", "field"))
    cell = F.try_element_at("cells", F.col("field"))
    counts = wide.groupBy(key, "pos", "field").agg(
        *[F.sum(cell_test(t, cell, semantics).cast("int")).alias(t) for t in CELL_TESTS]
    )
    return counts.unpivot([key, "pos", "field"], list(CELL_TESTS), "test", "n").select(key, "test", "pos", "field", "n")


def classify_fields(
    cells: DataFrame, key: str = "file_hash", lines: int = DEFAULTS.classifier_rows, semantics: str = "reference"
) -> DataFrame:
    """One row per file and test: the field of the only highest count, or why there is none."""
    counts = field_match_counts(cells, key, lines, semantics)
    top = counts.groupBy(key, "test", "n").agg(F.count("*").alias("ties"), F.min("field").alias("field"))
    best = top.groupBy(key, "test").agg(F.max(F.struct("n", "ties", "field")).alias("b"))
    status = F.when(F.col("b.n") == 0, "none").when(F.col("b.ties") > 1, "undecided").otherwise("matched")
    return best.select(
        key, "test", status.alias("status"),
        F.when((F.col("b.n") > 0) & (F.col("b.ties") == 1), F.col("b.field")).alias("field"),
        F.col("b.n").alias("n"),
    )


def fixes_of(decisions: DataFrame, key: str = "file_hash") -> DataFrame:
    """One row per file: the source field of every standard field, null where undecided or none."""
    return decisions.groupBy(key).agg(
        *[F.max(F.when(F.col("test") == f, F.col("field"))).alias(f"fix_{f}") for f in STANDARD_FIELDS]
    )


def apply_fixes(cells: DataFrame, fixes: DataFrame, key: str = "file_hash") -> DataFrame:
    """Rows with their file's fixes; one file may hold most rows, so its rows are spread."""
    return spread_join(cells, fixes, [key], ["row_no"])


def misc_json(cells: Column, claimed: Column) -> Column:
    """The cells no standard field took, as JSON in source order."""
    return F.to_json(F.map_filter(cells, lambda k, v: ~F.array_contains(claimed, k)))


def standardize_records(cells: DataFrame, fixes: DataFrame, key: str = "file_hash") -> DataFrame:
    """Canonical rows: four standard fields, the rest as JSON, and the file's hash."""
    names = [f"fix_{f}" for f in STANDARD_FIELDS]
    claimed = F.array_compact(F.array(*names))
    return apply_fixes(cells, fixes, key).select(
        key, "row_no",
        *[F.try_element_at("cells", F.col(n)).alias(f) for n, f in zip(names, STANDARD_FIELDS)],
        misc_json(F.col("cells"), claimed).alias("misc"),
    )


def new_files(meta: DataFrame, registered: DataFrame) -> DataFrame:
    """Files whose content is neither registered nor given twice; the first path stays."""
    fresh = meta.join(registered.select("_og_hashmd5"), "_og_hashmd5", "left_anti")
    return pick_top(fresh, ["_og_hashmd5"], [F.col("path")]).select(*meta.columns)


def over_long(df: DataFrame, table: str) -> Column:
    """Does any value of the row break a length or not-null rule of its table?"""
    bad = F.lit(False)
    for name, column, limit, required in LENGTH_RULES:
        if name == table and column in df.columns:
            c = F.col(column)
            if limit is not None:
                bad = bad | F.coalesce(F.length(c) > limit, F.lit(False))
            if required:
                bad = bad | c.isNull()
    return bad


def quarantine(records: DataFrame, key: str = "_og_hashmd5", semantics: str = "reference") -> tuple[DataFrame, DataFrame]:
    """``(ok, bad)`` rows. As written, one bad value fails its whole file; intended: only its row."""
    marked = records.withColumn("__bad", over_long(records, "data"))
    if check_semantics(semantics):
        return marked.filter(~F.col("__bad")).drop("__bad"), marked.filter("__bad").drop("__bad")
    failed = marked.groupBy(key).agg(F.max("__bad").alias("__fails")).filter("__fails").select(key)
    return (
        spread_join(records, failed, [key], ["row_no"], "left_anti"),
        spread_join(records, failed, [key], ["row_no"], "left_semi"),
    )


def data_rows(records: DataFrame, key: str = "_og_hashmd5") -> DataFrame:
    """``data`` rows; the key follows from file and row number, so loading twice gives the same keys."""
    return records.select(F.xxhash64(key, "row_no").alias("_id_data"), *STANDARD_FIELDS, "misc", F.col(key).alias("_og_hashmd5"))


def append_records(records: DataFrame, path: str, load: str) -> None:
    """Add ``data`` rows as Parquet in a folder of the named load, below it by the first two digits of the file hash.

    A load that is run again replaces its own rows, so none is stored twice.
    """
    records.withColumn("hash_prefix", F.left("_og_hashmd5", F.lit(2))).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("hash_prefix").parquet(f"{path}/load={load}")
