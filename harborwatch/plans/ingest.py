"""From CSV files to standard ``data`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.config import DEFAULTS, Settings
from harborwatch.operators import records
from harborwatch.plans.skew import spread_join
from harborwatch.schemas import TABLES
from harborwatch.session import staged
from harborwatch.sources import csv_files


def load_files(
    spark: SparkSession, meta: DataFrame, files: str | list[str], settings: Settings = DEFAULTS,
    semantics: str = "reference",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Standard ``(ok, bad)`` data rows of the files in ``meta`` (``path, _og_hashmd5``), and the metadata rows of the
    files that cannot be read, each with a row in ``bad`` that names its path.

    ``files`` is the folder, glob or short list that is scanned; files of it that ``meta`` lacks give
    nothing. Cells and standard rows are each worked out once and written to the shared folder, since
    the classifier and the length check read them before the load does.
    """
    if not files:
        empty = spark.createDataFrame([], TABLES["data"])
        return empty, empty, meta.limit(0)
    rows, broken = csv_files.read_records(spark, files)
    plain, bare = csv_files.plain_path(F.col("file")), csv_files.no_scheme(F.col("path"))
    rows = rows.withColumn("file", plain)
    unreadable = meta.join(broken.select(plain.alias("__file")), bare == F.col("__file"), "left_semi")
    by_path = meta.select(bare.alias("file"), "_og_hashmd5")
    cells = staged(
        spread_join(rows, by_path, ["file"], ["row_no"]).select("_og_hashmd5", "row_no", "cells"), "cells"
    )
    decisions = records.classify_fields(cells, "_og_hashmd5", settings.classifier_rows, semantics)
    fixes = records.fixes_of(decisions, "_og_hashmd5")
    standard = staged(records.standardize_records(cells, fixes, "_og_hashmd5"), "records")
    ok, bad = records.quarantine(standard, semantics=semantics)
    named = unreadable.select(
        "_og_hashmd5", F.lit(-1).cast("bigint").alias("row_no"), F.to_json(F.struct(F.col("path").alias("unreadable"))).alias("misc")
    )
    return records.data_rows(ok), records.data_rows(bad.unionByName(named, allowMissingColumns=True)), unreadable


def ingest_directory(
    spark: SparkSession, path: str, registered: DataFrame, as_of: Column, source_id: Column | None = None,
    settings: Settings = DEFAULTS, semantics: str = "reference",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New metadata rows, ``data`` rows and rejected rows of a folder or glob, all files in one job.

    A file that cannot be read is rejected by its path and isn't registered, so it is tried again.
    """
    found = csv_files.file_fingerprint(spark, path, as_of, source_id)
    fresh = staged(records.new_files(found, registered), "files")
    ok, bad, unreadable = load_files(spark, fresh, path, settings, semantics)
    return fresh.join(unreadable.select("path"), "path", "left_anti").select(*fresh.columns), ok, bad
