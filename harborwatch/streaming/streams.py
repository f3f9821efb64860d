"""Incremental ingestion with Structured Streaming.

Each stream keeps its own Spark check point, writes every micro-batch under a folder named by its
batch number, and overwrites that folder when a batch is retried, so a lost executor or a restart
neither loses nor doubles rows. The anti-join against what is stored drops what came before.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from harborwatch.config import DEFAULTS, Settings
from harborwatch.functions.text import supported_filetype
from harborwatch.operators import extract, records, tables
from harborwatch.operators.origins import advance_checkpoint
from harborwatch.plans.ingest import load_files
from harborwatch.schemas import TABLES
from harborwatch.sources import csv_files, feeds
from harborwatch.streaming import crawl

MESSAGE_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("message_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("text", T.StringType()),
    T.StructField("views", T.IntegerType()),
    T.StructField("forwards", T.IntegerType()),
    T.StructField("file_name", T.StringType()),
])
PAGE_SCHEMA = T.StructType([
    T.StructField("origin_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
LIST_PAGE_SCHEMA = T.StructType([
    T.StructField("origin_id", T.LongType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
LINK_SCHEMA = T.StructType([
    T.StructField("origin_id", T.LongType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("link", T.StringType()),
])
NEXT_SCHEMA = T.StructType([
    T.StructField("origin_id", T.LongType()),
    T.StructField("page_no", T.LongType()),
    T.StructField("next_url", T.StringType()),
])
LAST_URL_SCHEMA = T.StructType([
    T.StructField("origin_id", T.LongType()),
    T.StructField("last_url", T.StringType()),
])
PROGRESS_SCHEMA =T.StructType([
    T.StructField("_id_origin", T.LongType()),
    T.StructField("message_id", T.LongType()),
])
META_SCHEMA = T.StructType([T.StructField("path", T.StringType()), *TABLES["database_metadata"].fields])
FILES_PER_BATCH = 1000
FILE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def prepare(spark: SparkSession, out_dir: str, schemas: dict[str, T.StructType]) -> None:
    """Give every table a first, empty batch, so that reading one always works."""
    for table, schema in schemas.items():
        write_batch(spark.createDataFrame([], schema).coalesce(1), out_dir, table, -1)


def stored(spark: SparkSession, out_dir: str, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """What the stream wrote to a table so far, or in the batches before the given one."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(with_batch).parquet(f"{out_dir}/{table}")
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def write_batch(df: DataFrame, out_dir: str, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{out_dir}/{table}/batch={batch}")


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_messages(
    stream: DataFrame, origin: DataFrame, out_dir: str, checkpoint: str, as_of: Column, settings: Settings = DEFAULTS
) -> StreamingQuery:
    """Messages above their origin's check point with a supported file, stored once by domain and id.

    Writes ``source`` and ``source_telegram``, and to ``progress`` the highest id seen per origin in
    each batch, supported file or not. A run begins where the runs before it have left their check points,
    so an id at or below the highest seen is skipped, stored or not.
    """
    prepare(stream.sparkSession, out_dir, {
        "source": TABLES["source"], "source_telegram": TABLES["source_telegram"], "progress": PROGRESS_SCHEMA,
    })

    def each(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        # The check point as the batches before have moved it: ids above it cannot have been stored.
        reached = advance_checkpoint(origin, stored(spark, out_dir, "progress", PROGRESS_SCHEMA, before=no))
        write_batch(feeds.message_feed(batch, reached), out_dir, "feed", no)
        feed = spark.read.parquet(f"{out_dir}/feed/batch={no}")  # read once, so that all tables agree
        top = feed.groupBy("_id_origin").agg(F.max("message_id").alias("message_id"))
        wanted = feeds.with_supported_file(feed, settings.filetypes).dropDuplicates(["domain", "message_id"])
        source, child = tables.split_messages(wanted, as_of)
        write_batch(child, out_dir, "source_telegram", no)
        write_batch(source, out_dir, "source", no)
        write_batch(top, out_dir, "progress", no)

    return _run(stream, checkpoint, each)


def published_checkpoint(spark: SparkSession, origin: DataFrame, out_dir: str) -> DataFrame:
    """Origins with ``last_checked`` as the message stream has moved it."""
    return advance_checkpoint(origin, stored(spark, out_dir, "progress", PROGRESS_SCHEMA))


def stream_pages(
    stream: DataFrame, paths: DataFrame, out_dir: str, checkpoint: str, as_of: Column, semantics: str = "reference"
) -> StreamingQuery:
    """Captured thread pages to ``source`` and ``source_thread``, one row per address."""
    prepare(stream.sparkSession, out_dir, {"source": TABLES["source"], "source_thread": TABLES["source_thread"]})

    def each(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        known = stored(spark, out_dir, "source_thread", TABLES["source_thread"], before=no)
        found = extract.thread_extract(batch, paths, known, as_of, semantics)
        # Parse once: both tables come from the written rows.
        write_batch(found, out_dir, "extracted", no)
        rows = spark.read.schema(found.schema).parquet(f"{out_dir}/extracted/batch={no}")
        source, thread = extract.split_threads(rows)
        write_batch(thread, out_dir, "source_thread", no)
        write_batch(source, out_dir, "source", no)

    return _run(stream, checkpoint, each)


def stream_list_pages(
    stream: DataFrame, paths: DataFrame, origin: DataFrame, out_dir: str, checkpoint: str, settings: Settings = DEFAULTS,
    idle_ms: int = 3_600_000,
) -> StreamingQuery:
    """Captured list pages to ``links``, ``next_pages`` and ``last_urls``; a link is stored once per origin.

    The pages of a crawl may land in any number of batches, see ``crawl``: each origin's state is kept by the query, so no
    batch reads what was stored before. ``origin`` gives the last url of origins that the stream hasn't met. Rows of
    ``last_urls`` are the origin's new value. A crawl that has had no page for ``idle_ms`` ends with the next batch of any
    origin. The state is kept in RocksDB, which the session is set to while the query starts.
    """
    spark = stream.sparkSession
    prepare(spark, out_dir, {"links": LINK_SCHEMA, "next_pages": NEXT_SCHEMA, "last_urls": LAST_URL_SCHEMA})
    found = crawl.found_on_pages(extract.list_rows(stream, paths), origin, settings.link_offset, idle_ms)

    def each(batch: DataFrame, no: int) -> None:
        write_batch(batch, out_dir, "found", no)  # once, so that all tables agree
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{out_dir}/found/batch={no}")
        link, forward, last = (rows.filter(F.col("kind") == kind) for kind in ("link", "next", "last_url"))
        write_batch(link.select("origin_id", "page_no", "pos", F.col("value").alias("link")), out_dir, "links", no)
        write_batch(forward.select("origin_id", "page_no", F.col("value").alias("next_url")), out_dir, "next_pages", no)
        # Several crawls may begin in one batch; the last one's value holds.
        newest = last.groupBy("origin_id").agg(F.max_by("value", F.col("key").cast("long")).alias("last_url"))
        write_batch(newest, out_dir, "last_urls", no)

    # Timers would call for one more batch without pages after each, without end; they go off with the next pages.
    wanted = {"spark.sql.streaming.stateStore.providerClass": crawl.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return _run(found, checkpoint, each)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _names(files: DataFrame) -> list[str]:
    """The paths of at most FILES_PER_BATCH files; signs that a path pattern would read are escaped."""
    return [re.sub(r"([\\[\]{}*?])", r"\\\1", r.path) for r in files.select("path").collect()]


def stream_files(
    spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, as_of: Column, settings: Settings = DEFAULTS,
    semantics: str = "reference", register: str = "after_load",
) -> StreamingQuery:
    """Every new supported file is fingerprinted, classified, standardised and loaded once.

    Registering after the load lets a failed file be tried again; ``before_load`` is the as-written order.
    """
    if register not in ("after_load", "before_load"):
        raise ValueError("register must be after_load or before_load")
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
        .option("maxFilesPerTrigger", FILES_PER_BATCH).load(in_dir).select("path")
    )
    prepare(spark, out_dir, {"database_metadata": META_SCHEMA, "data": TABLES["data"], "rejected": TABLES["data"]})

    def each(batch: DataFrame, no: int) -> None:
        session = batch.sparkSession
        wanted = _names(batch.filter(supported_filetype(F.col("path"), settings.filetypes)))
        meta = csv_files.file_fingerprint(session, wanted, as_of) if wanted else session.createDataFrame([], META_SCHEMA)
        known = stored(session, out_dir, "database_metadata", META_SCHEMA, before=no)
        write_batch(records.new_files(meta, known), out_dir, "staged_files", no)
        fresh = session.read.schema(META_SCHEMA).parquet(f"{out_dir}/staged_files/batch={no}")
        if register == "before_load":
            write_batch(fresh, out_dir, "database_metadata", no)
        ok, bad, unreadable = load_files(session, fresh, _names(fresh), settings, semantics)
        write_batch(ok, out_dir, "data", no)
        write_batch(bad, out_dir, "rejected", no)
        if register == "after_load":
            write_batch(fresh.join(unreadable.select("path"), "path", "left_anti").select(*fresh.columns), out_dir, "database_metadata", no)

    return _run(files, checkpoint, each)
