"""Wrapper extraction: known paths applied to list pages and thread pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.config import DEFAULTS
from harborwatch.functions.dates import first_date
from harborwatch.functions.text import js_trim, truncate_description
from harborwatch.functions.urls import resolve_url
from harborwatch.operators import dom
from harborwatch.operators.infer import list_frame
from harborwatch.plans.skew import fence, pick_top, spread_join
from harborwatch.session import staged


def _nodes() -> Column:
    return F.col("nodes")


def _texts() -> Column:
    return F.col("texts")


def links_until_seen(links: DataFrame, origin: DataFrame) -> DataFrame:
    """Links in page order up to, not including, the one seen last time.

    ``links``: ``origin_id, page_no, pos, link``; ``origin``: ``origin_id, last_url``. The place of
    the first hit is a small aggregate per origin, so no origin is sorted in one task. ``links`` is
    read twice: hand in a written table, not a plan that parses pages.
    """
    known = origin.filter(F.col("last_url").isNotNull()).select("origin_id", F.col("last_url").alias("link"))
    hits = links.join(known.distinct(), ["origin_id", "link"], "left_semi")
    first_hit = hits.groupBy("origin_id").agg(F.min(F.struct("page_no", "pos")).alias("__hit"))
    joined = spread_join(links, first_hit, ["origin_id"], ["page_no", "pos"], "left")
    before = F.col("__hit").isNull() | (F.struct("page_no", "pos") < F.col("__hit"))
    return joined.filter(before).drop("__hit")


def next_last_url(links: DataFrame, offset: int = DEFAULTS.link_offset) -> DataFrame:
    """The link at the offset of each origin's first page; origins with fewer links give no row."""
    at = (F.col("page_no") == 0) & (F.col("pos") == offset)
    return links.filter(at).select("origin_id", F.col("link").alias("last_url"))


def next_page_url() -> Column:
    """The resolved next-page address of a ``list_frame`` row with ``__next_steps``; null without one."""
    href = dom.selected_attr(_nodes(), F.col("__next_steps"), "href")
    return dom.let(href, lambda h: F.when(h != "", resolve_url(h, F.col("url"))))


def next_page_urls(frame: DataFrame) -> DataFrame:
    steps = frame.withColumn("__next_steps", dom.selector_steps(F.col("next_page_path")))
    found = steps.select("origin_id", "page_no", next_page_url().alias("next_url"))
    return fence(found).filter(F.col("next_url").isNotNull())


def list_rows(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(origin_id, page_no, url, links, next_url) of captured list pages, a stream or a table."""
    frame = list_frame(pages, paths, ["origin_id"])
    link_steps = dom.selector_steps(F.concat_ws(" ", "table_body_path", F.coalesce("thread_link_path", F.lit(""))))
    marked = frame.withColumn("__steps", link_steps).withColumn(
        "__next_steps", dom.selector_steps(F.col("next_page_path"))
    )

    def address(n: Column) -> Column:
        return resolve_url(F.try_element_at(n["attrs"], F.lit("href")), F.col("url"))

    found = F.transform(dom.select_nodes(_nodes(), F.col("__steps")), address)
    return marked.select("origin_id", "page_no", "url", found.alias("links"), next_page_url().alias("next_url"))


def thread_list_scrape(
    pages: DataFrame, paths: DataFrame, origin: DataFrame, offset: int = DEFAULTS.link_offset
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New thread links, next-page addresses and new ``last_url`` values of captured list pages.

    The pages are parsed once; their links, a small part of them, are written to the shared folder
    and read for the three answers.
    """
    rows = staged(list_rows(pages, paths).drop("url"), "list-links")
    links = rows.select("origin_id", "page_no", F.posexplode("links").alias("pos", "link"))
    forward = rows.filter(F.col("next_url").isNotNull()).select("origin_id", "page_no", "next_url")
    return links_until_seen(links, origin), forward, next_last_url(links, offset)


def read_threads(pages: DataFrame, paths: DataFrame, semantics: str = "reference") -> DataFrame:
    """Title, description and first readable date of every captured thread page.

    ``semantics`` decides what 12 AM in a date of the named custom form is: hour 12 as written, 0 as intended.
    """
    names = ["thread_title_path", "thread_description_path", "thread_pubblication_date_path"]
    with_paths = spread_join(pages, paths.select("origin_id", *names), ["origin_id"], ["url"])
    joined = dom.page_frame(with_paths, ["origin_id", "url", *names])
    for short, name in zip(("t", "d", "p"), names):
        joined = joined.withColumn(f"__{short}", dom.selector_steps(F.col(name)))
    rows = joined.select(
        "origin_id", "url",
        js_trim(dom.selected_text(_nodes(), _texts(), F.col("__t"))).alias("title"),
        js_trim(dom.selected_text(_nodes(), _texts(), F.col("__d"))).alias("description"),
        dom.selected_own_texts(_nodes(), _texts(), F.col("__p")).alias("__dates"),
    )
    return fence(rows.withColumn("published_time", first_date(F.col("__dates"), semantics)).drop("__dates"))


def non_empty_threads(threads: DataFrame) -> DataFrame:
    return threads.filter((F.col("title") != "") & (F.col("description") != ""))


def unseen_threads(threads: DataFrame, source_thread: DataFrame) -> DataFrame:
    return threads.join(source_thread.select("url"), "url", "left_anti").select(*threads.columns)


def thread_extract(
    pages: DataFrame, paths: DataFrame, source_thread: DataFrame, as_of: Column, semantics: str = "reference"
) -> DataFrame:
    """Thread rows that are complete, not stored yet, and one per address.

    Pages are parsed where they are read and only the extracted rows are shuffled, by address, once
    for the comparison with the stored addresses and the pick.
    """
    found = unseen_threads(non_empty_threads(read_threads(pages, paths, semantics)), source_thread)
    once = pick_top(found, ["url"], [F.col("origin_id"), F.xxhash64("title", "description")])
    return once.withColumn("crawled_time", as_of).withColumn("updated_time", as_of)


def split_threads(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ``source`` and ``source_thread`` rows of extracted threads; keys follow from the address."""
    key = F.xxhash64("url")
    null_long, null_int = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    source = extracted.select(
        key.alias("_id_source"), F.lit(0).alias("spam_score"), "published_time", "crawled_time",
        "updated_time", F.col("origin_id").alias("_id_origin"), null_long.alias("_id_author"),
    )
    thread = extracted.select(
        key.alias("_id_source_thread"), "url", "title",
        truncate_description(F.col("description")).alias("description"),
        null_int.alias("replies_count"), null_int.alias("views_count"), key.alias("_id_source"),
    )
    return source, thread
