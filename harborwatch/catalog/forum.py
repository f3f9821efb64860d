"""Forum pages derived from the documents: list pages of 20 threads and one page per thread.

Origin ``doc_id % 20``; even origins list threads in a table, odd ones in blocks. Every seventh
thread has a short title and (in tables) a long member link, so that rows disagree on the link path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.catalog.registry import table

PER_PAGE = 20
ORIGINS = 20

TABLE_PATH = "div.wrap table.threads.wide tbody"
LIST_PATH = "body.b div.wrap div.list"
WRAP_PATH = "html body.b div.wrap"
TABLE_LINK, LIST_LINK = "td.t a.subject", "div.row span.t a.subject"
NEXT_PATH = "div.wrap div.pages a.pagenav.next"
TITLE_PATH, DATE_PATH = "body.b div.post h1.title", "body.b div.post abbr.date"
BODY_PATH, BODY_BLOCK_PATH = "div.post div.body p", "body.b div.post div.body"

THREADS_CTE = f"""threads AS (
    SELECT doc_id, doc_id % {ORIGINS} AS origin_id, doc_id // {ORIGINS} // {PER_PAGE} AS page_no,
           doc_id // {ORIGINS} % {PER_PAGE} AS pos,
           CASE WHEN doc_id % 7 = 0 THEN 'T' || doc_id ELSE 'Thread number ' || doc_id || ' in ' || source END AS title,
           'https://forum' || doc_id % {ORIGINS} || '.example/thread/' || doc_id AS link,
           make_timestamp(2020 + doc_id % 4, 1 + doc_id % 12, 13 + doc_id % 15, doc_id % 24, doc_id % 60, 0.0) AS ts,
           text, regexp_replace(text, '\\s+', ' ', 'g') AS flat
    FROM documents)"""


def _s(c: Column) -> Column:
    return c.cast("string")


def threads(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    index = F.floor(k / ORIGINS)
    origin = _s(k % ORIGINS)
    return table(spark, sf, "documents", "doc_id").select(
        k, (k % ORIGINS).alias("origin_id"), F.floor(index / PER_PAGE).alias("page_no"),
        (index % PER_PAGE).alias("pos"),
        F.when(k % 7 == 0, F.concat(F.lit("T"), _s(k)))
        .otherwise(F.concat(F.lit("Thread number "), _s(k), F.lit(" in "), "source")).alias("title"),
        F.concat(F.lit("https://forum"), origin, F.lit(".example/thread/"), _s(k)).alias("link"),
        "text",
    )


def list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``origin_id, page_no, url, html``; a page gathers its 20 rows at most."""
    k, even = F.col("doc_id"), F.col("origin_id") % 2 == 0
    member = F.when(k % 7 == 0, F.concat(F.lit("member number "), _s(k), F.lit(" here"))).otherwise("member")
    row = F.when(
        even,
        F.concat(
            F.lit('<tr><td class="t"><a class="subject" href="/thread/'), _s(k), F.lit('">'), F.col("title"),
            F.lit('</a><td><a href="/user/'), _s(k), F.lit('">'), member, F.lit("</a></tr>\n"),
        ),
    ).otherwise(
        F.concat(
            F.lit('<div class="row"><span class="t"><a class="subject" href="thread/'), _s(k), F.lit('">'),
            F.col("title"), F.lit("</a></span></div>\n"),
        )
    )
    pages = threads(spark, sf).withColumn("row", row).groupBy("origin_id", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("pos", "row"))).alias("rows")
    )
    rows = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    host = F.concat(F.lit("https://forum"), _s(F.col("origin_id")), F.lit(".example/list?page="))
    pager = F.concat(
        F.lit('<div class="pages"><span>1</span> <span>2</span> <span>4</span><a class="pagenav next" href="'),
        host, _s(F.col("page_no") + 1), F.lit('">Next page</a></div>'),
    )
    body = F.when(even, F.concat(F.lit('<table class="threads  wide">'), rows, F.lit("</table>"))).otherwise(
        F.concat(F.lit('<div class="list">'), rows, F.lit("</div>"))
    )
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><title>List</title></head><body class="b"><nav><a href="/">next home</a></nav>'
              '<div class="wrap">'), body, pager, F.lit('</div><div class="mobile-menu">menu</div></body></html>'),
    )
    return pages.select("origin_id", "page_no", F.concat(host, _s(F.col("page_no"))).alias("url"), html.alias("html"))


def date_text() -> Column:
    """The thread's time in one of three forms; hour 0 is written 12 AM in the first."""
    k = F.col("doc_id")
    y, m, d, h, mi = (_s(c) for c in (2020 + k % 4, 1 + k % 12, 13 + k % 15, k % 24, k % 60))

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    month = F.get(F.array(*[F.lit(x) for x in (
        "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
        "November", "December",
    )]), (k % 12).cast("int"))
    hour12 = _s(F.when(k % 12 == 0, 12).otherwise(k % 12))
    named = F.concat(
        d, F.lit(" "), month, F.lit(", "), y, F.lit(" - "), hour12, F.lit(":"), two(mi),
        F.when(k % 24 >= 12, " PM").otherwise(" AM"),
    )
    iso = F.concat(y, F.lit("-"), two(m), F.lit("-"), two(d), F.lit(" "), two(h), F.lit(":"), two(mi), F.lit(":00"))
    slash = F.concat(d, F.lit("/"), m, F.lit("/"), y, F.lit(" "), h, F.lit(":"), mi)
    return F.when(k % 3 == 0, named).when(k % 3 == 1, iso).otherwise(slash)


# What the text above must read as: 12 AM stays hour 12 as written.
DATE_SQL = "CASE WHEN doc_id % 3 = 0 AND doc_id % 24 = 0 THEN ts + INTERVAL 12 HOUR ELSE ts END"


def thread_pages(spark: SparkSession, sf: str) -> DataFrame:
    """``origin_id, page_no, pos, url, link_title, html``."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit('<html><body class="b"><div class="post"><h1 class="title"> '), "title",
        F.lit('</h1><abbr class="date">'), date_text(), F.lit('</abbr><div class="body"><p>'), text,
        F.lit('</p></div><div class="mobile-bar">bar</div></div></body></html>'),
    )
    return threads(spark, sf).select(
        "origin_id", "page_no", "pos", F.col("link").alias("url"), F.col("title").alias("link_title"), html.alias("html")
    )


def known_paths(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("origin_id") % 2 == 0
    return threads(spark, sf).select("origin_id").distinct().select(
        "origin_id",
        F.when(even, TABLE_PATH).otherwise(LIST_PATH).alias("table_body_path"),
        F.when(even, TABLE_LINK).otherwise(LIST_LINK).alias("thread_link_path"),
        F.lit(NEXT_PATH).alias("next_page_path"), F.lit(TITLE_PATH).alias("thread_title_path"),
        F.lit(BODY_PATH).alias("thread_description_path"), F.lit(DATE_PATH).alias("thread_pubblication_date_path"),
    )
