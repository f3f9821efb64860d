"""Queries on pages: tokens, elements, scores, inferred paths and extracted threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.catalog import forum
from harborwatch.catalog.derived import as_of
from harborwatch.catalog.registry import register, table
from harborwatch.config import BAD_WORDS, DEFAULTS, DESCRIPTION_WORDS, GOOD_WORDS
from harborwatch.functions import dates, urls
from harborwatch.functions import text as tx
from harborwatch.operators import dom, extract, infer
from harborwatch.schemas import TABLES
from harborwatch.session import scratch_path, staged
from harborwatch.streaming import streams

THREADS = forum.THREADS_CTE


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# ---- text and date expressions -------------------------------------------------------------

@register("resolve_url", r"""
    WITH links AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    cut AS (SELECT page_id, href, regexp_extract(url, '^[a-z]+://[^/?#]+') AS root, regexp_extract(url, '^([^?#]*/)', 1) AS folder FROM links)
    SELECT page_id, href, regexp_replace(
        CASE WHEN href LIKE '/%' THEN root ELSE folder END
        || replace(replace(url_encode(replace(replace(href, '&quot;', '"'), '&amp;', '&')), '%2F', '/'), '%2C', ','), '^$', '') AS link
    FROM cut""")
def resolve_url(spark: SparkSession, sf: str) -> DataFrame:
    frame = dom.page_frame(table(spark, sf, "pages", "page_id"), ["page_id", "url"], clean=False)
    links = dom.select_by_path(frame, ["page_id", "url"], F.lit("nav a"))
    href = F.col("attrs")["href"]
    # The SQL side sees the raw attribute.
    raw = F.replace(F.replace(href, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return links.select("page_id", raw.alias("href"), urls.resolve_url(href, F.col("url")).alias("link"))


_DATE_ROWS = f"WITH {THREADS}"


@register("parse_custom_date", f"""{_DATE_ROWS}
    SELECT doc_id, CAST(CASE WHEN doc_id % 3 <> 1 THEN epoch({forum.DATE_SQL}) END AS BIGINT) AS seconds FROM threads""")
def parse_custom_date(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("posted "), forum.date_text(), F.lit(" by"))
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.unix_seconds(dates.custom_date(text)).alias("seconds"))


@register("parse_custom_date_rollover", """
    SELECT o_orderkey, CAST(epoch(make_timestamp(CAST(year(o_orderdate) AS BIGINT), 1, 1, 0, 0, 0.0)
        + to_months(CAST(o_orderkey % 20 - 1 AS INTEGER)) + to_days(CAST(o_custkey % 60 - 1 AS INTEGER))
        + to_hours(o_orderkey % 99) + to_minutes(o_custkey % 99)) AS BIGINT) AS seconds FROM orders""")
def parse_custom_date_rollover(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    parts = [(c % 60).cast("string"), (o % 20).cast("string"), F.year("o_orderdate").cast("string")]
    text = F.concat(F.concat_ws("/", *parts), F.lit(" "), (o % 99).cast("string"), F.lit(":"), (c % 99).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(dates.custom_date(text)).alias("seconds"))


@register("first_date", f"""{_DATE_ROWS}
    SELECT doc_id, CAST(epoch({forum.DATE_SQL}) AS BIGINT) AS seconds FROM threads""")
def first_date(spark: SparkSession, sf: str) -> DataFrame:
    pieces = F.array(F.lit(""), F.col("text"), forum.date_text(), F.lit("1 January 2001"))
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.unix_seconds(dates.first_date(pieces)).alias("seconds"))


@register("native_date", """
    SELECT o_orderkey, CAST(epoch(o_orderdate) + CASE WHEN o_orderkey % 4 = 2 THEN 0 ELSE 3600 * (o_orderkey % 24) + 60 * (o_orderkey % 60) END
        AS BIGINT) AS seconds FROM orders""")
def native_date(spark: SparkSession, sf: str) -> DataFrame:
    o, day = F.col("o_orderkey"), F.col("o_orderdate")
    clock = F.concat(F.lpad((o % 24).cast("string"), 2, "0"), F.lit(":"), F.lpad((o % 60).cast("string"), 2, "0"))
    text = (
        F.when(o % 4 == 0, F.concat(F.date_format(day, "yyyy-MM-dd'T'"), clock, F.lit(":00Z")))
        .when(o % 4 == 1, F.concat(F.date_format(day, "M/d/yyyy "), clock))
        .when(o % 4 == 2, F.date_format(day, "MMMM d, yyyy"))
        .otherwise(F.concat(F.date_format(day, "EEE, dd MMM yyyy "), clock, F.lit(":00 +0000")))
    )
    return table(spark, sf, "orders").select("o_orderkey", F.unix_seconds(dates.native_date(text)).alias("seconds"))


_DIGITS_SQL = "length(regexp_replace(t, '[^0-9]', '', 'g'))"


@register("date_score", f"""{_DATE_ROWS}, t AS (
        SELECT doc_id, 1 AS kind, flat AS t, FALSE AS past FROM threads
        UNION ALL SELECT doc_id, 2, strftime(ts, '%Y-%m-%d'), TRUE FROM threads
        UNION ALL SELECT doc_id, 3, strftime(ts + INTERVAL 30 YEAR, '%Y-%m-%d %H:%M'), FALSE FROM threads)
    SELECT doc_id, kind, CASE WHEN length(t) < 15 THEN -50 ELSE 50 END + CASE WHEN past THEN 50 ELSE -100 END
        + CASE WHEN {_DIGITS_SQL} > length(t) - {_DIGITS_SQL} THEN 50 ELSE -50 END AS score FROM t""")
def date_score(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    day = [F.lpad(c.cast("string"), 2, "0") for c in (1 + k % 12, 13 + k % 15, k % 24, k % 60)]

    def ymd(year: Column) -> Column:
        return F.concat_ws("-", year.cast("string"), day[0], day[1])

    late = F.concat(ymd(2050 + k % 4), F.lit(" "), day[2], F.lit(":"), day[3])
    texts = F.array(tx.squash_spaces(F.col("text")), ymd(2020 + k % 4), late)
    rows = table(spark, sf, "documents", "doc_id").select("doc_id", F.posexplode(texts).alias("pos", "t"))
    return rows.select("doc_id", (F.col("pos") + 1).alias("kind"), dates.date_score(F.col("t"), as_of()).alias("score"))


@register("ordered_numbers", """
    SELECT event_id, len(list_filter(regexp_extract_all(t, '0?1?2?3?4?5?6?7?8?9?'), lambda x: length(x) BETWEEN 2 AND 8)) > 0 AS found
    FROM (SELECT event_id, user_id || ' ' || CAST(event_id * 7919 AS VARCHAR) || event_type || user_id AS t FROM events)""")
def ordered_numbers(spark: SparkSession, sf: str) -> DataFrame:
    u, e = F.col("user_id").cast("string"), (F.col("event_id") * 7919).cast("string")
    return table(spark, sf, "events").select(
        "event_id", tx.ordered_numbers(F.concat(u, F.lit(" "), e, "event_type", u)).alias("found")
    )


def _count_sql(text: str, word: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {word}, ''))) // length({word}) AS BIGINT)"


def _words_sql(words: str, text: str, points: int, cap: int | None = None) -> str:
    hits = _count_sql(text, "w")
    hits = f"least({hits}, {cap})" if cap else hits
    return f"coalesce(list_sum(list_transform(list_filter({words}, lambda w: w <> ''), lambda w: {hits} * {points})), 0)"


_TITLE = "string_split(source || '  ' || lang || ' en tion', ' ')"


def _title() -> Column:
    return F.concat(F.lit(" "), "source", F.lit("  "), "lang", F.lit(" en tion "))



@register("keyword_score", f"""
    SELECT doc_id, CAST({_words_sql(_sql_list(GOOD_WORDS + ['en', 'tion']), 'lower(text)', 5)}
        + {_words_sql(_sql_list(BAD_WORDS), 'lower(text)', -5)} AS BIGINT) AS intended, 0::BIGINT AS written,
        CASE WHEN doc_id % 2 = 0 THEN 10 ELSE 0 END::BIGINT AS written_empty FROM documents""")
def keyword_score(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    empty = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("x"), text))
    full = tx.keyword_score(text, GOOD_WORDS + ["en", "tion"], BAD_WORDS, semantics="intended")
    return table(spark, sf, "documents", "doc_id").select(
        "doc_id", full.cast("bigint").alias("intended"),
        tx.keyword_score(F.concat(F.lit("x"), text), GOOD_WORDS, BAD_WORDS).cast("bigint").alias("written"),
        tx.keyword_score(empty, ["", "", "view"], BAD_WORDS).cast("bigint").alias("written_empty"),
    )


@register("title_score", f"""
    SELECT doc_id, 0::BIGINT AS written, CAST({_words_sql(_sql_list(GOOD_WORDS), 'lower(text)', 5, 1)}
        + {_words_sql(_TITLE, 'lower(text)', 5, 1)} + {_words_sql(_sql_list(BAD_WORDS), 'lower(text)', -5)} AS BIGINT) AS intended
    FROM documents""")
def title_score(spark: SparkSession, sf: str) -> DataFrame:
    title = _title()
    scores = {
        name: tx.title_score(F.col("text"), title, GOOD_WORDS, BAD_WORDS, 1, semantics).cast("bigint").alias(name)
        for name, semantics in (("written", "reference"), ("intended", "intended"))
    }
    return table(spark, sf, "documents", "doc_id").select("doc_id", scores["written"], scores["intended"])


_LONG_SQL = "CASE WHEN length(text) > 300 THEN 100 ELSE -100 END"


@register("description_score", f"""
    SELECT doc_id, CAST({_LONG_SQL} AS BIGINT) AS written,
        CAST({_LONG_SQL} + {_words_sql(_sql_list(GOOD_WORDS + DESCRIPTION_WORDS), 'lower(text)', 5)}
        + {_words_sql(_TITLE, 'lower(text)', 5)} + {_words_sql(_sql_list(BAD_WORDS), 'lower(text)', -5)} AS BIGINT) AS intended
    FROM documents""")
def description_score(spark: SparkSession, sf: str) -> DataFrame:
    title = _title()
    scores = {
        name: tx.description_score(F.col("text"), title, GOOD_WORDS, BAD_WORDS, semantics).cast("bigint").alias(name)
        for name, semantics in (("written", "reference"), ("intended", "intended"))
    }
    return table(spark, sf, "documents", "doc_id").select("doc_id", scores["written"], scores["intended"])


# ---- tokens and elements -------------------------------------------------------------------

_RE2_TOKEN = dom.TOKEN_PATTERN.replace("++", "+").replace("*+", "*").replace("'", "''")


@register("html_tokens", f"""
    WITH t AS (SELECT page_id, regexp_extract_all(html, '{_RE2_TOKEN}', 0) AS tokens FROM pages),
    r AS (SELECT page_id, unnest(generate_series(0, len(tokens) - 1)) AS token_no, unnest(tokens) AS token FROM t)
    SELECT page_id, CAST(token_no AS INTEGER) AS token_no, token,
        CASE WHEN token LIKE '<!--%' THEN 'comment' WHEN regexp_matches(token, '(?i)^<(script|style)[\\s/>]') THEN 'raw'
             WHEN regexp_matches(token, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(token, '^<[a-zA-Z]') THEN 'open'
             WHEN regexp_matches(token, '^<[!?]') THEN 'declaration' ELSE 'text' END AS kind,
        lower(regexp_extract(token, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag FROM r""")
def html_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return dom.html_tokens(table(spark, sf, "pages", "page_id"), ["page_id"])


# The content of every page between menu and footer, one row per token. ``nb``: bold tags opened up to
# and with the token; they are never closed, so every later paragraph opens up to three of them again.
_BODY_SQL = r"""
    raw AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)</nav>(.*?)(?:<footer|\z)', 1),
                '<!--(?s:.*?)-->|<[^>]+>|[^<]+', 0) AS l FROM pages),
    tok AS (SELECT page_id, unnest(generate_series(1, len(l))) AS i, unnest(l) AS t FROM raw),
    cnt AS (SELECT *, count(*) FILTER (t = '<b>') OVER w AS nb, count(*) FILTER (t = '<p>') OVER w AS p_no,
            max(CASE WHEN t IN ('<p>', '</p>', '</article>') THEN i * 2 + CAST(t = '<p>' AS INTEGER) END) OVER w % 2 = 1 AS p_open
            FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY i)),
    st AS (SELECT *, first_value(nb) OVER (PARTITION BY page_id, p_no ORDER BY i) AS nb0,
            CASE WHEN left(t, 1) = '<' THEN t ELSE
                regexp_replace(replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;?', '&', 'g'), '&', '&amp;'), '\s+', ' ', 'g') END AS piece
            FROM cnt),
    body AS (SELECT *, least(nb0, 3) + nb - nb0 AS k,
            lag(p_open, 1, FALSE) OVER o AS was_open, lag(least(nb0, 3) + nb - nb0, 1, 0) OVER o AS was_k
            FROM st WINDOW o AS (PARTITION BY page_id ORDER BY i))"""


def _page_frame(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return dom.page_frame(table(spark, sf, "pages", "page_id"), ["page_id"], **kw)


@register("dom_nodes", f"""WITH {_BODY_SQL}
    SELECT page_id, tag, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT page_id, regexp_extract(t, '^<([a-z0-9]+)', 1) AS tag, 1 AS n FROM body WHERE regexp_matches(t, '^<[a-z]')
        UNION ALL SELECT page_id, 'b', least(nb0, 3) FROM body WHERE t = '<p>'
        UNION ALL SELECT page_id, unnest(['html', 'head', 'body']), 1 FROM pages)
    GROUP BY ALL HAVING sum(n) > 0""")
def dom_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dom.node_rows(_page_frame(spark, sf), ["page_id"])
    return nodes.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_CLEAN_SQL = f"""WITH {_BODY_SQL}
    SELECT p.page_id, length(p.html) AS before, coalesce(c, '<body></body>') AS clean_html FROM pages p LEFT JOIN (
        SELECT page_id, '<body>' || string_agg(
            CASE WHEN t IN ('<p>', '</p>', '</article>') AND was_open THEN repeat('</b>', CAST(was_k AS INTEGER)) || '</p>' ELSE '' END
            || CASE WHEN t = '<p>' THEN '<p>' || repeat('<b>', CAST(least(nb0, 3) AS INTEGER)) WHEN t = '</p>' THEN '' ELSE piece END, ''
            ORDER BY i) || '</body>' AS c FROM body GROUP BY page_id) x ON x.page_id = p.page_id"""


@register("smallize_html", f"SELECT page_id, clean_html FROM ({_CLEAN_SQL})")
def smallize_html(spark: SparkSession, sf: str) -> DataFrame:
    return _page_frame(spark, sf, with_html=True).select("page_id", "clean_html")


@register("html_size_report", rf"""
    SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CAST(sum(before) AS BIGINT) AS chars_before,
           CAST(sum(length(clean_html)) AS BIGINT) AS chars_after FROM ({_CLEAN_SQL}) c JOIN pages USING (page_id) GROUP BY 1""")
def html_size_report(spark: SparkSession, sf: str) -> DataFrame:
    return dom.size_report(table(spark, sf, "pages", "page_id").withColumn("host", urls.url_host(F.col("url"))), ["host"])


@register("css_path", f"""WITH {_BODY_SQL}
    SELECT page_id, CASE t WHEN '<p>' THEN 'body article p' WHEN '<h1>' THEN 'body article h1'
        WHEN '<article>' THEN 'html body article' ELSE 'html body div.ad' END AS css_path, count(*) AS n
    FROM body WHERE t IN ('<p>', '<h1>', '<article>', '<div class="ad">') GROUP BY ALL""")
def css_path(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dom.node_rows(_page_frame(spark, sf), ["page_id"])
    chosen = nodes.filter(F.col("tag").isin("p", "h1", "article", "div"))
    return chosen.groupBy("page_id", "css_path").agg(F.count("*").alias("n"))


@register("ancestor_tail", f"""WITH {_BODY_SQL}
    SELECT page_id, n, 'html body article h1' AS full_path, array_to_string(list_slice(['html', 'body', 'article', 'h1'], -n, -1), ' ') AS tail
    FROM body, (SELECT unnest([1, 2, 3, 4, 9]) AS n) WHERE t = '<h1>'""")
def ancestor_tail(spark: SparkSession, sf: str) -> DataFrame:
    nodes = dom.node_rows(_page_frame(spark, sf), ["page_id"]).filter("tag = 'h1'")
    parts = [F.struct(F.lit(n).alias("n"), F.array_join(dom.tail_path(F.col("path"), n), " ").alias("tail")) for n in (1, 2, 3, 4, 9)]
    return nodes.select("page_id", F.array_join("path", " ").alias("full_path"), F.explode(F.array(*parts)).alias("x")).select(
        "page_id", "full_path", "x.n", "x.tail"
    )


@register("css_path_in_row", f"""WITH {THREADS}
    SELECT origin_id, page_no, path, count(*) AS n FROM (
        SELECT origin_id, page_no, unnest(CASE WHEN origin_id % 2 = 0 THEN ['{forum.TABLE_LINK}', 'td a'] ELSE ['{forum.LIST_LINK}'] END) AS path FROM threads
        UNION ALL SELECT DISTINCT origin_id, page_no, '{forum.NEXT_PATH}' FROM threads) GROUP BY ALL""")
def css_path_in_row(spark: SparkSession, sf: str) -> DataFrame:
    frame = dom.page_frame(forum.list_pages(spark, sf), ["origin_id", "page_no"])
    links = dom.node_rows(frame, ["origin_id", "page_no"]).filter("tag = 'a'")
    return links.groupBy("origin_id", "page_no", F.col("row_path").alias("path")).agg(F.count("*").alias("n"))


_PARAGRAPHS = "SELECT page_id, p_no, string_agg(replace(replace(piece, '&amp;', '&'), '&nbsp;', chr(160)), '' ORDER BY i) AS text FROM body WHERE p_open AND left(t, 1) <> '<' GROUP BY page_id, p_no"


@register("select_by_path", f"""WITH {_BODY_SQL}
    SELECT page_id, p_no - 1 AS nth, md5(text) AS text FROM ({_PARAGRAPHS})""")
def select_by_path(spark: SparkSession, sf: str) -> DataFrame:
    found = F.col("found")
    frame = _page_frame(spark, sf).withColumn("steps", dom.selector_steps(F.lit("html article p")))
    picked = frame.select("page_id", "texts", F.posexplode(dom.select_nodes(F.col("nodes"), F.col("steps"))).alias("nth", "found"))
    return picked.select("page_id", F.col("nth").cast("bigint").alias("nth"), F.md5(dom.node_text(F.col("texts"), found)).alias("text"))


@register("select_text", f"""WITH {_BODY_SQL}
    SELECT page_id, trim(string_agg(replace(piece, '&amp;', '&'), '' ORDER BY i)) AS text FROM body
    WHERE left(t, 1) <> '<' AND p_no = 0 AND i > (SELECT min(i) FROM body b2 WHERE b2.page_id = body.page_id AND b2.t = '<h1>') GROUP BY page_id""")
def select_text(spark: SparkSession, sf: str) -> DataFrame:
    frame = _page_frame(spark, sf).withColumn("steps", dom.selector_steps(F.lit("article h1")))
    text = dom.selected_text(F.col("nodes"), F.col("texts"), F.col("steps"))
    return frame.select("page_id", tx.js_trim(text).alias("text"))


@register("select_attr", """
    SELECT page_id, replace(regexp_extract(html, '<nav>.*?<a href="([^"]*)"', 1), '&amp;', '&') AS href FROM pages""")
def select_attr(spark: SparkSession, sf: str) -> DataFrame:
    frame = _page_frame(spark, sf, clean=False).withColumn("steps", dom.selector_steps(F.lit("nav ul a")))
    return frame.select("page_id", dom.selected_attr(F.col("nodes"), F.col("steps"), "href").alias("href"))


@register("own_text", f"""WITH {_BODY_SQL}
    SELECT page_id, replace(piece, '&amp;', '&') AS text FROM body b
    WHERE EXISTS (SELECT 1 FROM body a WHERE a.page_id = b.page_id AND a.i = b.i - 1 AND a.t = '<div class="ad">')""")
def own_text(spark: SparkSession, sf: str) -> DataFrame:
    return dom.node_rows(_page_frame(spark, sf), ["page_id"]).filter("class = 'ad'").select("page_id", F.col("own_text").alias("text"))


@register("child_text_2x", f"""WITH {_BODY_SQL}
    SELECT page_id, coalesce(md5(repeat(text, 2)), md5('')) AS text FROM (
        SELECT page_id, string_agg(replace(piece, '&amp;', '&'), '' ORDER BY i)
            FILTER (left(t, 1) <> '<' AND (p_no = 0 AND NOT was_ad OR p_open AND k = 0)) AS text
        FROM (SELECT *, lag(t) OVER (PARTITION BY page_id ORDER BY i) = '<div class="ad">' AS was_ad FROM body) GROUP BY page_id)""")
def child_text_2x(spark: SparkSession, sf: str) -> DataFrame:
    frame = _page_frame(spark, sf)
    found = F.filter(F.col("nodes"), lambda n: n["tag"] == "article")
    text = F.transform(found, lambda n: F.md5(dom.child_text(F.col("nodes"), F.col("texts"), n)))
    return frame.select("page_id", F.explode(text).alias("text"))


@register("sibling_text", f"""WITH {_BODY_SQL}
    SELECT page_id, coalesce(text, md5('')) AS text FROM (SELECT DISTINCT page_id FROM body WHERE t = '<h1>') LEFT JOIN (
        SELECT page_id, md5(string_agg(trim(text), '' ORDER BY p_no)) AS text FROM ({_PARAGRAPHS}) GROUP BY page_id) USING (page_id)""")
def sibling_text(spark: SparkSession, sf: str) -> DataFrame:
    frame = _page_frame(spark, sf)
    heads = F.filter(F.col("nodes"), lambda n: n["tag"] == "h1")

    def around(n: Column) -> Column:
        parts = F.transform(dom.siblings(F.col("nodes"), n), lambda s: tx.js_trim(dom.node_text(F.col("texts"), s)))
        return F.md5(F.array_join(parts, ""))

    return frame.select("page_id", F.explode(F.transform(heads, around)).alias("text"))


# ---- inferred paths ------------------------------------------------------------------------

def _vote_sql(rows: str, by: str, order: str) -> str:
    """Winner per group: most votes, then first vote."""
    return (f"SELECT {by}, path, n FROM (SELECT {by}, path, count(*) AS n, min({order}) AS f FROM {rows} GROUP BY {by}, path)"
            f" QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, f) = 1")


_TABLE_PAGES = f"""table_pages AS (
    SELECT origin_id, page_no, CASE WHEN origin_id % 2 = 0 THEN '{forum.TABLE_PATH}'
           WHEN count(*) BETWEEN 16 AND 39 THEN '{forum.LIST_PATH}' ELSE '{forum.WRAP_PATH}' END AS path
    FROM threads GROUP BY origin_id, page_no)"""
# In blocks every row gives the same path; a page whose voted table is not its own best one has the
# list and the pager as its two rows, and the list comes first.
_LINK_PAGES = f"""link_pages AS (
    SELECT origin_id, page_no, arg_min(path, (-n, f)) AS path FROM (
        SELECT origin_id, page_no, count(*) AS n, min(pos) AS f,
               CASE WHEN origin_id % 2 = 1 THEN '{forum.LIST_LINK}' WHEN doc_id % 7 = 0 THEN 'td a' ELSE '{forum.TABLE_LINK}' END AS path
        FROM threads GROUP BY ALL) GROUP BY origin_id, page_no)"""


def _list_frame(spark: SparkSession, sf: str) -> DataFrame:
    return dom.page_frame(forum.list_pages(spark, sf), ["origin_id", "page_no", "url"])


@register("path_votes", f"""WITH {THREADS}, {_TABLE_PAGES}
    SELECT origin_id, path, count(*) AS n, min(page_no) AS first_page FROM table_pages GROUP BY ALL""")
def path_votes(spark: SparkSession, sf: str) -> DataFrame:
    paths = infer.table_page_paths(_list_frame(spark, sf)).select("origin_id", "page_no", "path")
    votes = infer.path_votes(paths, ["origin_id"], ["page_no"])
    return votes.select("origin_id", "path", "n", F.col("first_seen.page_no").alias("first_page"))


@register("path_winner", f"WITH votes AS (SELECT user_id, event_type AS path, event_id FROM events) {_vote_sql('votes', 'user_id', 'event_id')}")
def path_winner(spark: SparkSession, sf: str) -> DataFrame:
    cast = table(spark, sf, "events").select("user_id", F.col("event_type").alias("path"), "event_id")
    return infer.vote_winner(infer.path_votes(cast, ["user_id"], ["event_id"]), ["user_id"])


@register("node_argmax", """
    SELECT user_id, CAST(floor(value) AS BIGINT) AS score, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) = 1""")
def node_argmax(spark: SparkSession, sf: str) -> DataFrame:
    scored = table(spark, sf, "events").select("user_id", F.floor("value").alias("score"), "event_id")
    return infer.node_argmax(scored, ["user_id"], "score", "event_id")


@register("thread_table", f"WITH {THREADS}, {_TABLE_PAGES} {_vote_sql('table_pages', 'origin_id', 'page_no')}")
def thread_table(spark: SparkSession, sf: str) -> DataFrame:
    return infer.thread_table(_list_frame(spark, sf), ["origin_id"])


@register("thread_link", f"WITH {THREADS}, {_LINK_PAGES} {_vote_sql('link_pages', 'origin_id', 'page_no')}")
def thread_link(spark: SparkSession, sf: str) -> DataFrame:
    frame = staged(_list_frame(spark, sf), "list-pages")
    return infer.thread_link(frame, infer.thread_table(frame, ["origin_id"]), ["origin_id"])


_FIELD_ROWS = f"""field_rows AS (
    SELECT origin_id, page_no, pos, page_no * 1000 + pos AS place, unnest(['title', 'description', 'date']) AS role,
           unnest(['{forum.TITLE_PATH}', CASE WHEN length(flat) > 150 AND length(flat) <= 300 THEN '{forum.BODY_BLOCK_PATH}'
                   ELSE '{forum.BODY_PATH}' END, '{forum.DATE_PATH}']) AS path FROM threads)"""


@register("thread_fields", f"""WITH {THREADS}, {_FIELD_ROWS}
    SELECT origin_id, role, path, count(*) AS n, min(place) AS place FROM field_rows GROUP BY ALL""")
def thread_fields(spark: SparkSession, sf: str) -> DataFrame:
    frame = dom.page_frame(forum.thread_pages(spark, sf), ["origin_id", "page_no", "pos", "link_title"])
    votes = infer.thread_fields(frame, ["origin_id"], ["page_no", "pos"], as_of())
    place = F.col("first_seen.page_no") * 1000 + F.col("first_seen.pos")
    return votes.select("origin_id", "role", "path", "n", place.alias("place"))


_FIELD_WINNERS = f"field_winners AS ({_vote_sql('field_rows', 'origin_id, role', 'place')})"
_WINNER_COLUMNS = """max(path) FILTER (role = 'title') AS thread_title_path,
    max(path) FILTER (role = 'description') AS thread_description_path, max(path) FILTER (role = 'date') AS thread_pubblication_date_path"""


@register("thread_field_winners", f"""WITH {THREADS}, {_FIELD_ROWS}, {_FIELD_WINNERS}
    SELECT origin_id, {_WINNER_COLUMNS} FROM field_winners GROUP BY origin_id""")
def thread_field_winners(spark: SparkSession, sf: str) -> DataFrame:
    frame = dom.page_frame(forum.thread_pages(spark, sf), ["origin_id", "page_no", "pos", "link_title"])
    return infer.thread_field_winners(infer.thread_fields(frame, ["origin_id"], ["page_no", "pos"], as_of()), ["origin_id"])


@register("next_page", f"""WITH {THREADS}
    SELECT DISTINCT origin_id, page_no, '{forum.NEXT_PATH}' AS path,
        'https://forum' || origin_id || '.example/list?page=' || (page_no + 1) AS link FROM threads""")
def next_page(spark: SparkSession, sf: str) -> DataFrame:
    return infer.next_page(_list_frame(spark, sf), ["origin_id", "page_no"])


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    chosen = forum.known_paths(spark, sf).filter(F.col("origin_id") % 3 == 0)
    return chosen.select(
        "origin_id", F.lit("h1.own").alias("thread_title_path"), F.lit("p.own").alias("thread_description_path"),
        F.lit("i.own").alias("thread_pubblication_date_path"),
    )


@register("path_coalesce", f"""WITH {THREADS}
    SELECT DISTINCT origin_id, CASE WHEN origin_id % 3 = 0 THEN 'h1.own' ELSE '{forum.TITLE_PATH}' END AS thread_title_path,
        CASE WHEN origin_id % 3 = 0 THEN 'i.own' ELSE '{forum.DATE_PATH}' END AS thread_pubblication_date_path FROM threads""")
def path_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    merged = infer.apply_overrides(forum.known_paths(spark, sf), _overrides(spark, sf), ["origin_id"])
    return merged.select("origin_id", "thread_title_path", "thread_pubblication_date_path")


@register("infer_site", f"""WITH {THREADS.replace('FROM documents', f'FROM documents WHERE doc_id // {forum.ORIGINS} // {forum.PER_PAGE} < {DEFAULTS.explore_pages}')},
    {_TABLE_PAGES}, {_LINK_PAGES}, {_FIELD_ROWS}, {_FIELD_WINNERS},
    t AS ({_vote_sql('table_pages', 'origin_id', 'page_no')}), l AS ({_vote_sql('link_pages', 'origin_id', 'page_no')}),
    f AS (SELECT origin_id, {_WINNER_COLUMNS} FROM field_winners GROUP BY origin_id)
    SELECT t.origin_id, t.path AS table_body_path, l.path AS thread_link_path, '{forum.NEXT_PATH}' AS next_page_path,
        CASE WHEN t.origin_id % 3 = 0 THEN 'h1.own' ELSE thread_title_path END AS thread_title_path,
        CASE WHEN t.origin_id % 3 = 0 THEN 'p.own' ELSE thread_description_path END AS thread_description_path,
        CASE WHEN t.origin_id % 3 = 0 THEN 'i.own' ELSE thread_pubblication_date_path END AS thread_pubblication_date_path,
        TRUE AS is_auto_generated FROM t JOIN l USING (origin_id) JOIN f USING (origin_id)""")
def infer_site(spark: SparkSession, sf: str) -> DataFrame:
    sampled = forum.thread_pages(spark, sf).filter(F.col("page_no") < DEFAULTS.explore_pages)
    return infer.infer_site(forum.list_pages(spark, sf), sampled, as_of(), _overrides(spark, sf))


# ---- extraction ----------------------------------------------------------------------------

def _known_list_frame(spark: SparkSession, sf: str) -> DataFrame:
    return infer.list_frame(forum.list_pages(spark, sf), forum.known_paths(spark, sf), ["origin_id"])


@register("explore_links", f"WITH {THREADS} SELECT origin_id, page_no, CAST(pos AS INTEGER) AS pos, link, title AS link_title FROM threads")
def explore_links(spark: SparkSession, sf: str) -> DataFrame:
    return infer.explore_links(_known_list_frame(spark, sf), ["origin_id"])


_LAST_SEEN = f"""last_seen AS (SELECT origin_id, max(CASE WHEN origin_id % 4 = 1 THEN page_no * 100 + pos END) AS place
    FROM threads WHERE doc_id // {forum.ORIGINS} <= 25 GROUP BY origin_id)"""


def _last_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth origin was read up to its 26th thread (or its last); the others never."""
    early = forum.threads(spark, sf).filter(F.floor(F.col("doc_id") / forum.ORIGINS) <= 25)
    seen = F.when(F.col("origin_id") % 4 == 1, F.struct("page_no", "pos", "link"))
    return early.groupBy("origin_id").agg(F.max(seen).alias("m")).select("origin_id", F.col("m.link").alias("last_url"))


@register("links_until_seen", f"""WITH {THREADS}, {_LAST_SEEN}
    SELECT origin_id, page_no, CAST(pos AS INTEGER) AS pos, link FROM threads JOIN last_seen USING (origin_id)
    WHERE place IS NULL OR page_no * 100 + pos < place""")
def links_until_seen(spark: SparkSession, sf: str) -> DataFrame:
    links = staged(infer.explore_links(_known_list_frame(spark, sf), ["origin_id"]), "links")
    return extract.links_until_seen(links, _last_urls(spark, sf)).select("origin_id", "page_no", "pos", "link")


@register("next_last_url", f"WITH {THREADS} SELECT origin_id, link AS last_url FROM threads WHERE page_no = 0 AND pos = 5")
def next_last_url(spark: SparkSession, sf: str) -> DataFrame:
    links = infer.explore_links(_known_list_frame(spark, sf), ["origin_id"])
    return extract.next_last_url(links)


@register("thread_list_scrape", f"""WITH {THREADS}, {_LAST_SEEN}
    SELECT 'link' AS kind, origin_id, page_no, link AS value FROM threads JOIN last_seen USING (origin_id)
    WHERE place IS NULL OR page_no * 100 + pos < place
    UNION ALL SELECT DISTINCT 'next', origin_id, page_no, 'https://forum' || origin_id || '.example/list?page=' || (page_no + 1) FROM threads
    UNION ALL SELECT 'last_url', origin_id, 0, link FROM threads WHERE page_no = 0 AND pos = 5""")
def thread_list_scrape(spark: SparkSession, sf: str) -> DataFrame:
    links, forward, last = extract.thread_list_scrape(
        forum.list_pages(spark, sf), forum.known_paths(spark, sf), _last_urls(spark, sf)
    )
    parts = [("link", links, "page_no", "link"), ("next", forward, "page_no", "next_url"), ("last_url", last, None, "last_url")]
    rows = [
        df.select(
            F.lit(kind).alias("kind"), "origin_id",
            (F.col(page) if page else F.lit(0)).cast("bigint").alias("page_no"), F.col(value).alias("value"),
        )
        for kind, df, page, value in parts
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_EXTRACT_SQL = f"""WITH {THREADS}
    SELECT origin_id, link AS url, title, trim(flat) AS description, CAST(epoch({forum.DATE_SQL}) AS BIGINT) AS seconds
    FROM threads WHERE trim(flat) <> '' AND doc_id % 5 <> 0"""


def _known_threads(spark: SparkSession, sf: str) -> DataFrame:
    return forum.threads(spark, sf).filter(F.col("doc_id") % 5 == 0).select(F.col("link").alias("url"))


@register("thread_extract", _EXTRACT_SQL)
def thread_extract(spark: SparkSession, sf: str) -> DataFrame:
    pages = forum.thread_pages(spark, sf)
    rows = extract.thread_extract(pages, forum.known_paths(spark, sf), _known_threads(spark, sf), as_of())
    return rows.select("origin_id", "url", "title", "description", F.unix_seconds("published_time").alias("seconds"))


@register("thread_dates", f"""
    SELECT 'reference' AS semantics, url, seconds FROM ({_EXTRACT_SQL})
    UNION ALL SELECT 'intended', url, seconds FROM ({_EXTRACT_SQL.replace(forum.DATE_SQL, 'ts')})""")
def thread_dates(spark: SparkSession, sf: str) -> DataFrame:
    """12 AM as written is hour 12, as intended hour 0."""
    def dated(semantics: str) -> DataFrame:
        pages, paths = forum.thread_pages(spark, sf), forum.known_paths(spark, sf)
        rows = extract.thread_extract(pages, paths, _known_threads(spark, sf), as_of(), semantics)
        return rows.select(F.lit(semantics).alias("semantics"), "url", F.unix_seconds("published_time").alias("seconds"))

    return dated("reference").unionByName(dated("intended"))


@register("insert_source_thread", f"""
    SELECT origin_id AS _id_origin, url, title, left(description, 65535) AS description, seconds FROM ({_EXTRACT_SQL})""")
def insert_source_thread(spark: SparkSession, sf: str) -> DataFrame:
    pages = forum.thread_pages(spark, sf)
    rows = extract.thread_extract(pages, forum.known_paths(spark, sf), _known_threads(spark, sf), as_of())
    source, thread = extract.split_threads(rows)
    return source.join(thread, "_id_source").select(
        "_id_origin", "url", "title", "description", F.unix_seconds("published_time").alias("seconds")
    )


@register("non_empty_threads", """
    SELECT p_partkey FROM part WHERE p_name <> '' AND trim(regexp_replace(p_type, '[A-N]', '', 'g')) <> ''""")
def non_empty_threads(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("title"),
        tx.js_trim(F.regexp_replace("p_type", "[A-N]", "")).alias("description"),
    )
    return extract.non_empty_threads(rows).select("p_partkey")


@register("stream_pages", f"""
    SELECT origin_id AS _id_origin, url, title, left(description, 65535) AS description, seconds
    FROM ({_EXTRACT_SQL.replace(" AND doc_id % 5 <> 0", "")})""")
def stream_pages(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "pages")
    pages = forum.thread_pages(spark, sf).select("origin_id", "url", "html")
    pages.write.parquet(f"{root}/in/first")
    # Some pages are captured twice.
    pages.filter(F.col("origin_id") % 4 == 0).write.parquet(f"{root}/in/second")
    stream = (
        spark.readStream.schema(streams.PAGE_SCHEMA).option("maxFilesPerTrigger", 8)
        .option("recursiveFileLookup", "true").parquet(f"{root}/in")
    )
    paths = staged(forum.known_paths(spark, sf), "paths")
    streams.stream_pages(stream, paths, f"{root}/out", f"{root}/state", as_of()).awaitTermination()
    source = streams.stored(spark, f"{root}/out", "source", TABLES["source"])
    thread = streams.stored(spark, f"{root}/out", "source_thread", TABLES["source_thread"])
    return source.join(thread, "_id_source").select(
        "_id_origin", "url", "title", "description", F.unix_seconds("published_time").alias("seconds")
    )


@register("stream_list_pages", f"""WITH {THREADS}, {_LAST_SEEN}
    SELECT 'link' AS kind, origin_id, page_no, link AS value FROM threads JOIN last_seen USING (origin_id)
    WHERE place IS NULL OR page_no * 100 + pos < place
    UNION ALL SELECT DISTINCT 'next', origin_id, page_no, 'https://forum' || origin_id || '.example/list?page=' || (page_no + 1) FROM threads
    UNION ALL SELECT 'last_url', origin_id, 0, link FROM threads WHERE page_no = 0 AND pos = 5""")
def stream_list_pages(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "list-pages")
    out = f"{root}/out"
    pages = forum.list_pages(spark, sf).withColumn("page_no", F.col("page_no").cast("bigint"))
    pages.select(*streams.LIST_PAGE_SCHEMA.names).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(streams.LIST_PAGE_SCHEMA).parquet(f"{root}/in")
    paths, seen = staged(forum.known_paths(spark, sf), "paths"), staged(_last_urls(spark, sf), "last-urls")
    streams.stream_list_pages(stream, paths, seen, out, f"{root}/state").awaitTermination()
    links = streams.stored(spark, out, "links", streams.LINK_SCHEMA)
    forward = streams.stored(spark, out, "next_pages", streams.NEXT_SCHEMA)
    last = streams.stored(spark, out, "last_urls", streams.LAST_URL_SCHEMA)
    return (
        links.select(F.lit("link").alias("kind"), "origin_id", "page_no", F.col("link").alias("value"))
        .unionByName(forward.select(F.lit("next").alias("kind"), "origin_id", "page_no", F.col("next_url").alias("value")))
        .unionByName(last.select(
            F.lit("last_url").alias("kind"), "origin_id", F.lit(0).cast("bigint").alias("page_no"), F.col("last_url").alias("value")
        ))
    )
