"""Queries on origins, histories, messages, table maintenance, audits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.catalog import derived as d
from harborwatch.catalog.registry import register, table
from harborwatch.config import DEFAULTS
from harborwatch.functions import text as tx
from harborwatch.functions import urls
from harborwatch.operators import audit, origins, replay, tables
from harborwatch.schemas import PATH_COLUMNS, TABLES
from harborwatch.session import scratch_path, staged
from harborwatch.sources import feeds
from harborwatch.streaming import streams

with_ctes, stamp, stamp_sql, as_of = d.with_ctes, d.stamp, d.stamp_sql, d.as_of


# ---- sources and small expressions ---------------------------------------------------------

@register("filetype_filter", """
    SELECT page_id, lower(url) LIKE '%.html' OR lower(url) LIKE '%.csv' AS supported FROM pages""")
def filetype_filter(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url"))
    return table(spark, sf, "pages", "page_id").select("page_id", tx.supported_filetype(name, ["html", "csv"]).alias("supported"))


@register("message_feed", with_ctes(["messages", "channel"], """
    SELECT m.domain, m.message_id, c._id_origin FROM messages m JOIN channel c ON m.domain = c.domain
    WHERE m.message_id > coalesce(c.last_checked, 0)"""))
def message_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.message_feed(d.messages(spark, sf), d.channel(spark, sf)).select("domain", "message_id", "_id_origin")


@register("page_table", """
    SELECT page_id, url FROM pages WHERE url LIKE '%?%'""")
def page_table(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("url").contains("?"), "THREAD_LIST").otherwise("THREAD")
    pages = table(spark, sf, "pages", "page_id").withColumn("label", label)
    return feeds.pages_of(pages, "THREAD_LIST").select("page_id", "url")


@register("origins_by_category", with_ctes(["origin"], """
    SELECT domain AS url, 'THREAD_LIST' AS label FROM origin WHERE category = 2"""))
def origins_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.origins_by_category(d.origin(spark, sf), 2)


@register("origin_category", """
    SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 1 WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS category FROM pages""")
def origin_category(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id")
    dark = F.regexp_replace("url", r"^([a-z]+://[^/]*)\.[a-z]+(/|$)", "$1.Onion:80$2")
    url = F.when(p % 3 == 0, dark).otherwise(F.concat(F.col("url"), F.lit("?to=x.onion")))
    return table(spark, sf, "pages", "page_id").select("page_id", urls.origin_category(url, p % 5 == 0).alias("category"))


@register("channel_key", """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -1000000000000 - c_custkey END AS id,
           CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '-' || c_custkey ELSE c_name END END AS tag
    FROM customer""")
def channel_key(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    domain = (
        F.when(c % 2 == 0, (F.lit(-1000000000000) - c).cast("string"))
        .when(c % 3 == 0, F.concat(F.lit("-"), c.cast("string"))).otherwise(F.col("c_name"))
    )
    key = tx.channel_key(domain)
    return table(spark, sf, "customer").select("c_custkey", key["id"].alias("id"), key["tag"].alias("tag"))


@register("truncate_description", """
    SELECT doc_id, length(left(t, 65535)) AS n, md5(left(t, 65535)) AS digest
    FROM (SELECT doc_id, repeat(text, 20) AS t FROM documents)""")
def truncate_description(spark: SparkSession, sf: str) -> DataFrame:
    long = tx.truncate_description(F.repeat("text", F.lit(20)))
    return table(spark, sf, "documents", "doc_id").select("doc_id", F.length(long).alias("n"), F.md5(long).alias("digest"))


@register("parse_channel_info", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS channel_id,
           CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS about,
           CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS participants_count
    FROM customer""")
def parse_channel_info(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    full = F.struct(
        c.alias("id"), F.col("c_name").alias("about"), F.lit(7).alias("pts"),
        F.col("c_nationkey").alias("participants_count"),
    )
    chats = F.when(c % 4 != 0, F.array(F.struct(F.lit("2024-01-01").alias("date"), c.alias("access_hash"))))
    raw = F.to_json(F.struct(full.alias("full_chat"), chats.alias("chats")))
    info = feeds.parse_channel_info(raw)
    return table(spark, sf, "customer").select(
        "c_custkey", *[info[n].alias(n) for n in ("channel_id", "about", "participants_count")]
    )


# ---- look-ups ------------------------------------------------------------------------------

_LATEST = """latest AS (SELECT * FROM history QUALIFY row_number() OVER (
    PARTITION BY _id_origin ORDER BY updated_time DESC, _id_origin_history DESC) = 1)"""


@register("origin_profile", with_ctes(["origin", "history", "forum_path"], f"""
    , {_LATEST} SELECT o.category, o.domain, o._id_origin, {stamp_sql('l.updated_time')} AS updated_time,
           l.additional_infos, o.last_url, {', '.join('p.' + c for c in PATH_COLUMNS)}
    FROM origin o JOIN latest l USING (_id_origin) JOIN forum_path p USING (_id_origin)"""))
def origin_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = origins.origin_profile(d.origin(spark, sf), d.history(spark, sf), d.forum_path(spark, sf))
    return found.withColumn("updated_time", stamp("updated_time"))


@register("latest_history", with_ctes(["origin", "history"], f"""
    SELECT o._id_origin, o.domain, h._id_origin_history, {stamp_sql('h.updated_time')} AS updated_time
    FROM origin o JOIN history h ON h._id_origin = o._id_origin
     AND h.updated_time = (SELECT max(z.updated_time) FROM history z WHERE o.category = 1 AND z._id_origin = o._id_origin)"""))
def latest_history(spark: SparkSession, sf: str) -> DataFrame:
    found = origins.latest_history(d.origin(spark, sf), d.history(spark, sf))
    return found.select("_id_origin", "domain", "_id_origin_history", stamp("updated_time").alias("updated_time"))


@register("latest_per_key", with_ctes(["history"], f"""
    , {_LATEST} SELECT _id_origin, _id_origin_history FROM latest"""))
def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.col("updated_time").desc(), F.col("_id_origin_history").desc()]
    return origins.latest_per_key(d.history(spark, sf), ["_id_origin"], order).select("_id_origin", "_id_origin_history")


@register("sample_first_n", """
    SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 4""")
def sample_first_n(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return origins.first_n(events, ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id")


_MESSAGE_PROBES = """probes AS (
    SELECT c_name AS domain, CAST(c_nationkey % 9 AS INTEGER) AS message_id FROM customer)"""


@register("message_seen", with_ctes(["origin", "source", "source_telegram"], f"""
    , {_MESSAGE_PROBES}, stored AS (
        SELECT o.domain, t._id_source_telegram AS message_id, count(*) AS n FROM origin o
        JOIN source s ON s._id_origin = o._id_origin JOIN source_telegram t ON t._id_source = s._id_source GROUP BY ALL)
    SELECT domain, message_id, coalesce(n, 0) AS n,
           CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'seen' ELSE 'corrupt' END AS status
    FROM probes LEFT JOIN stored USING (domain, message_id)"""))
def message_seen(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "customer").select(
        F.col("c_name").alias("domain"), (F.col("c_nationkey") % 9).alias("message_id")
    )
    return origins.message_status(probes, d.origin(spark, sf), d.source(spark, sf), d.source_telegram(spark, sf))


@register("author_lookup", with_ctes(["author", "source"], """
    , probes AS (SELECT c_custkey AS _id_origin, 'Brand#' || c_nationkey AS tag FROM customer),
    known AS (SELECT DISTINCT s._id_origin, a.tag, a._id_author FROM author a JOIN source s ON a._id_author = s._id_author)
    SELECT p._id_origin, p.tag, CASE WHEN count(k._id_author) = 1 THEN min(k._id_author) END AS _id_author
    FROM probes p LEFT JOIN known k USING (_id_origin, tag) GROUP BY p._id_origin, p.tag"""))
def author_lookup(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("_id_origin"),
        F.concat(F.lit("Brand#"), F.col("c_nationkey").cast("string")).alias("tag"),
    )
    return origins.author_lookup(d.author(spark, sf), d.source(spark, sf), probes)


@register("author_distinct", with_ctes(["author", "source"], """
    SELECT DISTINCT s._id_origin, a.tag FROM author a JOIN source s ON a._id_author = s._id_author
    WHERE a.tag IS NOT NULL"""))
def author_distinct(spark: SparkSession, sf: str) -> DataFrame:
    joined = d.source(spark, sf).join(d.author(spark, sf), "_id_author").filter(F.col("tag").isNotNull())
    return joined.select("_id_origin", "tag").distinct()


@register("origin_lookup", with_ctes(["origin"], """
    SELECT _id_origin, category, domain FROM origin WHERE (category, domain) IN (
        SELECT CAST(c_custkey % 3 AS INTEGER), c_name FROM customer)"""))
def origin_lookup(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 3).cast("int").alias("category"), F.col("c_name").alias("domain")
    )
    return origins.origin_lookup(d.origin(spark, sf), probes).select("_id_origin", "category", "domain")


@register("forum_path_lookup", with_ctes(["forum_path"], """
    SELECT _id_forum_path, thread_title_path FROM forum_path WHERE _id_origin IN (SELECT o_custkey FROM orders)"""))
def forum_path_lookup(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select(F.col("o_custkey").alias("_id_origin"))
    return origins.forum_path_lookup(d.forum_path(spark, sf), ids).select("_id_forum_path", "thread_title_path")


@register("thread_unseen", with_ctes(["source_thread"], """
    SELECT page_id, 'https://forum.example/t/' || page_id * 7 AS url FROM pages
    WHERE 'https://forum.example/t/' || page_id * 7 NOT IN (SELECT url FROM source_thread)"""))
def thread_unseen(spark: SparkSession, sf: str) -> DataFrame:
    from harborwatch.operators.extract import unseen_threads

    url = F.concat(F.lit("https://forum.example/t/"), (F.col("page_id") * 7).cast("string"))
    threads = table(spark, sf, "pages", "page_id").select("page_id", url.alias("url"))
    return unseen_threads(threads, d.source_thread(spark, sf))


# ---- freshness, deadness, check points -----------------------------------------------------

@register("staleness", with_ctes(["history"], f"""
    SELECT _id_origin, {stamp_sql('max(updated_time)')} AS updated_time FROM history GROUP BY _id_origin
    HAVING max(updated_time) < {d.AS_OF_SQL} - INTERVAL 12 HOUR"""))
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    latest = origins.latest_per_key(
        d.history(spark, sf), ["_id_origin"], [F.col("updated_time").desc(), F.col("_id_origin_history")]
    )
    return origins.stale_origins(latest, as_of()).select("_id_origin", stamp("updated_time").alias("updated_time"))


_REFRESH = """
    , {latest}, checked AS (SELECT c_custkey AS _id_origin, CASE WHEN c_custkey % 3 = 0 THEN 'view' ELSE 'click' END AS infos FROM customer),
    stale AS (SELECT l.*, c.infos FROM latest l JOIN checked c USING (_id_origin) WHERE l.updated_time < {now} - INTERVAL 12 HOUR)
    SELECT h.additional_infos, {t1} AS updated_time, h._id_origin FROM history h
    LEFT JOIN stale s ON s._id_origin = h._id_origin AND s.updated_time = h.updated_time AND {same}
    UNION ALL SELECT infos, {t2}, _id_origin FROM stale s WHERE NOT ({same})"""


def _refresh_sql(same: str) -> str:
    return with_ctes(["history"], _REFRESH.format(
        latest=_LATEST, now=d.AS_OF_SQL, same=same, t2=stamp_sql(d.AS_OF_SQL),
        t1=stamp_sql(f"CASE WHEN s._id_origin IS NULL THEN h.updated_time ELSE {d.AS_OF_SQL} END"),
    ))


def _refresh(spark: SparkSession, sf: str, channel: bool) -> DataFrame:
    checked = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("_id_origin"),
        F.when(F.col("c_custkey") % 3 == 0, "view").otherwise("click").alias("additional_infos"),
    )
    after = origins.refresh_history(d.history(spark, sf), checked, as_of(), channel=channel)
    return after.select("additional_infos", stamp("updated_time").alias("updated_time"), "_id_origin")


@register("refresh_history", _refresh_sql("s.infos = s.additional_infos"))
def refresh_history(spark: SparkSession, sf: str) -> DataFrame:
    return _refresh(spark, sf, channel=False)


@register("refresh_history_channel", _refresh_sql("FALSE"))
def refresh_history_channel(spark: SparkSession, sf: str) -> DataFrame:
    return _refresh(spark, sf, channel=True)


def _replay_sql(changed: str) -> str:
    return f"""WITH RECURSIVE history AS ({d.CTES['history']}),
    log AS (SELECT user_id AS o, ts + INTERVAL 20 DAY AS ts, min(event_type) AS infos FROM events GROUP BY 1, 2),
    newest AS (SELECT _id_origin AS o, updated_time AS t0, additional_infos AS old FROM history
        QUALIFY row_number() OVER (PARTITION BY _id_origin ORDER BY updated_time DESC, _id_origin_history DESC) = 1),
    due AS (
        SELECT n.o, min(l.ts) AS ts FROM newest n JOIN log l ON l.o = n.o AND l.ts > n.t0 + INTERVAL 12 HOUR GROUP BY n.o
        UNION ALL SELECT a.o, min(l.ts) FROM due a JOIN log l ON l.o = a.o AND l.ts > a.ts + INTERVAL 12 HOUR GROUP BY a.o
    ),
    told AS (SELECT o, ts, infos, old, t0, lag(infos) OVER (PARTITION BY o ORDER BY ts) AS prior,
        row_number() OVER (PARTITION BY o ORDER BY ts) AS k FROM due JOIN log USING (o, ts) JOIN newest USING (o)),
    runs AS (SELECT *, sum(CASE WHEN {changed} THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY ts) AS run FROM told),
    ends AS (SELECT o, run, any_value(t0) AS t0, any_value(infos) AS infos, max(ts) AS last FROM runs GROUP BY o, run)
    SELECT h.additional_infos, {stamp_sql('coalesce(e.last, h.updated_time)')} AS updated_time, h._id_origin
    FROM history h LEFT JOIN ends e ON e.run = 0 AND e.o = h._id_origin AND e.t0 = h.updated_time
    UNION ALL SELECT infos, {stamp_sql('last')}, o FROM ends WHERE run > 0"""


def _replay(spark: SparkSession, sf: str, channel: bool) -> DataFrame:
    """Every event once more, twenty days later, as a check of its user's origin."""
    log = table(spark, sf, "events").select(
        F.col("user_id").alias("_id_origin"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 20 DAYS")).alias("ts"),
        F.col("event_type").alias("additional_infos"),
    )
    after = replay.replay_checks(d.history(spark, sf), log, channel=channel)
    return after.select("additional_infos", stamp("updated_time").alias("updated_time"), "_id_origin")


@register("replay_checks", _replay_sql("infos <> CASE WHEN k = 1 THEN old ELSE prior END"))
def replay_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _replay(spark, sf, channel=False)


@register("replay_checks_channel", _replay_sql("TRUE"))
def replay_checks_channel(spark: SparkSession, sf: str) -> DataFrame:
    return _replay(spark, sf, channel=True)


_RESET_SQL = """
    , resets AS (SELECT _id_origin, max(ts) AS last_reset FROM checks WHERE reachable AND stale GROUP BY 1),
    up AS (SELECT c._id_origin, count(*) AS n FROM checks c LEFT JOIN resets r USING (_id_origin)
           WHERE NOT reachable AND (last_reset IS NULL OR ts > last_reset) GROUP BY 1)
    SELECT o._id_origin, CASE WHEN last_reset IS NULL THEN is_dead_score ELSE 0 END + coalesce(n, 0) AS is_dead_score
    FROM origin o LEFT JOIN resets USING (_id_origin) LEFT JOIN up USING (_id_origin)"""


@register("origin_deadness", with_ctes(["origin", "checks"], """
    SELECT o._id_origin, o.is_dead_score + count(*) FILTER (c.reachable AND c.stale) AS is_dead_score
    FROM origin o LEFT JOIN checks c USING (_id_origin) GROUP BY o._id_origin, o.is_dead_score"""))
def origin_deadness(spark: SparkSession, sf: str) -> DataFrame:
    return origins.deadness(d.origin(spark, sf), d.checks(spark, sf))


@register("origin_deadness_intended", with_ctes(["origin", "checks"], _RESET_SQL))
def origin_deadness_intended(spark: SparkSession, sf: str) -> DataFrame:
    return origins.deadness(d.origin(spark, sf), d.checks(spark, sf), "web", "intended")


@register("origin_deadness_channel", with_ctes(["origin", "checks"], _RESET_SQL))
def origin_deadness_channel(spark: SparkSession, sf: str) -> DataFrame:
    return origins.deadness(d.origin(spark, sf), d.checks(spark, sf), "channel")


@register("advance_checkpoint", with_ctes(["messages", "channel"], """
    SELECT c._id_origin, greatest(c.last_checked, max(m.message_id)) AS last_checked
    FROM channel c LEFT JOIN messages m ON m.domain = c.domain AND m.message_id > coalesce(c.last_checked, 0)
    GROUP BY c._id_origin, c.last_checked"""))
def advance_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    channel = d.channel(spark, sf)
    seen = feeds.message_feed(d.messages(spark, sf), channel).select("_id_origin", "message_id")
    return origins.advance_checkpoint(channel, seen).select("_id_origin", "last_checked")


@register("advance_last_url", with_ctes(["origin"], """
    SELECT _id_origin, coalesce('https://forum.example/t/' || first_order, last_url) AS last_url FROM origin LEFT JOIN (
        SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) ON o_custkey = _id_origin"""))
def advance_last_url(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("origin_id")).agg(F.min("o_orderkey").alias("k"))
    url = F.concat(F.lit("https://forum.example/t/"), F.col("k").cast("string"))
    last = first.select("origin_id", url.alias("last_url"))
    return origins.advance_last_url(d.origin(spark, sf), last).select("_id_origin", "last_url")


# ---- table maintenance ---------------------------------------------------------------------

@register("upsert_author", with_ctes(["author"], """
    SELECT tag, username FROM author
    UNION ALL SELECT * FROM (
        SELECT DISTINCT 'Brand#' || p_size AS tag, p_name AS username FROM part WHERE p_partkey % 4 <> 0
        EXCEPT SELECT tag, username FROM author)
    UNION ALL SELECT NULL, p_name FROM part WHERE p_partkey % 4 = 0"""))
def upsert_author(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("Brand#"), F.col("p_size").cast("string")))
    new = table(spark, sf, "part").select(
        tag.alias("tag"), F.col("p_name").alias("username"), F.col("p_partkey").alias("row_key")
    )
    return tables.upsert_authors(d.author(spark, sf), new).select("tag", "username")


@register("insert_origin", with_ctes(["origin"], f"""
    , fresh AS (SELECT DISTINCT CAST(c_custkey % 3 AS INTEGER) AS category, c_name AS domain FROM customer
        EXCEPT SELECT category, domain FROM origin)
    SELECT category, domain, 0 AS is_dead_score, 'about ' || domain AS additional_infos,
           {stamp_sql(d.AS_OF_SQL)} AS updated_time FROM fresh"""))
def insert_origin(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    new = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 3).cast("int").alias("category"), name.alias("domain"),
        F.concat(F.lit("about "), name).alias("additional_infos"),
    )
    added, first = tables.add_origins(d.origin(spark, sf), new.union(new), as_of())
    return added.join(first, "_id_origin").select(
        "category", "domain", "is_dead_score", "additional_infos", stamp("updated_time").alias("updated_time")
    )


@register("insert_source_message", with_ctes(["messages"], """
    SELECT CAST(domain AS BIGINT) AS _id_origin, message_id AS _id_source_telegram, text AS message_text, views AS views_count
    FROM messages"""))
def insert_source_message(spark: SparkSession, sf: str) -> DataFrame:
    rows = d.messages(spark, sf).withColumn("_id_origin", F.col("domain").cast("bigint"))
    source, child = tables.split_messages(rows, as_of())
    return source.join(child, "_id_source").select("_id_origin", "_id_source_telegram", "message_text", "views_count")


@register("upsert_forum_path", with_ctes(["forum_path"], """
    SELECT c_custkey AS _id_origin, CASE WHEN c_custkey % 2 = 0 THEN 'b.x' ELSE p.next_page_path END AS next_page_path,
           CASE WHEN c_custkey % 2 = 0 THEN FALSE ELSE p.is_auto_generated END AS is_auto_generated
    FROM customer LEFT JOIN forum_path p ON p._id_origin = c_custkey WHERE c_custkey % 2 = 0 OR p._id_origin IS NOT NULL"""))
def upsert_forum_path(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0).select(
        F.col("c_custkey").alias("_id_origin"), *[F.lit("b.x").alias(c) for c in PATH_COLUMNS],
        F.lit(False).alias("is_auto_generated"),
    )
    return tables.upsert_paths(d.forum_path(spark, sf), new).select("_id_origin", "next_page_path", "is_auto_generated")


@register("cascade_delete", with_ctes(["data"], """
    SELECT _id_data FROM data WHERE _og_hashmd5 NOT IN (SELECT md5(n_name) FROM nation WHERE n_regionkey = 2)"""))
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.md5("n_name").alias("_og_hashmd5"))
    return tables.cascade_delete(d.data(spark, sf), gone).select("_id_data")


@register("cascade_delete_refused", with_ctes(["source"], """
    SELECT _id_origin, count(*) AS n FROM source WHERE _id_origin IN (SELECT c_custkey FROM customer) GROUP BY 1"""))
def cascade_delete_refused(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("_id_origin"))
    return tables.refused_deletes(keys, d.source(spark, sf), "_id_origin")


@register("reset_tables", """
    SELECT 'author' AS name, count(*) FILTER (FALSE) AS n FROM part UNION ALL
    SELECT 'origin', count(*) FILTER (FALSE) FROM customer""")
def reset_tables(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "reset")
    paths = {"author": f"{root}/author", "origin": f"{root}/origin"}
    d.author(spark, sf).write.parquet(paths["author"])
    d.origin(spark, sf).write.parquet(paths["origin"])
    tables.reset_tables(spark, paths)
    counts = [
        spark.read.parquet(p).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, p in paths.items()
    ]
    return counts[0].unionByName(counts[1])


# ---- audits --------------------------------------------------------------------------------

def _all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {
        "origin": d.origin(spark, sf), "author": d.author(spark, sf), "source": d.source(spark, sf),
        "source_thread": d.source_thread(spark, sf), "source_telegram": d.source_telegram(spark, sf),
        "database_metadata": d.metadata(spark, sf), "forum_path": d.forum_path(spark, sf),
        "data": d.data(spark, sf), "origin_history": d.history(spark, sf),
    }


_ALL = ["origin", "author", "source", "source_thread", "source_telegram", "metadata", "forum_path", "data", "history"]


@register("unique_violations", with_ctes(["author", "source_thread", "source_telegram"], """
    SELECT 'author(tag,username)' AS rule, tag || '|' || username AS key, count(*) AS n FROM author
    WHERE tag IS NOT NULL AND username IS NOT NULL GROUP BY tag, username HAVING count(*) > 1
    UNION ALL SELECT 'source_thread(url)', url, count(*) FROM source_thread GROUP BY url HAVING count(*) > 1
    UNION ALL SELECT 'source_telegram(_id_source_telegram,_id_source)', _id_source_telegram || '|' || _id_source, count(*)
    FROM source_telegram GROUP BY _id_source_telegram, _id_source HAVING count(*) > 1"""))
def unique_violations(spark: SparkSession, sf: str) -> DataFrame:
    return audit.unique_violations(_all_tables(spark, sf))


def _orphan_sql(name: str, child: str, fk: str, parent: str, pk: str) -> str:
    return (f"SELECT '{name}.{fk}' AS rule, CAST({fk} AS VARCHAR) AS key, count(*) AS n FROM {child}"
            f" WHERE {fk} IS NOT NULL AND {fk} NOT IN (SELECT {pk} FROM {parent}) GROUP BY {fk}")


@register("orphan_rows", with_ctes(_ALL, " UNION ALL ".join([
    _orphan_sql("source", "source", "_id_origin", "origin", "_id_origin"),
    _orphan_sql("source", "source", "_id_author", "author", "_id_author"),
    _orphan_sql("source_thread", "source_thread", "_id_source", "source", "_id_source"),
    _orphan_sql("source_telegram", "source_telegram", "_id_source", "source", "_id_source"),
    _orphan_sql("database_metadata", "metadata", "_id_source", "source", "_id_source"),
    _orphan_sql("forum_path", "forum_path", "_id_origin", "origin", "_id_origin"),
    _orphan_sql("data", "data", "_og_hashmd5", "metadata", "_og_hashmd5"),
    _orphan_sql("origin_history", "history", "_id_origin", "(SELECT * FROM origin WHERE _id_origin % 3 <> 0)", "_id_origin"),
])))
def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    every = _all_tables(spark, sf)
    history = audit.orphan_rows({
        "origin": every["origin"].filter(F.col("_id_origin") % 3 != 0), "origin_history": every.pop("origin_history"),
    })
    return audit.orphan_rows(every).unionByName(history)


@register("length_violations", with_ctes(["source_thread"], """
    SELECT 'source_thread.description:length' AS rule, '' AS key, count(*) AS n FROM source_thread
    WHERE length(description) > 65535 HAVING count(*) > 0
    UNION ALL SELECT 'source_telegram.message_text:length', '', count(*) FROM conversations WHERE length(text) > 4096 HAVING count(*) > 0
    UNION ALL SELECT 'author.tag:length', '', count(*) FROM documents WHERE length(text) > 255 HAVING count(*) > 0"""))
def length_violations(spark: SparkSession, sf: str) -> DataFrame:
    every = _all_tables(spark, sf)
    every["source_telegram"] = d.messages(spark, sf).select(F.col("text").alias("message_text"))
    every["author"] = table(spark, sf, "documents", "doc_id").select(F.col("text").alias("tag"))
    return audit.length_violations(every)


# ---- streams -------------------------------------------------------------------------------

@register("stream_messages", with_ctes(["messages", "channel"], """
    SELECT c._id_origin, m.message_id AS _id_source_telegram, m.text AS message_text
    FROM messages m JOIN channel c ON m.domain = c.domain
    WHERE m.message_id > coalesce(c.last_checked, 0) AND lower(m.file_name) LIKE '%.csv'"""))
def stream_messages(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "messages")
    landed = d.messages(spark, sf)
    landed.write.parquet(f"{root}/in/first")
    # Some messages arrive twice, in another file.
    landed.filter(F.col("message_id") % 2 == 0).write.parquet(f"{root}/in/second")
    stream = (
        spark.readStream.schema(streams.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 2)
        .option("recursiveFileLookup", "true").parquet(f"{root}/in")
    )
    channel = staged(d.channel(spark, sf), "channel")
    streams.stream_messages(stream, channel, f"{root}/out", f"{root}/state", as_of()).awaitTermination()
    source = streams.stored(spark, f"{root}/out", "source", TABLES["source"])
    child = streams.stored(spark, f"{root}/out", "source_telegram", TABLES["source_telegram"])
    return source.join(child, "_id_source").select("_id_origin", "_id_source_telegram", "message_text")


@register("stream_files", """
    SELECT c_mktsegment AS username, count(*) AS n FROM customer GROUP BY 1""")
def stream_files(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "files")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    # The folder is written twice, so every content comes in two files.
    for copy in ("a", "b"):
        even = rows.repartition(4, "c_mktsegment").sortWithinPartitions("c_custkey")
        even.write.option("header", True).csv(f"{root}/in/{copy}")
    query = streams.stream_files(spark, f"{root}/in/*", f"{root}/out", f"{root}/state", as_of(), DEFAULTS)
    query.awaitTermination()
    return streams.stored(spark, f"{root}/out", "data", TABLES["data"]).groupBy("username").agg(F.count("*").alias("n"))
