"""The engine's tables derived from the shared test tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.catalog.registry import table

AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF_TEXT))


def stamp(c: Column | str) -> Column:
    """A time as text, the way STAMP_SQL writes it."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def with_ctes(names: list[str], body: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" + body


CTES: dict[str, str] = {}

CTES["origin"] = """
    SELECT c_custkey AS _id_origin, c_name AS domain, c_mktsegment AS name,
           CAST(c_custkey % 4 AS INTEGER) AS is_dead_score, CAST(c_nationkey % 3 AS INTEGER) AS category,
           CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 7 END AS last_checked,
           CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'https://forum.example/t/' || c_custkey END AS last_url
    FROM customer"""


def origin(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("_id_origin"), F.col("c_name").alias("domain"), F.col("c_mktsegment").alias("name"),
        (c % 4).cast("int").alias("is_dead_score"), (F.col("c_nationkey") % 3).cast("int").alias("category"),
        F.when(c % 5 != 0, c % 7).alias("last_checked"),
        F.when(c % 2 != 0, F.concat(F.lit("https://forum.example/t/"), c.cast("string"))).alias("last_url"),
    )


# Times are cut to the hour so that ties occur.
CTES["history"] = """
    SELECT event_id AS _id_origin_history, event_type AS additional_infos,
           date_trunc('hour', ts) AS updated_time, user_id AS _id_origin
    FROM events"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("_id_origin_history"), F.col("event_type").alias("additional_infos"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("updated_time"),
        F.col("user_id").alias("_id_origin"),
    )


CTES["forum_path"] = """
    SELECT c_custkey AS _id_forum_path, 'a.next' || c_nationkey AS next_page_path,
           'table.t' || c_nationkey || ' tbody' AS table_body_path, 'td a' AS thread_link_path,
           'h1.t' || c_custkey AS thread_title_path, 'div p' AS thread_description_path,
           'abbr' AS thread_pubblication_date_path, TRUE AS is_auto_generated, c_custkey AS _id_origin
    FROM customer WHERE c_custkey % 10 <> 9"""


def forum_path(spark: SparkSession, sf: str) -> DataFrame:
    c, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    return table(spark, sf, "customer").filter(c % 10 != 9).select(
        c.alias("_id_forum_path"), F.concat(F.lit("a.next"), n).alias("next_page_path"),
        F.concat(F.lit("table.t"), n, F.lit(" tbody")).alias("table_body_path"),
        F.lit("td a").alias("thread_link_path"),
        F.concat(F.lit("h1.t"), c.cast("string")).alias("thread_title_path"),
        F.lit("div p").alias("thread_description_path"),
        F.lit("abbr").alias("thread_pubblication_date_path"), F.lit(True).alias("is_auto_generated"),
        c.alias("_id_origin"),
    )


CTES["source"] = """
    SELECT o_orderkey AS _id_source, 0 AS spam_score, o_orderdate AS published_time,
           o_orderdate AS crawled_time, o_orderdate AS updated_time, o_custkey AS _id_origin,
           CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 500 END AS _id_author
    FROM orders"""


def source(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        k.alias("_id_source"), F.lit(0).alias("spam_score"), d.alias("published_time"),
        d.alias("crawled_time"), d.alias("updated_time"), F.col("o_custkey").alias("_id_origin"),
        F.when(k % 3 != 0, k % 500).alias("_id_author"),
    )


CTES["author"] = """
    SELECT p_partkey AS _id_author, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS tag,
           p_name AS username, p_type AS description
    FROM part"""


def author(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("_id_author"), F.when(k % 11 != 0, F.col("p_brand")).alias("tag"),
        F.col("p_name").alias("username"), F.col("p_type").alias("description"),
    )


CTES["source_telegram"] = """
    SELECT l_linenumber AS _id_source_telegram, l_returnflag || l_linestatus AS message_text,
           CAST(l_quantity AS INTEGER) AS views_count, l_linenumber AS shares_count, l_orderkey AS _id_source
    FROM lineitem"""


def source_telegram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("_id_source_telegram"),
        F.concat("l_returnflag", "l_linestatus").alias("message_text"),
        F.col("l_quantity").cast("int").alias("views_count"), F.col("l_linenumber").alias("shares_count"),
        F.col("l_orderkey").alias("_id_source"),
    )


CTES["source_thread"] = """
    SELECT doc_id AS _id_source_thread, 'https://forum.example/t/' || doc_id % 900 AS url,
           source || ' ' || lang AS title, text AS description, CAST(NULL AS INTEGER) AS replies_count,
           CAST(NULL AS INTEGER) AS views_count, doc_id AS _id_source
    FROM documents"""


def source_thread(spark: SparkSession, sf: str) -> DataFrame:
    d, none = F.col("doc_id"), F.lit(None).cast("int")
    return table(spark, sf, "documents", "doc_id").select(
        d.alias("_id_source_thread"),
        F.concat(F.lit("https://forum.example/t/"), (d % 900).cast("string")).alias("url"),
        F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("description"),
        none.alias("replies_count"), none.alias("views_count"), d.alias("_id_source"),
    )


CTES["metadata"] = """
    SELECT md5(n_name) AS _og_hashmd5, n_name AS name, TIMESTAMP '2024-01-01' AS breach_time,
           n_name || '.csv' AS og_filename, CAST(NULL AS BOOLEAN) AS is_hashed,
           CAST(NULL AS BOOLEAN) AS is_salted, CAST(n_regionkey AS BIGINT) AS _id_source
    FROM nation"""


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("boolean")
    return table(spark, sf, "nation").select(
        F.md5("n_name").alias("_og_hashmd5"), F.col("n_name").alias("name"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("breach_time"),
        F.concat("n_name", F.lit(".csv")).alias("og_filename"), none.alias("is_hashed"),
        none.alias("is_salted"), F.col("n_regionkey").cast("bigint").alias("_id_source"),
    )


CTES["data"] = """
    SELECT c_custkey AS _id_data, lower(replace(c_name, '#', '.')) || '@example.com' AS email_address,
           '555-0100-' || right(c_name, 4) AS phone_number,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '192.0.2.' || c_custkey % 256 END AS ip_address,
           c_mktsegment AS username,
           '{"nation":"' || n_name || '","balance":"' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || '%"}' AS misc,
           md5(n_name) AS _og_hashmd5
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def data(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    whole = F.rint("c_acctbal").cast("bigint").cast("string")
    return joined.select(
        c.alias("_id_data"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email_address"),
        F.concat(F.lit("555-0100-"), F.right("c_name", F.lit(4))).alias("phone_number"),
        F.when(c % 4 != 0, F.concat(F.lit("192.0.2."), (c % 256).cast("string"))).alias("ip_address"),
        F.col("c_mktsegment").alias("username"),
        F.concat(F.lit('{"nation":"'), "n_name", F.lit('","balance":"'), whole, F.lit('%"}')).alias("misc"),
        F.md5("n_name").alias("_og_hashmd5"),
    )


# A channel message per conversation turn; every third one carries a file.
CTES["messages"] = """
    SELECT CAST(conv_id AS VARCHAR) AS domain, turn AS message_id, text,
           CAST(length(text) AS INTEGER) AS views, CAST(turn AS INTEGER) AS forwards,
           CASE WHEN (conv_id + turn) % 3 = 0 THEN 'dump' || turn || CASE WHEN turn % 2 = 0 THEN '.CSV' ELSE '.csv.zip' END
           END AS file_name
    FROM conversations"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    ending = F.when(t % 2 == 0, ".CSV").otherwise(".csv.zip")
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("domain"), t.alias("message_id"), as_of().alias("ts"), "text",
        F.length("text").alias("views"), t.cast("int").alias("forwards"),
        F.when((F.col("conv_id") + t) % 3 == 0, F.concat(F.lit("dump"), t.cast("string"), ending)).alias("file_name"),
    )


CTES["channel"] = """
    SELECT conv_id AS _id_origin, CAST(conv_id AS VARCHAR) AS domain,
           CASE WHEN conv_id % 3 = 0 THEN NULL ELSE conv_id % 4 END AS last_checked
    FROM (SELECT DISTINCT conv_id FROM conversations)"""


def channel(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("conv_id")
    return table(spark, sf, "conversations").select("conv_id").distinct().select(
        c.alias("_id_origin"), c.cast("string").alias("domain"), F.when(c % 3 != 0, c % 4).alias("last_checked")
    )


# Checks of the origins: an error is a failed one; those of the first half of a day find stale data.
CTES["checks"] = """
    SELECT user_id AS _id_origin, ts, event_type <> 'error' AS reachable, hour(ts) < 12 AS stale FROM events"""


def checks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("_id_origin"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") != "error").alias("reachable"), (F.hour("ts") < 12).alias("stale"),
    )


# The customers as the rows of one file, all cells text.
def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    names = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("string"))]
    return table(spark, sf, "customer").select(
        F.lit("customer").alias("file_hash"), F.col("c_custkey").alias("row_no"), F.create_map(*pairs).alias("cells")
    )
