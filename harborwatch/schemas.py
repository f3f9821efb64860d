"""Table schemas and the integrity rules that go with them."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType, "INT": T.IntegerType, "STRING": T.StringType,
    "BOOLEAN": T.BooleanType, "TIMESTAMP": T.TimestampType,
}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name TYPE, ...`` without needing a running session."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (f.split() for f in spec.split(","))])


TABLES: dict[str, T.StructType] = {
    "origin": _struct(
        "_id_origin BIGINT, domain STRING, name STRING, is_dead_score INT, category INT,"
        " last_checked BIGINT, last_url STRING"
    ),
    "author": _struct("_id_author BIGINT, tag STRING, username STRING, description STRING"),
    "source": _struct(
        "_id_source BIGINT, spam_score INT, published_time TIMESTAMP, crawled_time TIMESTAMP,"
        " updated_time TIMESTAMP, _id_origin BIGINT, _id_author BIGINT"
    ),
    "source_thread": _struct(
        "_id_source_thread BIGINT, url STRING, title STRING, description STRING, replies_count INT,"
        " views_count INT, _id_source BIGINT"
    ),
    "source_telegram": _struct(
        "_id_source_telegram BIGINT, message_text STRING, views_count INT, shares_count INT,"
        " _id_source BIGINT"
    ),
    "database_metadata": _struct(
        "_og_hashmd5 STRING, name STRING, breach_time TIMESTAMP, og_filename STRING,"
        " is_hashed BOOLEAN, is_salted BOOLEAN, _id_source BIGINT"
    ),
    "forum_path": _struct(
        "_id_forum_path BIGINT, next_page_path STRING, table_body_path STRING, thread_link_path STRING,"
        " thread_title_path STRING, thread_description_path STRING,"
        " thread_pubblication_date_path STRING, is_auto_generated BOOLEAN, _id_origin BIGINT"
    ),
    "data": _struct(
        "_id_data BIGINT, email_address STRING, phone_number STRING, ip_address STRING,"
        " username STRING, misc STRING, _og_hashmd5 STRING"
    ),
    "origin_history": _struct(
        "_id_origin_history BIGINT, additional_infos STRING, updated_time TIMESTAMP, _id_origin BIGINT"
    ),
}

PATH_COLUMNS = [
    "next_page_path", "table_body_path", "thread_link_path",
    "thread_title_path", "thread_description_path", "thread_pubblication_date_path",
]
STANDARD_FIELDS = ["email_address", "phone_number", "ip_address", "username"]

# (table, key columns, nulls are distinct)
UNIQUE_RULES: list[tuple[str, list[str], bool]] = [
    ("origin", ["_id_origin"], False),
    ("author", ["_id_author"], False),
    ("author", ["tag", "username"], True),
    ("source", ["_id_source"], False),
    ("source_thread", ["_id_source_thread"], False),
    ("source_telegram", ["_id_source_telegram", "_id_source"], False),
    ("database_metadata", ["_og_hashmd5"], False),
    ("forum_path", ["_id_forum_path"], False),
    ("data", ["_id_data"], False),
    ("origin_history", ["_id_origin_history"], False),
    ("origin", ["category", "domain"], False),
    ("source_thread", ["url"], False),
]

# (child table, foreign key, parent table, parent key, rows go with the parent)
FOREIGN_KEYS: list[tuple[str, str, str, str, bool]] = [
    ("source", "_id_origin", "origin", "_id_origin", False),
    ("source", "_id_author", "author", "_id_author", False),
    ("source_thread", "_id_source", "source", "_id_source", False),
    ("source_telegram", "_id_source", "source", "_id_source", False),
    ("database_metadata", "_id_source", "source", "_id_source", False),
    ("forum_path", "_id_origin", "origin", "_id_origin", False),
    ("data", "_og_hashmd5", "database_metadata", "_og_hashmd5", True),
    ("origin_history", "_id_origin", "origin", "_id_origin", False),
]

# Fixed values: (table, column, longest allowed text or None, required).
LENGTH_RULES: list[tuple[str, str, int | None, bool]] = [
    ("origin", "domain", 255, True),
    ("origin", "name", 255, False),
    ("origin", "category", None, True),
    ("origin", "last_url", 1024, False),
    ("author", "tag", 255, False),
    ("author", "username", 255, True),
    ("author", "description", 255, False),
    ("source", "crawled_time", None, True),
    ("source", "updated_time", None, True),
    ("source", "_id_origin", None, True),
    ("source_thread", "url", 1023, True),
    ("source_thread", "title", 255, True),
    ("source_thread", "description", 65535, True),
    ("source_telegram", "message_text", 4096, True),
    ("database_metadata", "_og_hashmd5", 32, True),
    ("database_metadata", "name", 255, False),
    ("database_metadata", "og_filename", 255, False),
    *[("forum_path", c, 255, True) for c in PATH_COLUMNS],
    ("forum_path", "is_auto_generated", None, True),
    ("forum_path", "_id_origin", None, True),
    ("data", "email_address", 255, False),
    ("data", "phone_number", 63, False),
    ("data", "ip_address", 15, False),
    ("data", "username", 127, False),
    ("data", "_og_hashmd5", 32, True),
    ("origin_history", "additional_infos", 16383, False),
    ("origin_history", "updated_time", None, True),
    ("origin_history", "_id_origin", None, True),
]
