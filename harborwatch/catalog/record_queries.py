"""Queries on files, cells, standard records and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborwatch.catalog import derived as d
from harborwatch.catalog.registry import register, table
from harborwatch.functions import text as tx
from harborwatch.operators import records, search
from harborwatch.plans import ingest
from harborwatch.schemas import TABLES
from harborwatch.session import scratch_path, staged
from harborwatch.sources import csv_files


def _customer_csv(spark: SparkSession, sf: str, columns: list) -> str:
    """The customers as CSV files, each holding a run of keys in order."""
    path = scratch_path(spark, "customer-csv")
    rows = table(spark, sf, "customer").repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    rows.select(*columns).write.option("header", True).option("escape", '"').csv(path)
    return path


@register("csv_records", """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_custkey AS key_from_row_no, c_name,
           c_mktsegment || ',"x",' || chr(10) || chr(10) || 'on ' || c_nationkey AS note
    FROM customer""")
def csv_records(spark: SparkSession, sf: str) -> DataFrame:
    note = F.concat("c_mktsegment", F.lit(';"x",\n\non '), F.col("c_nationkey").cast("string"))
    path = _customer_csv(spark, sf, ["c_custkey", "c_name", note.alias("note")])
    rows = staged(csv_files.csv_records(spark, path), "rows")
    key = F.col("cells.c_custkey")
    # Keys are dense, so the first key of a file plus the row number must give the key.
    first = rows.groupBy("file").agg(F.min(key.cast("bigint")).alias("first"))
    return rows.join(first, "file").select(
        key.alias("c_custkey"), (F.col("first") + F.col("row_no")).alias("key_from_row_no"),
        F.col("cells.c_name").alias("c_name"), F.col("cells.note").alias("note"),
    )


@register("file_fingerprint", """
    SELECT 'dump/' || doc_id || '.csv' AS path, md5(text) AS _og_hashmd5, doc_id || '.csv' AS og_filename FROM documents""")
def file_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("dump/"), F.col("doc_id").cast("string"), F.lit(".csv"))
    files = table(spark, sf, "documents", "doc_id").select(name.alias("path"), F.encode("text", "UTF-8").alias("content"))
    return csv_files.fingerprint(files, d.as_of()).select("path", "_og_hashmd5", "og_filename")


_CUSTOMER_MISC = """json_object('c_custkey', CAST(c_custkey AS VARCHAR), 'c_name', c_name,
           'c_nationkey', CAST(c_nationkey AS VARCHAR))"""
_STANDARD_SQL = f"""
    SELECT CAST(NULL AS VARCHAR) AS email_address, CAST(NULL AS VARCHAR) AS phone_number,
           CAST(NULL AS VARCHAR) AS ip_address, c_mktsegment AS username,
           CAST({_CUSTOMER_MISC} AS VARCHAR) AS misc FROM customer"""


@register("ingest_directory", _STANDARD_SQL)
def ingest_directory(spark: SparkSession, sf: str) -> DataFrame:
    path = _customer_csv(spark, sf, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    none = spark.createDataFrame([], TABLES["database_metadata"])
    _, ok, _ = ingest.ingest_directory(spark, f"{path}/*.csv", none, d.as_of())
    return ok.select("email_address", "phone_number", "ip_address", "username", "misc")


_TESTS_SQL = {
    n: p.replace(r"\z", "$").replace(tx.WHITE_CLASS, r"\s").replace("'", "''") for n, p in tx.CELL_TESTS.items()
}


@register("cell_tests", "SELECT doc_id, " + ", ".join(
    f"count(*) FILTER (regexp_matches(cell, '{p}')) AS {n}" for n, p in _TESTS_SQL.items()
) + " FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS cell FROM documents) GROUP BY doc_id")
def cell_tests(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "documents", "doc_id").select("doc_id", F.explode(F.split("text", "[ \n]", -1)).alias("cell"))
    return cells.groupBy("doc_id").agg(*[F.count_if(tx.cell_test(n, F.col("cell"))).alias(n) for n in tx.CELL_TESTS])


# Two names for one column, and a column that is missing from some rows.
_MIXED_SQL = """
    SELECT c_custkey AS row_no, field, pos, cell FROM (
        SELECT c_custkey, unnest(['c_custkey', 'c_mktsegment', 'c_name', 'nick', 'segment_again']) AS field,
               unnest([0, 1, 2, 3, 4]) AS pos,
               unnest([CAST(c_custkey AS VARCHAR), c_mktsegment, c_name,
                       CASE WHEN c_custkey % 2 = 1 THEN 'undefined' ELSE 'n' || c_custkey END, c_mktsegment]) AS cell
        FROM customer WHERE c_custkey < 1000)"""


def _mixed_cells(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    base = F.create_map(
        F.lit("c_custkey"), key, F.lit("c_mktsegment"), F.col("c_mktsegment"), F.lit("c_name"), F.col("c_name")
    )
    nick = F.when(F.col("c_custkey") % 2 == 1, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("nick"), F.concat(F.lit("n"), key))
    )
    again = F.create_map(F.lit("segment_again"), F.col("c_mktsegment"))
    return table(spark, sf, "customer").select(
        F.lit("mixed").alias("file_hash"), F.col("c_custkey").alias("row_no"),
        F.map_concat(base, nick, again).alias("cells"),
    )


_MIXED_COUNTS = "SELECT test, pos, field, count(*) FILTER (hit) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS test, pos, field, regexp_matches(cell, '{p}') AS hit FROM ({_MIXED_SQL})"
    for n, p in _TESTS_SQL.items()
) + ") GROUP BY test, pos, field"


@register("field_match_counts", f"SELECT 'mixed' AS file_hash, test, pos, field, n FROM ({_MIXED_COUNTS})")
def field_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return records.field_match_counts(_mixed_cells(spark, sf))


_DECISION_TAIL = """
    SELECT file_hash, test,
           CASE WHEN max(n) = 0 THEN 'none' WHEN count(*) FILTER (n = top) > 1 THEN 'undecided' ELSE 'matched' END AS status,
           CASE WHEN max(n) > 0 AND count(*) FILTER (n = top) = 1 THEN max(field) FILTER (n = top) END AS field,
           max(n) AS n
    FROM (SELECT *, max(n) OVER (PARTITION BY file_hash, test) AS top FROM counts) GROUP BY file_hash, test"""


_PLAIN_COUNTS = "SELECT file_hash, test, field, count(*) FILTER (hit) AS n FROM (" + " UNION ALL ".join(
    f"SELECT 'customer' AS file_hash, '{n}' AS test, '{c}' AS field, regexp_matches(CAST({c} AS VARCHAR), '{p}') AS hit"
    f" FROM customer WHERE c_custkey < 1000"
    for n, p in _TESTS_SQL.items() for c in ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
) + ") GROUP BY ALL"


@register("field_decision", f"WITH counts AS (SELECT 'mixed' AS file_hash, test, field, n FROM ({_MIXED_COUNTS})"
          f" UNION ALL SELECT file_hash, test, field, n FROM ({_PLAIN_COUNTS}))" + _DECISION_TAIL)
def field_decision(spark: SparkSession, sf: str) -> DataFrame:
    cells = _mixed_cells(spark, sf).unionByName(d.customer_cells(spark, sf))
    return records.classify_fields(cells)


@register("fixes_apply", "SELECT c_custkey AS row_no, 'c_mktsegment' AS fix_username, c_mktsegment AS username FROM customer")
def fixes_apply(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.customer_cells(spark, sf)
    fixed = records.apply_fixes(cells, records.fixes_of(records.classify_fields(cells)))
    return fixed.select("row_no", "fix_username", F.col("cells")[F.col("fix_username")].alias("username"))


@register("misc_json", f"SELECT c_custkey AS row_no, CAST({_CUSTOMER_MISC} AS VARCHAR) AS misc FROM customer")
def misc_json(spark: SparkSession, sf: str) -> DataFrame:
    return d.customer_cells(spark, sf).select(
        "row_no", records.misc_json(F.col("cells"), F.array(F.lit("c_mktsegment"))).alias("misc")
    )


@register("standardize_records", _STANDARD_SQL.replace("SELECT", "SELECT c_custkey AS row_no,", 1))
def standardize_records(spark: SparkSession, sf: str) -> DataFrame:
    cells = d.customer_cells(spark, sf)
    fixes = records.fixes_of(records.classify_fields(cells))
    return records.standardize_records(cells, fixes).drop("file_hash")


@register("records_search_flow", f"SELECT * FROM ({_STANDARD_SQL}) WHERE username ILIKE '%MACH%'")
def records_search_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Cells to fields to standard records to a search on one of them."""
    cells = d.customer_cells(spark, sf)
    rows = records.standardize_records(cells, records.fixes_of(records.classify_fields(cells)))
    return search.search_records(rows.drop("file_hash", "row_no"), ["username"], "MACH")


@register("register_file", """
    SELECT min(doc_id) AS doc_id, md5(text) AS _og_hashmd5 FROM documents
    WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) GROUP BY md5(text)""")
def register_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id").select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.md5("text").alias("_og_hashmd5")
    )
    known = docs.filter(F.col("doc_id") % 10 == 0)
    return records.new_files(docs, known).select("doc_id", "_og_hashmd5")


_LONG_SQL = """SELECT p_partkey AS row_no, p_brand || p_type AS _og_hashmd5, repeat(p_name, p_size) AS username FROM part"""


def _long_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_no"), F.concat("p_brand", "p_type").alias("_og_hashmd5"),
        F.repeat("p_name", F.col("p_size")).alias("username"),
    )


@register("insert_records", f"""
    WITH r AS ({_LONG_SQL})
    SELECT 'reference' AS semantics, row_no, _og_hashmd5 NOT IN (SELECT _og_hashmd5 FROM r WHERE length(username) > 127) AS ok FROM r
    UNION ALL SELECT 'intended', row_no, length(username) <= 127 FROM r""")
def insert_records(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for semantics in ("reference", "intended"):
        ok, bad = records.quarantine(_long_rows(spark, sf), semantics=semantics)
        for rows, flag in ((ok, True), (bad, False)):
            parts.append(rows.select(F.lit(semantics).alias("semantics"), "row_no", F.lit(flag).alias("ok")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("insert_records_append", d.with_ctes(["data"], "SELECT left(_og_hashmd5, 2) AS hash_prefix, _id_data, username FROM data"))
def insert_records_append(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "data")
    for _ in range(2):  # the second run of a load replaces the first
        records.append_records(d.data(spark, sf), path, "first")
    back = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    return back.select(F.lpad(F.col("hash_prefix").cast("string"), 2, "0").alias("hash_prefix"), "_id_data", "username")


# ---- search --------------------------------------------------------------------------------

@register("search_records", d.with_ctes(["data"], """
    SELECT * FROM data WHERE email_address ILIKE '%er.0000%1%' OR ip_address ILIKE '%er.0000%1%' OR misc ILIKE '%er.0000%1%'"""))
def search_records(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_records(d.data(spark, sf), ["email_address", "ip_address", "misc"], "er.0000%1")


@register("search_records_literal", d.with_ctes(["data"], "SELECT _id_data FROM data WHERE contains(misc, '0%')"))
def search_records_literal(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_records(d.data(spark, sf), ["misc"], "0%", literal=True).select("_id_data")


@register("search_threads", d.with_ctes(["source_thread"], """
    SELECT _id_source_thread, url FROM source_thread WHERE title ILIKE '%TH_N%' OR description ILIKE '%TH_N%'"""))
def search_threads(spark: SparkSession, sf: str) -> DataFrame:
    found = search.search_threads(d.source_thread(spark, sf), ["title", "description"], "TH_N")
    return found.select("_id_source_thread", "url")


_ALL_SQL = d.with_ctes(["data", "source_thread"], """
    SELECT 'data' AS kind, _id_data AS id,
           concat_ws(',', CASE WHEN username ILIKE '%in%' THEN 'username' END, CASE WHEN misc ILIKE '%in%' THEN 'misc' END) AS matched
    FROM data WHERE username ILIKE '%in%' OR misc ILIKE '%in%'
    UNION ALL
    SELECT 'thread', _id_source_thread, 'description' FROM source_thread WHERE description ILIKE '%in%'""")


def _all_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_all(d.data(spark, sf), d.source_thread(spark, sf), ["username", "misc", "description"], "in")


@register("search_all", _ALL_SQL)
def search_all(spark: SparkSession, sf: str) -> DataFrame:
    return _all_hits(spark, sf).select("kind", "id", F.array_join("matched_fields", ",").alias("matched"))


@register("search_counts", f"SELECT kind, count(*) AS n FROM ({_ALL_SQL}) GROUP BY kind")
def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_counts(_all_hits(spark, sf))


# The watch-list: every benchmark text, region names, nation names and event kinds.
@register("search_batch", """
    WITH terms AS (SELECT text AS term FROM benchmark UNION SELECT r_name FROM region
                   UNION SELECT n_name FROM nation UNION SELECT event_type FROM events)
    SELECT doc_id, term FROM documents, terms WHERE contains(lower(text), lower(term))""")
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    terms = (
        table(spark, sf, "benchmark").select(F.col("text").alias("term"))
        .union(table(spark, sf, "region").select("r_name"))
        .union(table(spark, sf, "nation").select("n_name"))
        .union(table(spark, sf, "events").select("event_type").distinct())
    )
    return search.search_batch(table(spark, sf, "documents", "doc_id"), ["doc_id"], "text", terms)


# A long list with short terms: whole words of the benchmark texts, and the texts themselves.
@register("search_batch_long_list", """
    SELECT DISTINCT conv_id, turn, term FROM conversations, (SELECT DISTINCT word AS term FROM (
        SELECT unnest(string_split(lower(text), ' ')) AS word FROM benchmark UNION ALL SELECT lower(text) FROM benchmark) WHERE word <> '')
    WHERE contains(lower(text), term)""")
def search_batch_long_list(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "benchmark").select(F.lower("text").alias("text"))
    terms = texts.select(F.explode(F.split("text", " ", -1)).alias("term")).union(texts)
    rows = table(spark, sf, "conversations", "conv_id")
    return search.search_batch(rows, ["conv_id", "turn"], "text", terms).distinct()
