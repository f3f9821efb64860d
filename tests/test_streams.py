"""Streams: twice is once, late ids are skipped, stored rows are not repeated."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from harborwatch.schemas import TABLES
from harborwatch.streaming import streams

NOW = datetime(2024, 1, 31)


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def messages(*rows):
    return [(d, m, NOW, f"text {m}", 1, 2, f) for d, m, f in rows]


def test_messages(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    origin = spark.createDataFrame([(1, "ch", 2), (2, "-1000000000001", None)], "_id_origin long, domain string, last_checked long")

    def land(rows):
        spark.createDataFrame(messages(*rows), streams.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(streams.MESSAGE_SCHEMA).parquet(src)
        streams.stream_messages(stream, origin, out, state, as_of()).awaitTermination()
        child = streams.stored(spark, out, "source_telegram", TABLES["source_telegram"]).collect()
        source = streams.stored(spark, out, "source", TABLES["source"]).collect()
        assert {r["_id_source"] for r in child} == {r["_id_source"] for r in source} and len(child) == len(source)
        marks = {r["_id_origin"]: r["last_checked"] for r in streams.published_checkpoint(spark, origin, out).collect()}
        return sorted(r["_id_source_telegram"] for r in child), marks

    land([("ch", 1, "late.csv"), ("ch", 3, "A.CSV"), ("ch", 3, "A.CSV"), ("ch", 4, "a.csv.zip"), ("ch", 5, None),
          ("-1000000000001", 1, "x.csv"), ("unknown", 9, "x.csv")])
    assert run() == ([1, 3], {1: 5, 2: 1})
    assert run() == ([1, 3], {1: 5, 2: 1})
    land([("ch", 3, "A.CSV"), ("ch", 4, "late.csv"), ("ch", 6, "b.csv"), ("ch", 7, None)])  # 4 isn't stored, but late
    assert run() == ([1, 3, 6], {1: 7, 2: 1})


def test_pages(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    paths = spark.createDataFrame(
        [(1, "h1", "p", "abbr")],
        "origin_id long, thread_title_path string, thread_description_path string, thread_pubblication_date_path string",
    )

    def land(*urls):
        rows = [(1, u, f"<h1>{u}</h1><p>body</p><abbr>2023-01-01</abbr>") for u in urls]
        spark.createDataFrame(rows, streams.PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(streams.PAGE_SCHEMA).parquet(src)
        streams.stream_pages(stream, paths, out, state, as_of()).awaitTermination()
        return sorted(r["url"] for r in streams.stored(spark, out, "source_thread", TABLES["source_thread"]).collect())

    land("a", "b", "a")
    assert run() == ["a", "b"]
    land("b", "c")
    assert run() == ["a", "b", "c"]
    source = streams.stored(spark, out, "source", TABLES["source"])
    assert source.count() == 3 and source.filter("published_time is null").count() == 0


def test_files(spark, tmp_path):
    src, out, state = (tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state")
    src.mkdir()

    def run(**kw):
        streams.stream_files(spark, str(src), out, state, as_of(), **kw).awaitTermination()
        data = streams.stored(spark, out, "data", TABLES["data"]).collect()
        meta = streams.stored(spark, out, "database_metadata", streams.META_SCHEMA).collect()
        return sorted((r["email_address"], r["username"]) for r in data), sorted(r["og_filename"] for r in meta)

    (src / "a.csv").write_text("m,u\na@example.com,neo\n")
    (src / "b.CSV").write_text("m,u\na@example.com,neo\n")
    (src / "c.txt").write_text("m,u\nc@example.com,ann\n")
    assert run() == ([("a@example.com", "neo")], ["a.csv"])
    (src / "d.csv").write_text("m,u\na@example.com,neo\n")
    (src / "e [f]{1}.csv").write_text("u;m\ntrinity;b@example.com\n")
    assert run() == ([("a@example.com", "neo"), ("b@example.com", "trinity")], ["a.csv", "e [f]{1}.csv"])


def test_files_longer_than_a_binary_cell(spark, tmp_path):
    import hashlib

    from harborwatch.sources import csv_files

    src, out, state = (tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state")
    src.mkdir()
    texts = {"a.csv": "m,u\na@example.com,neo\n", "b c+.csv": "m,u\n" + "".join(f"x{i}@example.com,ann{i}\n" for i in range(9))}
    texts["turned.csv"] = texts["b c+.csv"].replace("x1@example.com,ann1\nx2@example.com,ann2", "x2@example.com,ann2\nx1@example.com,ann1")
    texts["same.csv"] = texts["b c+.csv"]
    texts["crlf.csv"] = texts["same.csv"].replace("\n", "\r\n")
    texts["cr.csv"] = texts["same.csv"].replace("\n", "\r")
    texts["no last feed.csv"] = texts["same.csv"][:-1]
    texts["blank line.csv"] = texts["same.csv"] + "\n"
    texts["mark.csv"] = "\ufeff" + texts["same.csv"]
    for name, text in texts.items():
        (src / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "60")
    try:
        got = {r["og_filename"]: r["_og_hashmd5"] for r in csv_files.file_fingerprint(spark, str(src), as_of()).collect()}
        streams.stream_files(spark, str(src), out, state, as_of()).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert set(got) == set(texts)
    assert got["a.csv"] == hashlib.md5(texts["a.csv"].encode()).hexdigest()
    assert got["b c+.csv"] == got["same.csv"] != got["turned.csv"]
    data = streams.stored(spark, out, "data", TABLES["data"])
    assert len(set(got.values())) == len(texts) - 1  # all but the copy are files of their own, and all are loaded
    assert data.count() == 1 + 7 * 9 and data.select("_id_data").distinct().count() == 1 + 7 * 9


def test_list_pages(spark, tmp_path, one_partition):
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    paths = spark.createDataFrame([(1, "ul", "a", "b.next")], "origin_id long, table_body_path string, thread_link_path string, next_page_path string")
    origin = spark.createDataFrame([(1, None)], "origin_id long, last_url string")

    def land(first):
        items = "".join(f'<li><a href="https://f.example/t/{n}">thread {n}</a></li>' for n in range(first, 0, -1))
        rows = [(1, 0, "https://f.example/list", f"<ul>{items}</ul>")]
        spark.createDataFrame(rows, streams.LIST_PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(streams.LIST_PAGE_SCHEMA).parquet(src)
        streams.stream_list_pages(stream, paths, origin, out, state).awaitTermination()
        links = streams.stored(spark, out, "links", streams.LINK_SCHEMA)
        last = streams.stored(spark, out, "last_urls", streams.LAST_URL_SCHEMA)
        return sorted(int(r["link"].rsplit("/", 1)[1]) for r in links.collect()), sorted(r["last_url"][-2:] for r in last.collect())

    land(8)
    assert run() == ([1, 2, 3, 4, 5, 6, 7, 8], ["/3"])
    land(10)  # up to thread 3, which was known; the stored ones aren't repeated
    assert run() == ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], ["/3", "/5"])


@pytest.fixture()
def one_partition(spark):
    """One state store a query: opening one takes far longer than what these tests put in it."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _landing(spark, tmp_path, last_url=None):
    """Functions that land pages (number, threads on it) of origin 1 and run the stream; its links and last urls."""
    src, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    paths = spark.createDataFrame([(1, "ul", "a", "b.next")], "origin_id long, table_body_path string, thread_link_path string, next_page_path string")
    origin = spark.createDataFrame([(1, last_url)], "origin_id long, last_url string")

    def land(*pages, at=1):
        rows = [(at, no, f"https://f.example/list?{no}", "<ul>" + "".join(f'<li><a href="https://f.example/t/{n}">t</a></li>' for n in on) + "</ul>")
                for no, on in pages]
        spark.createDataFrame(rows, streams.LIST_PAGE_SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def run(idle_ms=3_600_000):
        stream = spark.readStream.schema(streams.LIST_PAGE_SCHEMA).parquet(src)
        streams.stream_list_pages(stream, paths, origin, out, state, idle_ms=idle_ms).awaitTermination()
        links = streams.stored(spark, out, "links", streams.LINK_SCHEMA).filter("origin_id = 1").collect()
        last = spark.read.parquet(f"{out}/last_urls").filter("origin_id = 1").orderBy("batch").collect()
        return sorted((r["page_no"], r["pos"], int(r["link"].rsplit("/", 1)[1])) for r in links), [r["last_url"].rsplit("/", 1)[1] for r in last]

    return land, run


PAGES = [(0, range(40, 30, -1)), (1, range(30, 20, -1)), (2, range(20, 10, -1)), (3, range(10, 0, -1))]


def test_a_crawl_in_three_batches_gives_what_one_gives(spark, tmp_path, one_partition):
    known = "https://f.example/t/17"
    land, run = _landing(spark, tmp_path / "one", known)
    land(*PAGES)
    want = run()
    assert [n for _, _, n in want[0]] == list(range(40, 17, -1)) and want[1] == ["35"]
    for k, parts in enumerate([[PAGES[:1], PAGES[1:2], PAGES[2:]], [PAGES[3:], PAGES[:2], PAGES[2:3]]]):
        land, run = _landing(spark, tmp_path / f"parts{k}", known)
        for part in parts:
            land(*part)
            got = run()
        assert got == want


def test_the_next_crawl_ends_where_the_one_before_began(spark, tmp_path, one_partition):
    land, run = _landing(spark, tmp_path)
    land(*PAGES[:2])
    assert len(run()[0]) == 20
    # Thread 35 is known; its page lands before the first one of the new crawl, and later pages don't bring old links.
    land((1, [37, 36, 35, 34, 33, 5]))
    assert len(run()[0]) == 20
    land((0, [46, 45, 44, 43, 42, 41, 40, 39, 38]), (2, [4, 3]))
    links, last = run()
    assert sorted(n for _, _, n in links) == list(range(21, 47)) and last == ["35", "41"]
    land(*PAGES)  # a first page whose sixth link is older moves the mark all the same, and nothing is stored twice
    links, last = run()
    assert len(links) == len({n for _, _, n in links}) and last[-1] == "35"


def test_pages_behind_a_missing_one_come_when_the_crawl_ends(spark, tmp_path, one_partition):
    land, run = _landing(spark, tmp_path)
    land(PAGES[0], PAGES[2])
    assert len(run()[0]) == 10  # page 1 is missing
    land((0, [50, 49, 48, 47, 46, 45, 44]))
    assert sorted(n for _, _, n in run()[0]) == [*range(11, 21), *range(31, 41), *range(44, 51)]


def test_an_idle_crawl_ends(spark, tmp_path, one_partition):
    land, run = _landing(spark, tmp_path)
    land(PAGES[0], PAGES[2])
    assert len(run(idle_ms=1)[0]) == 10
    land((0, [1]), at=2)  # any batch lets the timer go off
    assert len(run(idle_ms=1)[0]) == 20


def test_register_order_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        streams.stream_files(spark, str(tmp_path), "o", "s", as_of(), register="never")
