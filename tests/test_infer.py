"""Structure inference and extraction on small forums."""

import pytest
from pyspark.sql import functions as F

from harborwatch.config import Settings
from harborwatch.operators import dom, extract, infer
from harborwatch.plans.skew import SALTS_CONF

PAGES = "origin_id long, page_no long, url string, html string"


def rows_table(n, link="Thread number {i} here", cls="list"):
    rows = "".join(f'<tr><td><a class="s" href="/t/{i}">{link.format(i=i)}</a></td></tr>' for i in range(n))
    return f'<table class="{cls}">{rows}</table>'


def page(body, no=0, origin=1):
    return (origin, no, f"https://f.example/list?p={no}", f"<html><body>{body}</body></html>")


@pytest.fixture(scope="module")
def frame(spark):
    def run(*pages):
        return dom.page_frame(spark.createDataFrame(list(pages), PAGES), ["origin_id", "page_no", "url"])

    return run


def table_path(frame, body, **kw):
    return infer.table_page_paths(frame(page(body)), **kw).collect()[0]["path"]


@pytest.mark.parametrize("n,wins", [(15, False), (16, True), (39, True), (40, False)])
def test_table_needs_16_to_39_rows(frame, n, wins):
    got = table_path(frame, rows_table(3, cls="head") + rows_table(n))
    assert got == ("body table.list tbody" if wins else "body table.head tbody")


def test_blocks_are_used_without_tables(frame):
    rows = "<div>r</div>" * 20
    assert table_path(frame, f'<div class="a"><div class="b">{rows}</div></div>') == "body div.a div.b"
    assert table_path(frame, "<p>nothing</p>") == ""


def test_table_keywords_count_only_when_intended(frame):
    body = rows_table(20, "other {i}", "first") + rows_table(20, "database leak {i}", "second")
    assert table_path(frame, body) == "body table.first tbody"
    assert table_path(frame, body, semantics="intended") == "body table.second tbody"


def test_vote_tie_goes_to_the_first_page_whatever_the_partitioning(spark):
    votes = [(1, p, path) for p, path in enumerate(["b", "a", "", "a", "b"])]
    for parts in (1, 5):
        df = spark.createDataFrame(votes, "origin_id long, page_no long, path string").repartition(parts)
        won = infer.vote_winner(infer.path_votes(df, ["origin_id"], ["page_no"]), ["origin_id"]).collect()
        assert [(r["path"], r["n"]) for r in won] == [("b", 2)]


def test_link_vote_is_per_row_then_per_page(spark, frame):
    short = rows_table(20, "n{i}") .replace("</td></tr>", '</td><td><a href="/u">member with a long name</a></td></tr>')
    tables = spark.createDataFrame([(1, "body table.list tbody")], "origin_id long, path string")
    pages = [page(short, 0), page(rows_table(20), 1), page(rows_table(20), 2)]
    per_page = infer.link_page_paths(frame(*pages).withColumn("table_body_path", F.lit("body table.list tbody")))
    assert {r["page_no"]: r["path"] for r in per_page.collect()} == {0: "td a", 1: "td a.s", 2: "td a.s"}
    won = infer.thread_link(frame(*pages), tables, ["origin_id"]).collect()
    assert [(r["path"], r["n"]) for r in won] == [("td a.s", 2)]


def test_rows_without_link_do_not_vote(frame):
    body = '<table class="list"><tr><td>x</td></tr></table>'
    got = infer.link_page_paths(frame(page(body)).withColumn("table_body_path", F.lit("table.list tbody"))).collect()
    assert got[0]["path"] == ""


@pytest.mark.parametrize("body,path,link", [
    ('<a href="https://f.example/1">one</a><a class="n" href="https://f.example/2">Next &gt;</a>', "html body a.n", "https://f.example/2"),
    # Without a word: the siblings of the second list are rising numbers.
    ('<i><a href="https://f.example/x">x</a></i><div class="p"><b>1</b><b>2</b><a href="https://f.example/3">go</a></div>',
     "body div.p a", "https://f.example/3"),
    # The path is looked up again from the top of the page.
    ('<div class="p"><a href="https://f.example/first">x</a><a href="https://f.example/n">avanti</a></div>',
     "body div.p a", "https://f.example/first"),
    ("<p>no links</p>", "", ""),
])
def test_next_page(frame, body, path, link):
    row = infer.next_page(frame(page(body)), ["origin_id"]).collect()[0]
    assert (row["path"], row["link"]) == (path, link)


def test_relative_next_link_loses_as_written(frame):
    body = '<a class="r" href="/list?p=2">next</a><a class="o" href="https://f.example/">home</a>'
    paths = {s: infer.next_page(frame(page(body)), ["origin_id"], semantics=s).collect()[0]["path"] for s in ("reference", "intended")}
    # next: +100-50-50-100 = -100; home: -150. Resolved, the next link is at 0.
    assert paths == {"reference": "html body a.r", "intended": "html body a.r"}
    farther = body.replace("next", "go")
    assert infer.next_page(frame(page(farther)), ["origin_id"]).collect()[0]["path"] == "html body a.o"


def as_of():
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


def field_paths(spark, html, title="A fine title", **kw):
    df = spark.createDataFrame([(1, title, html)], "origin_id long, link_title string, html string")
    fr = dom.page_frame(df, ["origin_id", "link_title"])
    return {r["role"]: (r["path"], r["score"]) for r in infer.thread_page_paths(fr, ["origin_id"], as_of(), **kw).collect()}


def test_thread_fields(spark):
    html = f'<body><h1>T</h1><abbr>2023-01-01 10:00:00</abbr><div class="m"><p>{"x" * 301}</p></div></body>'
    got = field_paths(spark, html)
    assert got["title"] == ("html body h1", 150)
    assert got["description"] == ("body div.m p", 150)
    assert got["date"] == ("html body abbr", 100 + 50 + 150)


def test_block_text_counts_children_twice(spark):
    # 151 characters: the block reads 302 of them (+100) and its paragraph 151 (50 - 100).
    got = field_paths(spark, f'<body><div class="m"><p>{"x" * 151}</p></div></body>')
    assert got["description"] == ("html body div.m", 100)
    intended = field_paths(spark, f'<body><div class="m"><p>{"x" * 151}</p></div></body>', semantics="intended")
    assert intended["description"] == ("body div.m p", -50)


def test_title_tie_goes_to_document_order(spark):
    assert field_paths(spark, '<body><h2 class="a">x</h2><h1>y</h1></body>')["title"][0] == "html body h2.a"


def test_future_date_scores_low(spark):
    html = "<body><span>2030-01-01 10:00:00</span></body>"
    assert field_paths(spark, html)["date"] == ("html body span", 50 + 50 + 50 - 100 + 50)


def test_midnight_in_the_date_score(spark):
    df = spark.createDataFrame([(1, "t", "<body><span>1 January, 2024 - 12:05 AM</span></body>")], "origin_id long, link_title string, html string")
    fr = dom.page_frame(df, ["origin_id", "link_title"])
    morning = F.to_timestamp(F.lit("2024-01-01 06:00:00"))

    def score(semantics):
        rows = infer.thread_page_paths(fr, ["origin_id"], morning, semantics=semantics).filter("role = 'date'").collect()
        return rows[0]["score"]

    # As written it is noon, after the time of the capture: -100 in place of 50.
    assert score("intended") - score("reference") == 150


def test_midnight_in_an_extracted_thread(spark):
    html = THREAD.format(title="One", date="14 March, 2023 - 12:05 AM", body="text")
    got = {s: extract_all(spark, [("u1", html)], semantics=s).collect()[0]["published_time"].hour for s in ("reference", "intended")}
    assert got == {"reference": 12, "intended": 0}


def test_page_without_candidates(spark):
    assert field_paths(spark, "<body><i>x</i></body>")["title"][0] == ""


def test_overrides_replace_all_three_paths(spark):
    cols = "origin_id long, thread_title_path string, thread_description_path string, thread_pubblication_date_path string"
    inferred = spark.createDataFrame([(1, "a", "b", "c"), (2, "d", "e", "f")], cols)
    own = spark.createDataFrame([(2, "x", None, "z")], cols)
    got = {r[0]: tuple(r)[1:] for r in infer.apply_overrides(inferred, own, ["origin_id"]).collect()}
    assert got == {1: ("a", "b", "c"), 2: ("x", None, "z")}


def test_infer_site_samples_the_first_pages(spark):
    pages = [page(rows_table(20), n) for n in range(2)] + [page(rows_table(20, cls="late"), n) for n in range(4, 9)]
    threads = spark.createDataFrame(
        [(1, 0, i, "Thread", f"<h1>Thread {i}</h1><p>{'x' * 400}</p>") for i in range(3)],
        "origin_id long, page_no long, pos long, link_title string, html string",
    )
    got = infer.infer_site(spark.createDataFrame(pages, PAGES), threads, as_of(), settings=Settings(explore_pages=4)).collect()
    assert len(got) == 1
    assert got[0]["table_body_path"] == "body table.list tbody"
    assert got[0]["thread_link_path"] == "td a.s"
    assert got[0]["thread_title_path"] == "html body h1"
    assert got[0]["thread_description_path"] == "html body p"


PATHS = "origin_id long, table_body_path string, thread_link_path string, next_page_path string"


def scrape(spark, pages, last_url):
    paths = spark.createDataFrame([(1, "table.list tbody", "td a.s", "a.next")], PATHS)
    origin = spark.createDataFrame([(1, last_url)], "origin_id long, last_url string")
    links, forward, last = extract.thread_list_scrape(spark.createDataFrame(pages, PAGES), paths, origin)
    return (
        [(r["page_no"], r["link"]) for r in links.orderBy("page_no", "pos").collect()],
        [r["next_url"] for r in forward.collect()],
        [r["last_url"] for r in last.collect()],
    )


def two_pages():
    nxt = '<a class="next" href="?p=1">next</a>'
    second = rows_table(8).replace("/t/", "/t/1")
    return [page(rows_table(7) + nxt, 0), page(second, 1)]


@pytest.mark.parametrize("last_url,count", [
    (None, 15), ("https://f.example/t/none", 15), ("https://f.example/t/12", 9), ("https://f.example/t/0", 0),
])
def test_links_until_the_known_one(spark, last_url, count):
    links, forward, last = scrape(spark, two_pages(), last_url)
    assert len(links) == count
    assert forward == ["https://f.example/list?p=1"]
    assert last == ["https://f.example/t/5"]


def test_short_first_page_keeps_last_url(spark):
    _, forward, last = scrape(spark, [page(rows_table(5), 0)], None)
    assert (forward, last) == ([], [])


def test_links_do_not_depend_on_salting(spark):
    spark.conf.set(SALTS_CONF, "1")
    one = scrape(spark, two_pages(), "https://f.example/t/12")
    spark.conf.set(SALTS_CONF, "7")
    assert scrape(spark, two_pages(), "https://f.example/t/12") == one
    spark.conf.unset(SALTS_CONF)


THREAD = '<h1> {title} </h1><abbr>{date}</abbr><div class="m"><p>{body}</p><p>more</p></div>'


def extract_all(spark, pages, known=(), **kw):
    df = spark.createDataFrame([(1, u, h) for u, h in pages], "origin_id long, url string, html string")
    paths = spark.createDataFrame(
        [(1, "h1", "div.m p", "abbr")],
        "origin_id long, thread_title_path string, thread_description_path string, thread_pubblication_date_path string",
    )
    stored = spark.createDataFrame([(u,) for u in known], "url string")
    return extract.thread_extract(df, paths, stored, as_of(), **kw)


def test_thread_extract(spark):
    pages = [
        ("u1", THREAD.format(title="One", date="posted 13/4/2021 5:07", body="text")),
        ("u2", THREAD.format(title="Two", date="never", body="text")),
        ("u3", THREAD.format(title=" ", date="", body="text")),  # no title
        ("u4", "<h1>Four</h1>"),  # no description
        ("u5", THREAD.format(title="Five", date="", body="text")),  # stored already
        ("u1", THREAD.format(title="One", date="posted 13/4/2021 5:07", body="text")),  # captured twice
    ]
    rows = sorted(extract_all(spark, pages, ["u5"]).collect(), key=lambda r: r["url"])
    assert [(r["url"], r["title"], r["description"]) for r in rows] == [("u1", "One", "textmore"), ("u2", "Two", "textmore")]
    assert rows[0]["published_time"].strftime("%Y-%m-%d %H:%M") == "2021-04-13 05:07"
    assert rows[1]["published_time"] is None


def test_split_threads_share_their_key(spark):
    pages = [("u1", THREAD.format(title="One", date="", body="x" * 70000))]
    source, thread = extract.split_threads(extract_all(spark, pages))
    s, t = source.collect()[0], thread.collect()[0]
    assert s["_id_source"] == t["_id_source"] and s["spam_score"] == 0 and s["_id_author"] is None
    assert len(t["description"]) == 65535
