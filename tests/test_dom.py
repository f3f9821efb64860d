"""Tree rules, cleaning, paths and selectors."""

import pytest
from pyspark.sql import functions as F

from harborwatch.functions.html_fold import fold_page
from harborwatch.operators import dom


@pytest.fixture(scope="module")
def page(spark):
    def run(html, clean=False, with_html=False):
        df = spark.createDataFrame([(1, html)], "page_id long, html string")
        return dom.page_frame(df, ["page_id"], clean=clean, with_html=with_html)

    return run


@pytest.fixture(scope="module")
def cleaned(page):
    return lambda html: page(html, clean=True, with_html=True).collect()[0]["clean_html"]


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b", "<p>a</p><p>b</p>"),
    ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"),
    ("<table><tr><td>1<td>2<tr><td>3</table>",
     "<table><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></tbody></table>"),
    ("<table><td>1</table>", "<table><tbody><tr><td>1</td></tr></tbody></table>"),
    ("<p><b>x<p>y", "<p><b>x</b></p><p><b>y</b></p>"),
    ("<p><b>x</b><p>y", "<p><b>x</b></p><p>y</p>"),
    ("<a href=1>A<a href=2>B</a>", '<a href="1">A</a><a href="2">B</a>'),
    ("<table><tr><td><b>x</table>y", "<table><tbody><tr><td><b>x</b></td></tr></tbody></table>y"),
    ("a<br>b<hr>c", "a<br>b<hr>c"),
    ("a</p>b", "a<p></p>b"),
    ("<h1>a<h2>b</h2>", "<h1>a</h1><h2>b</h2>"),
    ("<dl><dt>a<dd>b</dl>", "<dl><dt>a</dt><dd>b</dd></dl>"),
    ("<table>x<tr><td>1</table>", "x<table><tbody><tr><td>1</td></tr></tbody></table>"),
    ("a < b & c &lt; &copy;", "a &lt; b &amp; c &lt; ©"),
    ("a\n\t b", "a b"),
    ("<div title='a>b'>x</div>", '<div title="a&gt;b">x</div>'.replace("&gt;", ">")),
    ('<a href="?a=1&copy=2&amp;b=3&section=4">x</a>', '<a href="?a=1&amp;copy=2&amp;b=3&amp;section=4">x</a>'),
    ("a<script>b</i>", "a"),
    ("a<!-- b <p>c", "a<!-- b <p>c</body>-->"),
    ("a<div title='" + "x" * 50_000 + "'>b", "a<div title='" + "x" * 50_000 + "'>b</div>"),
    ("x<!-- c -->y", "x<!-- c -->y"),
])
def test_tree_rules(cleaned, html, want):
    assert cleaned(f"<body>{html}</body>") == f"<body>{want.replace(chr(39), chr(34))}</body>"


def test_tag_cut_off_by_the_end_is_dropped(cleaned):
    assert cleaned('<p>a</p><div class="x') == "<body><p>a</p></body>"
    assert cleaned("<p>a</p") == "<body><p>a</p></body>"
    assert cleaned("a < ") == "<body>a &lt; </body>"


@pytest.mark.parametrize("html,want", [
    ('<div id="i" on="x" style="s" class="c" onclick="k">t</div>', '<div class="c" onclick="k">t</div>'),
    ('<div class="x mobilenav">gone</div><i class="Mobile">kept</i>', '<i class="Mobile">kept</i>'),
    ("<nav>n</nav><header>h</header><p>a<img src=x>b</p><footer>f</footer>", "<p>ab</p>"),
    ('<script>var t="</p>";</script><style>p{}</style>x', "x"),
    ("<p>a <img> b</p>", "<p>a b</p>"),
])
def test_cleaning(cleaned, html, want):
    assert cleaned(f"<html><head><title>t</title></head><body>{html}</body></html>") == f"<body>{want}</body>"


def test_head_is_dropped_and_body_class_mobile_empties_the_page(cleaned):
    assert cleaned("<head><meta charset=x><title>t</title></head><p>x") == "<body><p>x</p></body>"
    assert cleaned('<body class="mobile">x</body>') == ""
    assert cleaned('<html class="no-mobile js"><body>x</body></html>') == ""
    assert cleaned('<html class="js"><body>x</body></html>') == "<body>x</body>"
    assert cleaned("") == "<body></body>"


def test_null_page_gives_the_bare_tree(page):
    row = page(None).collect()[0]
    assert [n["tag"] for n in row["nodes"]] == ["html", "head", "body"]


def test_nodes_are_numbered_in_document_order():
    nodes, texts, _ = fold_page(["<div>", "a", "<p>", "b", "</p>", "c", "</div>", "<i>", "d"], clean=False)
    got = [(n["no"], n["parent"], n["last"], n["tag"], "".join(texts[n["t0"]:n["t1"]])) for n in nodes]
    assert got == [
        (0, -1, 5, "html", "abcd"), (1, 0, 1, "head", ""), (2, 0, 5, "body", "abcd"),
        (3, 2, 4, "div", "abc"), (4, 3, 4, "p", "b"), (5, 2, 5, "i", "d"),
    ]
    assert [texts[i] for i in nodes[3]["own"]] == ["a", "c"]


LIST = '<body><div class=" a  b "><table><tr><td class="t"><span><a class="s" href="1">x</a></span></td></tr></table></div></body>'


def test_paths(page):
    rows = {r["tag"]: r for r in dom.node_rows(page(LIST), ["page_id"]).collect()}
    assert rows["a"]["css_path"] == "td.t span a.s"
    assert rows["a"]["row_path"] == "td.t span a.s"
    assert rows["td"]["row_path"] == "td.t"
    assert rows["tr"]["row_path"] == "table tbody tr"
    assert rows["div"]["css_path"] == "html body div.a.b"


@pytest.mark.parametrize("selector,want", [
    ("a", ["x"]), ("a.s", ["x"]), ("a.z", []), ("div.b a", ["x"]), ("div.b.a tr a.s", ["x"]), ("td div a", []),
    ("body body a", []), ("", []), ("span a a", []), ("html body div.a table tbody tr td.t span a", ["x"]),
])
def test_select_by_path(page, selector, want):
    got = dom.select_by_path(page(LIST), ["page_id"], F.lit(selector)).collect()
    assert [r["text"] for r in got] == want


def test_child_text_reads_children_twice_as_written(page):
    frame = page("<body><div>o<p>a<i>deep</i></p>n<p>b</p></div></body>")
    div = F.filter("nodes", lambda n: n["tag"] == "div")
    for intended, want in ((False, "on" + "ab" + "ab"), (True, "on" + "ab" + "deep")):
        expr = F.transform(div, lambda n: dom.child_text(F.col("nodes"), F.col("texts"), n, 2, intended))
        assert frame.select(expr.alias("t")).collect()[0]["t"] == [want]


def test_size_report(spark):
    df = spark.createDataFrame([("o", "<p>a   b</p>"), ("o", "<nav>x</nav>")], "origin string, html string")
    row = dom.size_report(df, ["origin"]).collect()[0]
    assert (row["chars_before"], row["chars_after"]) == (12 + 12, len("<body><p>a b</p></body>") + len("<body></body>"))


def test_tokens_put_together_give_the_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    joined = pages.select("html", F.array_join(dom.page_tokens(F.col("html")), "").alias("again"))
    assert joined.filter("html <> again").count() == 0


def test_scores_are_not_repeated_by_filters(spark):
    """The vote drops empty paths above the score, not below it."""
    from harborwatch.operators import infer

    df = spark.createDataFrame([(1, 0, "u", "<p>x</p>")], "origin_id long, page_no long, url string, html string")
    frame = dom.page_frame(df, ["origin_id", "page_no", "url"])
    plan = infer.thread_table(frame, ["origin_id"])._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter (" in line and "tbody" in line]
    assert "MapInArrow" in plan and not filters
