"""Page-structure inference: score elements inside each page, then vote over the pages of an origin.

Scoring and the pick of the best element happen inside the page row. A vote counts one path per page
(or per thread) with a partial aggregate, so an origin with a third of all pages sends only its
distinct paths from each input partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.config import BIG, DEFAULTS, MID, NEXT_PAGE_WORDS, Settings, check_semantics
from harborwatch.functions.text import (
    description_score, js_trim, keyword_score, ordered_numbers, title_score,
)
from harborwatch.functions.dates import date_score
from harborwatch.functions.urls import resolve_url, url_host
from harborwatch.operators import dom
from harborwatch.plans.skew import fence, spread_join
from harborwatch.session import staged

CANDIDATES = ["h1", "h2", "p", "pre", "span", "abbr", "section", "div", "article"]
BODY_TAGS = ["p", "pre", "section"]
ROLES = ["title", "description", "date"]
ROW_MIN, ROW_MAX = 15, 40


def _nodes() -> Column:
    return F.col("nodes")


def _texts() -> Column:
    return F.col("texts")


def path_votes(winners: DataFrame, by: list[str], order: list[str], path: str = "path") -> DataFrame:
    """Votes per path with the place of the first vote; empty paths do not vote."""
    named = fence(winners.select(*by, *order, F.col(path).alias("path")))
    return (
        named.filter(F.col("path") != "")
        .groupBy(*by, "path")
        .agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_seen"))
    )


def vote_winner(votes: DataFrame, by: list[str]) -> DataFrame:
    """The path with most votes; among equals the one voted for first."""
    best = F.min(F.struct((-F.col("n")).alias("less"), "first_seen", "path")).alias("w")
    return votes.groupBy(*by).agg(best).select(*by, F.col("w.path").alias("path"), (-F.col("w.less")).alias("n"))


def node_argmax(scored: DataFrame, by: list[str], score: str = "score", order: str = "node_no") -> DataFrame:
    """The row of the highest score per group; the first in document order among equals."""
    rest = [c for c in scored.columns if c not in (*by, score, order)]
    best = F.max(F.struct(F.col(score), (-F.col(order)).alias("first"), *rest)).alias("b")
    return scored.groupBy(*by).agg(best).select(
        *by, F.col(f"b.{score}").alias(score), (-F.col("b.first")).alias(order), *[F.col(f"b.{c}") for c in rest]
    )


def _winner_path(picked: Column, path: Callable[[Column], Column] = dom.css_path) -> Column:
    """Path of the element a ``best_node`` struct points at; empty where there was no candidate."""
    return F.coalesce(dom.let(F.get(_nodes(), (-picked["first"]).cast("int")), path), F.lit(""))


def _steps_of(column: str) -> Column:
    return dom.selector_steps(F.col(column))


# ---- list pages ----------------------------------------------------------------------------

def table_page_paths(frame: DataFrame, settings: Settings = DEFAULTS, semantics: str = "reference") -> DataFrame:
    """Adds ``path``: the element of each page that looks most like its table of threads.

    Candidates are the table bodies, or without any, all ``div``; +100 for 16 to 39 rows, else -100,
    plus keyword points for the rows' text.
    """
    intended = check_semantics(semantics)

    def rows_of(n: Column) -> Column:
        return F.when(n["tag"] == "tbody", F.filter(dom.below(_nodes(), n), lambda x: x["tag"] == "tr")).otherwise(
            F.filter(dom.below(_nodes(), n), lambda x: (x["parent"] == n["no"]) & (x["tag"] == "div"))
        )

    def row_blob(row: Column) -> Column:
        kids = dom.children(_nodes(), row)
        first = F.get(kids, F.lit(0))
        text = F.array_join(F.transform(kids, lambda k: dom.node_text(_texts(), k)), "")
        return F.concat(text, F.coalesce(dom.attr_text(first), F.lit("")))

    def score(n: Column) -> Column:
        count = F.size(rows_of(n))
        points = F.when((count > ROW_MIN) & (count < ROW_MAX), BIG).otherwise(-BIG)
        if intended:  # as written, keyword points are 0 here for every text
            blob = F.array_join(F.transform(rows_of(n), row_blob), "")
            points = points + keyword_score(blob, settings.good_words, settings.bad_words, semantics=semantics)
        return F.when(n["last"] > n["no"], points).otherwise(-BIG)

    bodies = F.filter(_nodes(), lambda n: n["tag"] == "tbody")
    blocks = F.filter(_nodes(), lambda n: n["tag"] == "div")
    found = F.when(F.size(bodies) > 0, bodies).otherwise(blocks)
    picked = frame.withColumn("__best", dom.best_node(found, score))
    return picked.withColumn("path", _winner_path(F.col("__best"), lambda n: dom.css_path(n, settings.path_parents))).drop("__best")


def thread_table(frame: DataFrame, by: list[str], settings: Settings = DEFAULTS, semantics: str = "reference") -> DataFrame:
    """Per origin the voted path of the thread table: ``(*by, path, n)``."""
    paths = table_page_paths(frame, settings, semantics).select(*by, "page_no", "path")
    return vote_winner(path_votes(paths, by, ["page_no"]), by)


def link_page_paths(frame: DataFrame, settings: Settings = DEFAULTS, semantics: str = "reference") -> DataFrame:
    """Adds ``path``: the in-row path most rows of the page give to their thread link.

    ``frame`` carries ``table_body_path``. Every row picks one of its links: -50 for a text under 15
    characters, plus keyword points.
    """
    intended = check_semantics(semantics)

    def score(n: Column) -> Column:
        text = dom.node_text(_texts(), n)
        points = F.when(F.length(text) < 15, -MID).otherwise(0)
        if intended:
            points = points + keyword_score(
                F.concat(text, dom.attr_text(n)), settings.good_words, settings.bad_words, semantics=semantics
            )
        return points

    def row_path(row: Column) -> Column:
        links = F.filter(dom.below(_nodes(), row), lambda x: x["tag"] == "a")
        return _winner_path(dom.best_node(links, score), lambda n: dom.css_path_in_row(n, settings.path_parents))

    tables, rows = F.col("__tables"), F.col("__rows")
    in_table = F.col("table_body_path").contains("tbody")
    nested = F.filter(
        _nodes(),
        lambda x: (x["tag"] == "tr") & F.exists(tables, lambda t: (x["no"] > t["no"]) & (x["no"] <= t["last"])),
    )
    direct = F.filter(
        _nodes(), lambda x: (x["tag"] == "div") & F.exists(tables, lambda t: x["parent"] == t["no"])
    )
    paths = F.col("__paths")
    distinct = F.array_distinct(paths)
    ranked = F.transform(
        distinct, lambda p, i: F.struct(F.size(F.filter(paths, lambda q: q == p)).alias("n"), (-i).alias("first"), p.alias("p"))
    )
    return (
        frame.withColumn("__steps", _steps_of("table_body_path"))
        .withColumn("__tables", dom.select_nodes(_nodes(), F.col("__steps")))
        .withColumn("__rows", F.when(in_table, nested).otherwise(direct))
        .withColumn("__paths", F.filter(F.transform(rows, row_path), lambda p: p != ""))
        .withColumn("path", F.coalesce(F.array_max(ranked)["p"], F.lit("")))
        .drop("__steps", "__tables", "__rows", "__paths")
    )


def thread_link(
    frame: DataFrame, tables: DataFrame, by: list[str], settings: Settings = DEFAULTS, semantics: str = "reference"
) -> DataFrame:
    """Per origin the voted path from a table row to its thread link: ``(*by, path, n)``."""
    joined = spread_join(frame, tables.select(*by, F.col("path").alias("table_body_path")), by, ["page_no"])
    paths = link_page_paths(joined, settings, semantics).select(*by, "page_no", "path")
    return vote_winner(path_votes(paths, by, ["page_no"]), by)


def next_page(frame: DataFrame, keep: list[str], url: str = "url", settings: Settings = DEFAULTS, semantics: str = "reference") -> DataFrame:
    """The path of the next-page link of each page, and the address it gives: ``(*keep, path, link)``.

    +5 when the siblings hold rising page numbers; +100 or -50 for each word of the dictionary;
    -100 when the address lacks the host (intended: after resolving it).
    """
    intended = check_semantics(semantics)

    def numbered(n: Column) -> Column:
        around = F.array_join(
            F.transform(dom.siblings(_nodes(), n), lambda s: js_trim(dom.node_text(_texts(), s))), ""
        )
        return ordered_numbers(around)

    def base(n: Column, host: Column) -> Column:
        text = F.lower(dom.node_text(_texts(), n))
        points = F.lit(0)
        for word in NEXT_PAGE_WORDS:
            points = points + F.when(text.contains(word), BIG).otherwise(-MID)
        href = F.coalesce(F.try_element_at(n["attrs"], F.lit("href")), F.lit(""))
        seen = resolve_url(href, F.col(url)) if intended else href
        return points + F.when((href != "") & ~seen.contains(host), -BIG).otherwise(0)

    def winner(best: Column) -> Column:
        """The numbers' points are smaller than any other step, so they only decide between links of
        the best other score, in page order up to the first that has them. Siblings are read only
        below parents with two digits in their text."""
        parents = F.array_distinct(F.transform(best, lambda n: n["parent"]))
        counted = F.filter(
            parents, lambda p: dom.node_text(_texts(), F.get(_nodes(), p)).rlike("[0-9][^0-9]*[0-9]")
        )

        def first_numbered(ids: Column) -> Column:
            return F.aggregate(
                best, F.lit(-1),
                lambda found, n: F.when(found >= 0, found).when(
                    F.array_contains(ids, n["parent"]), F.when(numbered(n), n["no"]).otherwise(-1)
                ).otherwise(-1),
            )

        return dom.let(
            dom.let(counted, first_numbered), lambda no: F.when(no >= 0, no).otherwise(F.get(best, F.lit(0))["no"])
        )

    def pick(links: Column) -> Column:
        scored = dom.let(
            url_host(F.col(url)),
            lambda host: F.transform(
                links, lambda n: F.struct(n["no"].alias("no"), n["parent"].alias("parent"), base(n, host).alias("base"))
            ),
        )

        def keep_best(all_: Column) -> Column:
            top = F.array_max(F.transform(all_, lambda n: n["base"]))
            return dom.let(top, lambda t: F.filter(all_, lambda n: n["base"] == t))

        return dom.let(dom.let(scored, keep_best), winner)

    links = F.filter(_nodes(), lambda n: n["tag"] == "a")
    return (
        frame.withColumn("__best", dom.let(links, pick))
        .withColumn("path", F.coalesce(
            dom.let(F.get(_nodes(), F.col("__best")), lambda n: dom.css_path(n, settings.path_parents)), F.lit("")
        ))
        .withColumn("__steps", _steps_of("path"))
        .select(
            *keep, "path",
            F.coalesce(dom.selected_attr(_nodes(), F.col("__steps"), "href"), F.lit("")).alias("link"),
        )
    )


def list_frame(pages: DataFrame, paths: DataFrame, by: list[str]) -> DataFrame:
    """Parsed list pages with their origin's paths. The paths meet the raw page, which is far
    smaller than its elements; below the broadcast threshold no page is shuffled at all."""
    names = ["table_body_path", "thread_link_path", "next_page_path"]
    joined = spread_join(pages, paths.select(*by, *names), by, ["page_no"])
    return dom.page_frame(joined, [*by, "page_no", "url", *names])


def explore_links(frame: DataFrame, by: list[str]) -> DataFrame:
    """Every thread link of a ``list_frame`` with its position, resolved address and text."""
    steps = dom.selector_steps(F.concat_ws(" ", "table_body_path", F.coalesce("thread_link_path", F.lit(""))))
    found = frame.withColumn("__steps", steps).select(
        *by, "page_no", "url", "texts", F.posexplode_outer(dom.select_nodes(_nodes(), F.col("__steps"))).alias("pos", "n")
    ).filter(F.col("pos").isNotNull())
    href = F.try_element_at(F.col("n.attrs"), F.lit("href"))
    return found.select(
        *by, "page_no", "pos",
        resolve_url(href, F.col("url")).alias("link"),
        dom.node_text(_texts(), F.col("n")).alias("link_title"),
    )


# ---- thread pages --------------------------------------------------------------------------

def field_scores(n: Column, title: Column, as_of: Column, settings: Settings, semantics: str) -> Column:
    """Title, description and date scores of one candidate element as a struct."""
    intended = check_semantics(semantics)
    tag = n["tag"]
    head, body = tag.isin("h1", "h2"), tag.isin(*BODY_TAGS)
    body_kids = F.filter(dom.children(_nodes(), n), lambda k: k["tag"].isin(*BODY_TAGS))
    kids_text = F.array_join(F.transform(body_kids, lambda k: dom.node_text(_texts(), k)), "")
    good, bad = settings.good_words, settings.bad_words

    def title_and_short(text: Column) -> Column:
        short = F.when(F.length(text) < 60, MID).otherwise(0)
        return F.struct(short.alias("short"), title_score(text, title, good, bad, 1, semantics).alias("words"))

    def scores(t: Column) -> Column:
        about = dom.child_text(_nodes(), _texts(), n, 2, intended)
        return F.struct(
            (F.when(head, BIG).when(tag == "span", MID).otherwise(0) + t["short"] + t["words"]).alias("title"),
            (F.when(head, -BIG).when(tag == "span", -MID).when(body, MID).otherwise(0)
             + dom.let(about, lambda a: description_score(a, title, good, bad, semantics))).alias("description"),
            (F.when(head, -BIG).when(tag == "span", MID).when(tag == "abbr", BIG).otherwise(0) + t["short"]
             + date_score(dom.own_text(_texts(), n), as_of, semantics)).alias("date"),
        )

    text = js_trim(F.when(tag == "div", kids_text).otherwise(dom.node_text(_texts(), n)))
    return dom.let(dom.let(text, title_and_short), scores)


def thread_page_paths(
    frame: DataFrame, keep: list[str], as_of: Column, settings: Settings = DEFAULTS, semantics: str = "reference"
) -> DataFrame:
    """Per thread page and role the path of the best element: ``(*keep, role, path, score)``."""
    found = F.filter(_nodes(), lambda n: n["tag"].isin(*CANDIDATES))
    scored = F.transform(
        found,
        lambda n: F.struct(n["no"].alias("no"), field_scores(n, F.col("link_title"), as_of, settings, semantics).alias("s")),
    )

    def best(role: str) -> Column:
        top = F.array_max(
            F.transform(F.col("__scored"), lambda x: F.struct(x["s"][role].alias("s"), (-x["no"]).alias("first")))
        )
        path = _winner_path(top, lambda n: dom.css_path(n, settings.path_parents))
        return F.struct(F.lit(role).alias("role"), path.alias("path"), top["s"].alias("score"))

    return (
        frame.withColumn("__scored", scored)
        .select(*keep, F.explode(F.array(*[best(r) for r in ROLES])).alias("b"))
        .select(*keep, "b.role", "b.path", "b.score")
    )


def thread_fields(
    frame: DataFrame, by: list[str], order: list[str], as_of: Column, settings: Settings = DEFAULTS,
    semantics: str = "reference",
) -> DataFrame:
    """Votes for the title, description and date paths: ``(*by, role, path, n, first_seen)``."""
    paths = thread_page_paths(frame, [*by, *order], as_of, settings, semantics)
    return path_votes(paths, [*by, "role"], order)


def thread_field_winners(votes: DataFrame, by: list[str]) -> DataFrame:
    """One row per origin with the three winning paths."""
    won = vote_winner(votes, [*by, "role"])

    def pick(role: str, name: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("path"))).alias(name)

    return won.groupBy(*by).agg(
        pick("title", "thread_title_path"),
        pick("description", "thread_description_path"),
        pick("date", "thread_pubblication_date_path"),
    )


def apply_overrides(inferred: DataFrame, overrides: DataFrame, by: list[str]) -> DataFrame:
    """Operator-chosen thread paths replace all three inferred ones where present."""
    names = ["thread_title_path", "thread_description_path", "thread_pubblication_date_path"]
    chosen = overrides.select(*by, F.lit(True).alias("__o"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = inferred.join(chosen, by, "left")
    return joined.select(
        *[
            F.when(F.col("__o"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c)
            for c in inferred.columns
        ]
    )


def infer_site(
    list_pages: DataFrame,
    thread_pages: DataFrame,
    as_of: Column,
    overrides: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    semantics: str = "reference",
) -> DataFrame:
    """All six paths of every origin.

    The sample pages are parsed once and written to the shared folder, since three scorers read them.

    ``list_pages``: ``origin_id, page_no, url, html``; ``thread_pages``: ``origin_id, page_no, pos,
    link_title, html`` in the order the links were found.
    """
    by = ["origin_id"]
    sample = list_pages.filter(F.col("page_no") < settings.explore_pages)
    frame = staged(dom.page_frame(sample, ["origin_id", "page_no", "url"]), "list-pages")
    first = frame.filter(F.col("page_no") == 0)
    forward = next_page(first, by, settings=settings, semantics=semantics)
    tables = thread_table(frame, by, settings, semantics)
    links = thread_link(frame, tables, by, settings, semantics)
    threads = dom.page_frame(thread_pages, ["origin_id", "page_no", "pos", "link_title"])
    votes = thread_fields(threads, by, ["page_no", "pos"], as_of, settings, semantics)
    inferred = (
        tables.select(*by, F.col("path").alias("table_body_path"))
        .join(links.select(*by, F.col("path").alias("thread_link_path")), by, "left")
        .withColumn("thread_link_path", F.coalesce("thread_link_path", F.lit("")))
        .join(forward.select(*by, F.col("path").alias("next_page_path")), by, "left")
        .join(thread_field_winners(votes, by), by, "left")
        .withColumn("is_auto_generated", F.lit(True))
    )
    return apply_overrides(inferred, overrides, by) if overrides is not None else inferred
