"""Pages as arrays of element rows, and what can be asked of them.

A page frame holds one row per page: its key columns plus ``nodes`` (elements in document order) and
``texts`` (text pieces in document order). The elements below a node are the array slice up to its
``last`` number and its text is the slice ``t0..t1`` of ``texts``, so every question about one page
is answered inside its row: no join, no shuffle. Only votes over many pages shuffle, and those send
one row per page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborwatch.functions.html_fold import fold_page
from harborwatch.functions.text import let

# Comments, script and style whole (to the end of the page when not closed), then tags (quoted values
# may hold ">"), a tag cut off by the end of the page, text, and a lone "<". Possessive loops keep long
# tokens off the stack.
TOKEN_PATTERN = (
    r"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script\s*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style\s*>|\z)"
    r"|</?[a-z](?:[^=>\"']++|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+>|</?[a-z][^>]*\z|<[!?][^>]*>|[^<]+|<"
)

_STRINGS = T.ArrayType(T.StringType())
NODE_TYPE = T.StructType([
    T.StructField("no", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("last", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("path", _STRINGS),
    T.StructField("t0", T.IntegerType()),
    T.StructField("t1", T.IntegerType()),
    T.StructField("own", T.ArrayType(T.IntegerType())),
])
_ARROW_NODE = pa.struct([
    ("no", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("path", pa.list_(pa.string())),
    ("t0", pa.int32()), ("t1", pa.int32()), ("own", pa.list_(pa.int32())),
])
_ROWS_PER_BATCH = 64


def page_tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN_PATTERN), F.lit(0))


def html_tokens(pages: DataFrame, key: list[str], html: str = "html") -> DataFrame:
    """One row per token: its number, kind, tag and text."""
    t = F.col("token")
    kind = (
        F.when(t.startswith("<!--"), "comment")
        .when(t.rlike(r"(?i)^<(script|style)[\s/>]"), "raw")
        .when(t.rlike(r"^</[a-zA-Z]"), "close")
        .when(t.rlike(r"^<[a-zA-Z]"), "open")
        .when(t.rlike(r"^<[!?]"), "declaration")
        .otherwise("text")
    )
    tag = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    return pages.select(*key, F.posexplode(page_tokens(F.col(html))).alias("token_no", "token")).select(
        *key, "token_no", kind.alias("kind"), tag.alias("tag"), "token"
    )


def page_frame(
    pages: DataFrame, keep: list[str], html: str = "html", clean: bool = True, with_html: bool = False
) -> DataFrame:
    """Key columns, ``nodes`` and ``texts`` of every page; the one Arrow stage of the library.

    ``clean`` drops heads, menus, media and the like first; ``with_html`` adds ``clean_html``.
    """
    kept = pages.select(*keep, page_tokens(F.coalesce(F.col(html), F.lit(""))).alias("__tokens"))
    fields = [f for f in kept.schema.fields if f.name != "__tokens"]
    out = T.StructType([
        *fields,
        T.StructField("nodes", T.ArrayType(NODE_TYPE)),
        T.StructField("texts", _STRINGS),
        *([T.StructField("clean_html", T.StringType())] if with_html else []),
    ])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_PER_BATCH):
                part = batch.slice(at, _ROWS_PER_BATCH)
                folded = [fold_page(tokens, clean, with_html) for tokens in part.column("__tokens").to_pylist()]
                arrays = [part.column(f.name) for f in fields]
                arrays.append(pa.array([f[0] for f in folded], pa.list_(_ARROW_NODE)))
                arrays.append(pa.array([f[1] for f in folded], pa.list_(pa.string())))
                if with_html:
                    arrays.append(pa.array([f[2] for f in folded], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out.fields])

    return kept.mapInArrow(fold, out)


# ---- questions inside one page -------------------------------------------------------------

def below(nodes: Column, n: Column) -> Column:
    """The elements below a node, in document order."""
    return F.slice(nodes, n["no"] + 2, n["last"] - n["no"])


def children(nodes: Column, n: Column) -> Column:
    return F.filter(below(nodes, n), lambda x: x["parent"] == n["no"])


def node_text(texts: Column, n: Column) -> Column:
    """All text at and below a node."""
    return F.array_join(F.slice(texts, n["t0"] + 1, n["t1"] - n["t0"]), "")


def own_texts(texts: Column, n: Column) -> Column:
    """The node's direct text pieces."""
    return F.transform(n["own"], lambda i: F.get(texts, i))


def own_text(texts: Column, n: Column) -> Column:
    return F.array_join(own_texts(texts, n), "")


def attr_text(n: Column) -> Column:
    return F.array_join(F.map_values(n["attrs"]), "")


def child_text(nodes: Column, texts: Column, n: Column, levels: int = 2, intended: bool = False) -> Column:
    """Own text, then the direct children's own text once per level as written.

    Intended: own text, then the own text of the children, then of the grandchildren.
    """
    kids = children(nodes, n)
    once = F.array_join(F.transform(kids, lambda k: own_text(texts, k)), "")
    if not intended:
        return F.concat(own_text(texts, n), *[once] * levels)
    grand = F.array_join(
        F.transform(F.flatten(F.transform(kids, lambda k: children(nodes, k))), lambda g: own_text(texts, g)), ""
    )
    return F.concat(own_text(texts, n), once, grand)


def siblings(nodes: Column, n: Column) -> Column:
    """The other children of the node's parent, in document order."""
    parent = F.get(nodes, n["parent"])
    return F.filter(below(nodes, parent), lambda x: (x["parent"] == n["parent"]) & (x["no"] != n["no"]))


def tail_path(path: Column, n: int = 3) -> Column:
    """The last ``n`` steps of a path."""
    return F.slice(path, F.greatest(F.size(path) - n + 1, F.lit(1)), F.lit(n))


def css_path(n: Column, parents: int = 3) -> Column:
    return F.array_join(tail_path(n["path"], parents), " ")


def css_path_in_row(n: Column, parents: int = 3) -> Column:
    """Like :func:`css_path`, but starting below the nearest enclosing table row."""
    def in_row(path: Column) -> Column:
        above = F.slice(path, F.lit(1), F.size(path) - 1)
        row_at = F.transform(above, lambda s, i: F.when(s.rlike(r"^tr(\.|$)"), i + 1).otherwise(0))
        start = F.greatest(F.coalesce(F.array_max(row_at), F.lit(0)) + 1, F.size(path) - parents + 1)
        return F.array_join(F.slice(path, start, F.lit(parents)), " ")

    return let(n["path"], in_row)


def selector_steps(selector: Column) -> Column:
    """A path selector as an array of steps, each an array of its tag and classes."""
    steps = F.filter(F.split(selector, " +"), lambda s: s != "")
    return F.transform(steps, lambda s: F.split(s, r"\."))


def _fits(step: Column, element: Column) -> Column:
    """Does an element step (``tag.class...``) carry the tag and all classes of a selector step?"""
    return let(
        F.split(element, r"\."),
        lambda have: (F.get(step, F.lit(0)) == F.get(have, F.lit(0))) & (F.size(F.array_except(step, have)) == 0),
    )


def matches(steps: Column, n: Column) -> Column:
    """Descendant selector: last step on the node, the others on its ancestors in order."""
    path, want = n["path"], F.size(steps) - 1
    done = F.aggregate(
        F.slice(path, F.lit(1), F.size(path) - 1),
        F.lit(0),
        lambda i, e: F.when((i < want) & F.coalesce(_fits(F.get(steps, i), e), F.lit(False)), i + 1).otherwise(i),
    )
    last = F.get(steps, want)
    same_tag = (F.size(steps) > 0) & (n["tag"] == F.get(last, F.lit(0)))
    return F.when(same_tag, F.when(_fits(last, F.element_at(path, -1)), done == want)).otherwise(F.lit(False))


def select_nodes(nodes: Column, steps: Column) -> Column:
    """The nodes a selector matches, in document order; no steps match nothing."""
    return F.filter(nodes, lambda n: matches(steps, n))


def selected_text(nodes: Column, texts: Column, steps: Column) -> Column:
    return F.array_join(F.transform(select_nodes(nodes, steps), lambda n: node_text(texts, n)), "")


def selected_own_texts(nodes: Column, texts: Column, steps: Column) -> Column:
    return F.flatten(F.transform(select_nodes(nodes, steps), lambda n: own_texts(texts, n)))


def selected_attr(nodes: Column, steps: Column, attr: str) -> Column:
    """The attribute of the first node matched; null where nothing matches or it has none."""
    return F.try_element_at(F.get(select_nodes(nodes, steps), F.lit(0))["attrs"], F.lit(attr))


def best_node(candidates: Column, score) -> Column:
    """The candidate of the highest score; the first in document order among equals."""
    ranked = F.transform(candidates, lambda n: F.struct(score(n).alias("s"), (-n["no"]).alias("first")))
    return F.array_max(ranked)


# ---- frames --------------------------------------------------------------------------------

def node_rows(frame: DataFrame, key: list[str]) -> DataFrame:
    """One row per element with its path, text and place in the tree."""
    n = F.col("n")
    return frame.select(*key, "texts", F.explode("nodes").alias("n")).select(
        *key,
        n["no"].alias("node_no"), n["parent"].alias("parent_no"), (F.size(n["path"]) - 1).alias("depth"),
        n["last"].alias("subtree_end"), n["tag"].alias("tag"), n["attrs"].alias("attrs"),
        F.try_element_at(n["attrs"], F.lit("class")).alias("class"), n["path"].alias("path"),
        css_path(n).alias("css_path"), css_path_in_row(n).alias("row_path"),
        own_text(F.col("texts"), n).alias("own_text"), node_text(F.col("texts"), n).alias("text"),
        own_texts(F.col("texts"), n).alias("text_nodes"),
    )


def select_by_path(frame: DataFrame, key: list[str], selector: Column) -> DataFrame:
    """One row per matched element: number, text and attributes."""
    found = frame.withColumn("__steps", selector_steps(selector)).select(
        *key, "texts", F.explode_outer(select_nodes(F.col("nodes"), F.col("__steps"))).alias("n")
    ).filter(F.col("n").isNotNull())
    n = F.col("n")
    return found.select(
        *key, n["no"].alias("node_no"), n["tag"].alias("tag"),
        node_text(F.col("texts"), n).alias("text"), n["attrs"].alias("attrs"),
    )


def size_report(pages: DataFrame, by: list[str], html: str = "html") -> DataFrame:
    """Characters before and after cleaning."""
    frame = page_frame(pages.withColumn("__before", F.length(html)), [*by, "__before"], html, with_html=True)
    return frame.groupBy(*by).agg(
        F.sum("__before").alias("chars_before"), F.sum(F.length("clean_html")).alias("chars_after")
    )
