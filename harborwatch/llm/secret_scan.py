"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they stand. Weak candidates (ident, opaque, endpoint) are common
in clean text; one is reported only where the parts that complete it co-occur within ``scope`` characters in the same
document: a name needs a secret, an opaque string a name or an endpoint, an endpoint a name and a secret. The interval
join between parts is by the nearest part of each role on either side that doesn't overlap, so a document with many parts
yields a row a part, never a row a pair, and no match completes itself. An opaque string inside an address, or one cut
into many parts by slashes as a path is, is no candidate: clean links stay as they are.

Positions are code points: ``split`` gives the text between matches, whose lengths add up to the places.

Defined results: null and empty texts have no spans and the digest of the empty string; overlapping spans of different
kinds are each reported; repeated rows are scanned each; texts of any length are scanned whole; other columns stay
(``redact``) or don't matter (``scan``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (kind, pattern, least length of group 2 or of the match, role); kinds are listed in the order of the digest.
#: The first three are base kinds. A maximal run of at least n characters is the same as a run that is kept if it
#: has n, so access and hex carry their length in the pattern; a short assign match still hides what it covers.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", "name"),
    ("hex", r"[0-9a-f]{24,}", "secret"),
    ("ident", r"""(?i:(?:user(?:_?name)?|login|account|client_?id|key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", "name"),
    ("opaque", r"(?:https?|jdbc:[a-z]+|s3|ftp)://[^\s\"'<>]*|[A-Za-z0-9+/]{32,}={0,2}", "secret"),  # an address hides what it covers
    ("endpoint", r"""(?:https?|jdbc:[a-z]+|s3|ftp)://[A-Za-z0-9.-]+(?::[0-9]+)?|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b""", "endpoint"),
]
BASE = 3
#: What a text must hold for the pattern to match; a cheap look before the costly one.
ASSIGN_VALUE = 6
#: A string with more slashes than one for so many characters is a path.
PATH_STEP = 16


def _kept(kind: str, match: Column) -> Column:
    if kind == "assign":
        value = F.regexp_extract(match, "^" + KINDS[0][1], 2)
        return F.length(value) >= ASSIGN_VALUE
    if kind == "opaque":  # mixed characters; a word, a number, an address or a path is none
        slashes = F.length(match) - F.length(F.replace(match, F.lit("/"), F.lit("")))
        mixed = match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
        return mixed & ~match.contains("://") & (slashes * PATH_STEP <= F.length(match))
    return F.lit(True)


def _matches(text: Column, n: int, kind: str, pattern: str) -> Column:
    """Array of (kind number, order, length of the text before since the last match, the match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.transform(
        F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("match")),
        lambda z, i: F.struct(F.lit(n).alias("kind"), i.alias("nth"), F.length(z["gap"]).cast("long").alias("gap"), F.length(z["match"]).cast("long").alias("length"), _kept(kind, z["match"]).alias("kept")),
    )
    none = F.array().cast("array<struct<kind:int,nth:int,gap:bigint,length:bigint,kept:boolean>>")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def parts(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, kind, start, end): every candidate, base and weak; rows of null kind for documents without any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.concat(*[_matches(text, n, kind, pattern) for n, (kind, pattern, _) in enumerate(KINDS)])
    rows = docs.select(*keys, F.explode_outer(every).alias("m")).select(*keys, "m.*")
    w = Window.partitionBy(*keys, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("length")).over(w)
    # A match that fails becomes a row of null kind, so that its document keeps a row.
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).select(
        *keys, F.when(F.col("kept"), F.col("kind")).alias("kind"), "start", "end"
    )


def link(found: DataFrame, keys: list[str], scope: int = 300) -> DataFrame:
    """``found`` with ``reported``: base kinds, and weak ones whose complementary parts stand within ``scope``."""
    role = F.element_at(F.array(*[F.lit(r) for _, _, r in KINDS]), F.col("kind") + 1)
    # Matches of one kind don't overlap each other, so of each kind only the nearest on a side can overlap a match, and
    # the one beyond it is clear: by start to the left, by end to the right.
    own = Window.partitionBy(*keys, "kind").orderBy("start")
    by_start = Window.partitionBy(*keys).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    by_end = Window.partitionBy(*keys).orderBy("end", "start", "kind").rowsBetween(1, Window.unboundedFollowing)
    beside = found.withColumn("beyond_left", F.lag("end").over(own)).withColumn("beyond_right", F.lead("start").over(own))
    near: dict[str, Column] = {}
    for k, (_, _, r) in enumerate(KINDS):
        mine = F.col("kind") == k
        left = F.last(F.when(mine, F.struct("end", "beyond_left")), ignorenulls=True).over(by_start)
        right = F.first(F.when(mine, F.struct("start", "beyond_right")), ignorenulls=True).over(by_end)
        left = F.when(left["end"] <= F.col("start"), left["end"]).otherwise(left["beyond_left"])
        right = F.when(right["start"] >= F.col("end"), right["start"]).otherwise(right["beyond_right"])
        close = F.coalesce(F.col("start") - left <= scope, F.lit(False)) | F.coalesce(right - F.col("end") <= scope, F.lit(False))
        near[r] = near[r] | close if r in near else close
    complete = F.when(F.col("kind") < BASE, True).when(F.col("role") == "name", near["secret"]).when(
        F.col("role") == "secret", near["name"] | near["endpoint"]
    ).otherwise(near["name"] & near["secret"])
    reported = F.col("kind").isNotNull() & F.coalesce(complete, F.lit(False))
    return beside.withColumn("role", role).withColumn("reported", reported).drop("role", "beyond_left", "beyond_right")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    found = link(parts(rows, ["doc_id", "row"]), ["doc_id", "row"], scope)
    name = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("kind") + 1)
    label = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct("start", "kind", label.alias("label"))
    joined = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["label"]))
    count = lambda n: F.count(F.when(F.col("kind") == n, 1))
    return found.groupBy("doc_id", "row").agg(
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.collect_list(F.when(F.col("kind") < BASE, item))), 256).alias("base_sha256"),
        joined(F.collect_list(F.when(F.col("reported"), item))).alias("spans"),
        F.count(F.when(F.col("reported") & (F.col("kind") >= BASE), 1)).alias("n_linked"),
    ).drop("row")


def redact(docs: DataFrame, text_col: str = "text", scope: int = 300) -> DataFrame:
    """The documents with every reported span replaced by its kind in brackets; overlapping spans become one.

    Only documents with a candidate are joined with their spans, by a hash of the text; equal texts share them.
    """
    text = F.col(text_col)
    own = "__"  # begins names that the documents don't have
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    a, b, t, s = (f"{own}{c}" for c in "abts")
    any_part = F.coalesce(F.lit(False) if not KINDS else _any(text), F.lit(False))
    hit = docs.filter(any_part).withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(1), text))
    keys = [a, b]
    found = link(parts(hit.select(*keys, text.alias(t)).dropDuplicates(keys), keys, t), keys, scope).filter("reported")
    # Spans that overlap or touch one another are one island, named by its first.
    w = Window.partitionBy(*keys).orderBy("start", "end", "kind")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    islands = islands.groupBy(*keys, "island").agg(F.min(F.struct("start", "kind")).alias("first"), F.max("end").alias("end"))
    spans = islands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("first.start").alias("start"), "end", F.col("first.kind").alias("kind")))).alias(s))
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{k}]") for k, _, _ in KINDS]), k + 1)
    edge = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(s, i)["end"])
    kept = F.transform(s, lambda span, i: F.concat(F.substring(text, (edge(i) + 1).cast("int"), (span["start"] - edge(i)).cast("int")), name(span["kind"])))
    tail = F.substring(text, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col(s).isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    changed = hit.join(spans, keys, "left").withColumn(text_col, clean).select(*docs.columns)
    return docs.filter(~any_part).unionByName(changed)


def _any(text: Column) -> Column:
    out = F.lit(False)
    for _, pattern, _ in KINDS:
        out = out | text.rlike(pattern)
    return out
