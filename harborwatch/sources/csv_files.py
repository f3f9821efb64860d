"""CSV dumps as record rows: one scan of a folder or glob, no per-file loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborwatch.functions.text import js_trim
from harborwatch.plans.skew import spread_join
from harborwatch.session import staged

# Patterns over a line whose ``;`` are commas and that has one more comma at its end. A quote opens a cell only
# at its start and closes it only before a comma; any other quote is a character. Possessive loops keep long
# cells off the stack.
_BODY = r'[^"]*+(?:"(?![^\S,]*+,)"?+[^"]*+)*+'
_CLOSE = _BODY + r'"[^\S,]*+,'
_QUOTED = r'[^\S,]*+"' + _BODY + r'"[^\S,]*+'
_CELL = rf"({_QUOTED}|[^,]*+),"
_WHOLE_CELLS = rf'\G(?:{_QUOTED}|(?![^\S,]*+")[^,]*+),'

#: The longest file that fits into one binary cell, with room for the row around it.
WHOLE_BYTES = 2**31 - 2**16


def fingerprint(files: DataFrame, as_of: Column, source_id: Column | None = None) -> DataFrame:
    """Metadata rows of files given as ``path, content``: MD5 of the raw bytes, base name, breach time."""
    return _metadata(files, F.md5("content"), as_of, source_id)


def _metadata(files: DataFrame, digest: Column, as_of: Column, source_id: Column | None) -> DataFrame:
    return files.select(
        F.col("path"),
        digest.alias("_og_hashmd5"),
        F.lit(None).cast("string").alias("name"),
        as_of.alias("breach_time"),
        F.element_at(F.split("path", "/"), -1).alias("og_filename"),
        F.lit(None).cast("boolean").alias("is_hashed"),
        F.lit(None).cast("boolean").alias("is_salted"),
        (source_id if source_id is not None else F.lit(None)).cast("bigint").alias("_id_source"),
    )


def no_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def plain_path(path: Column) -> Column:
    """A text scan gives the path percent-encoded, a binary scan as it is."""
    return no_scheme(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def file_fingerprint(
    spark: SparkSession, path: str | list[str], as_of: Column, source_id: Column | None = None
) -> DataFrame:
    """Metadata rows of every file of a folder, glob or list.

    A file that is too long for one binary cell (2 GB) is never read whole: in place of the MD5 of its bytes it
    gets one of its length and of the hashes of its numbered stretches between line feeds, split by split. Those and
    the length say every byte, line ends and a last line feed included, so only equal files share it.
    """
    limit = min(int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(WHOLE_BYTES))), WHOLE_BYTES)
    files = spark.read.format("binaryFile").load(path)
    small = fingerprint(files.filter(F.col("length") <= limit), as_of, source_id)
    large = files.filter(F.col("length") > limit).select("path", "length")
    if large.isEmpty():  # names and lengths only, no file is opened
        return small
    by_file = large.withColumn("__file", no_scheme(F.col("path"))).join(_stretch_sums(spark, path, limit), "__file")
    digest = F.md5(F.concat_ws(":", "length", "n", "a", "b"))
    return small.unionByName(_metadata(by_file, digest, as_of, source_id))


def _stretch_sums(spark: SparkSession, path: str | list[str], above: int) -> DataFrame:
    """``__file, n, a, b`` of every file longer than ``above`` bytes; the scan skips the others by their length.

    Only line feeds cut the scan, so a carriage return is a byte like any other. The scan takes a byte order mark
    off a file's start; the length tells of it.
    """
    scan = spark.read.option("lineSep", "\n").text(path).filter(F.col("_metadata.file_size") > above)
    lines = _lines(scan).withColumn("at", F.monotonically_increasing_id())
    splits = staged(lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first_at")), "csv-stretches")
    numbered = _number_dense(lines, splits)
    sums = numbered.groupBy("file").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row_no", "line")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit(1), "row_no", "line")).alias("b"),
    )
    return sums.select(plain_path(F.col("file")).alias("__file"), "n", "a", "b")


def _lines(scan: DataFrame) -> DataFrame:
    return scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def file_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of every file with the start of the file split each was read from."""
    return _lines(spark.read.text(path))


def _before(*by: str) -> Window:
    return Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)


def _commas(line: Column) -> Column:
    return F.concat(F.translate(line, ";", ","), F.lit(","))


def _open_after(cells: Column) -> Column:
    """Whether a line that begins a record ends inside a quoted cell: what its whole cells leave over."""
    return F.length(F.regexp_replace(cells, _WHOLE_CELLS, "")) > 0


def _with_quote_state(lines: DataFrame) -> DataFrame:
    """``opens``: the line ends inside quotes if it begins outside; ``stays``: if it begins inside."""
    cells = _commas(F.col("line"))
    quote = F.col("line").contains('"')
    closing = r"\A" + _CLOSE
    return lines.withColumn("opens", quote & _open_after(cells)).withColumn(
        "stays", ~quote | ~cells.rlike(closing) | _open_after(F.regexp_replace(cells, closing, ""))
    )


def number_records(lines: DataFrame) -> DataFrame:
    """``file, row_no, line``: non-blank records in file order from 0 (row 0 is the header).

    ``lines`` comes straight from the scan: lines of one split follow each other in one task, so a running id orders
    them there, and only counts per split are ordered across a file; a plain file's lines are neither sorted nor
    gathered. In a file with line breaks inside quotes, lines are sorted within their split to find
    open quotes, and only the lines of such a record are put together. A file that ends inside
    quotes cannot be read and gives no rows; ``read_records`` names it.
    """
    return read_lines(lines)[0]


def read_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered records, and ``file`` of every file that ends inside quotes.

    One pass over the text leaves a row per split: its lines, its first running id, and whether quotes hold line
    breaks. From these few rows a plain file's lines get their numbers as they are read the next time.
    """
    solid = lines.filter(js_trim(F.col("line")) != "").withColumn("at", F.monotonically_increasing_id())
    splits = staged(
        _with_quote_state(solid).groupBy("file", "block").agg(
            F.count("*").alias("n"), F.min("at").alias("first_at"), F.bool_or("opens").alias("opens")
        ),
        "csv-splits",
    )
    quoted = splits.filter("opens").select("file").distinct()
    if not quoted.take(1):
        return _number_dense(solid, splits), quoted
    every = _with_quote_state(lines.withColumn("at", F.monotonically_increasing_id()))
    known = staged(every.join(quoted, "file", "left_semi"), "csv-quoted-lines")
    states, unreadable = _states(known)
    unreadable = staged(unreadable, "csv-unreadable")
    joined = staged(_join_quoted(states.join(unreadable, "file", "left_anti")), "csv-quoted")  # counted, then numbered
    numbered = _number(joined)
    if splits.join(quoted, "file", "left_anti").take(1):
        plain = solid.join(quoted, "file", "left_anti")
        numbered = _number_dense(plain, splits).unionByName(numbered)
    return numbered, unreadable


def _states(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with ``open`` (begins inside quotes) and ``ends_open``, and the files that end inside quotes.

    A line maps the state before it to the one after it: it sets it, turns it, or leaves it. So the state is what the
    last setting line set, turned as often as lines have turned it since; splits are chained the same way.
    """
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = _before("file", "block", "at")
    turn = (F.col("opens") & ~F.col("stays")).cast("int")
    lines = known.withColumn("turns", F.sum(turn).over(upto))
    sets = F.when(F.col("opens") == F.col("stays"), F.struct(F.col("opens").cast("int").alias("to"), "turns"))
    lines = lines.withColumn("sets", sets)
    per_split = lines.groupBy("file", "block").agg(
        F.max_by("sets", F.when(F.col("sets").isNotNull(), F.col("at"))).alias("last"), F.max("turns").alias("all_turns")
    ).withColumn("to", (F.col("last.to") + F.col("all_turns") - F.col("last.turns")) % 2)
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    per_split = per_split.withColumn("loose", F.sum(F.when(F.col("to").isNull(), F.col("all_turns")).otherwise(0)).over(along))
    per_split = per_split.withColumn("anchor", F.last(F.when(F.col("to").isNotNull(), F.struct("to", "loose")), ignorenulls=True).over(along))
    after = F.coalesce((F.col("anchor.to") + F.col("loose") - F.col("anchor.loose")) % 2, F.col("loose") % 2)
    per_split = per_split.withColumn("after", after)
    per_split = per_split.withColumn("start", F.coalesce(F.lag("after").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    unreadable = per_split.groupBy("file").agg(F.max_by("after", "block").alias("end")).filter("end = 1").select("file")
    turned = F.coalesce(F.sum(turn).over(before), F.lit(0))
    lines = lines.withColumn("turned", turned).withColumn("set", F.last("sets", ignorenulls=True).over(before))
    lines = lines.join(per_split.select("file", "block", "start"), ["file", "block"])
    inside = F.coalesce(F.col("set.to") + F.col("turned") - F.col("set.turns"), F.col("start") + F.col("turned")) % 2 == 1
    lines = lines.withColumn("open", inside).withColumn("ends_open", F.when(inside, F.col("stays")).otherwise(F.col("opens")))
    return lines.select("file", "block", "at", "line", "open", "ends_open"), unreadable


def _join_quoted(state: DataFrame) -> DataFrame:
    """Put together the lines of every record that runs over line breaks inside quotes."""
    upto = _before("file", "block", "at").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.when(~F.col("open"), F.struct("block", "at"))
    state = state.withColumn("started", F.last(begin, ignorenulls=True).over(upto))
    # A record may begin in an earlier split: carry the last begin over the splits of the file.
    carried = state.groupBy("file", "block").agg(F.max("started").alias("last_start"))
    carried = carried.withColumn("from_before", F.last("last_start", ignorenulls=True).over(_before("file", "block")))
    state = state.join(carried.select("file", "block", "from_before"), ["file", "block"]).withColumn(
        "started", F.coalesce("started", "from_before")
    )
    alone = ~F.col("open") & ~F.col("ends_open")
    parts = (
        state.filter(~alone)
        .groupBy("file", "started")
        .agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("parts"))
        .select(
            "file", F.col("started.block").alias("block"), F.col("started.at").alias("at"),
            F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("line"),
        )
    )
    whole = state.filter(alone & (js_trim(F.col("line")) != "")).select("file", "block", "at", "line")
    return whole.unionByName(parts)


def _offsets(counts: DataFrame) -> DataFrame:
    """``n`` lines of each split, and ``offset``, those of the file's splits before it."""
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(_before("file", "block")), F.lit(0)))


def _number_dense(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Row numbers of lines whose ids are dense within a split, from ``n, first_at`` of every split.

    Where the session cuts the files otherwise than when the splits were counted (its cores changed, say), the ids
    don't fit the counts: that is an error, since numbers would be wrong.
    """
    rank = F.col("at") - F.col("first_at")
    cut_anew = F.raise_error(F.lit("files were cut into other splits than counted; run the read again"))
    row_no = F.when((rank >= 0) & (rank < F.col("n")), F.col("offset") + rank).otherwise(cut_anew)
    return lines.join(_offsets(splits), ["file", "block"], "left").select("file", row_no.alias("row_no"), "line")


def _number(records: DataFrame) -> DataFrame:
    """Row numbers per file from counts per split and the rank within it."""
    offsets = _offsets(records.groupBy("file", "block").agg(F.count("*").alias("n"))).drop("n")
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return records.join(offsets, ["file", "block"]).select("file", (F.col("offset") + rank).alias("row_no"), "line")


def split_cells(line: Column) -> Column:
    """Cells of a record: every ``;`` counts as a comma, quotes are taken off, cells are trimmed."""
    cells = F.regexp_extract_all(_commas(line), F.lit(_CELL), F.lit(1))

    def plain(cell: Column) -> Column:
        c = js_trim(cell)
        inner = F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.when((F.length(c) > 1) & c.startswith('"') & c.endswith('"'), js_trim(inner)).otherwise(c)

    return F.transform(cells, plain)


def parse_records(numbered: DataFrame, key: str = "file") -> DataFrame:
    """``key, row_no, cells``: header names to cells, rows counted from 0 without the header.

    A short row lacks the missing names; surplus or unnamed cells are called ``field<n>``; of two
    equal names the later cell stays.
    """
    cells = numbered.select(key, "row_no", split_cells(F.regexp_replace("line", "^\ufeff", "")).alias("cells"))
    names = F.transform(
        "cells", lambda c, i: F.coalesce(F.nullif(c, F.lit("")), F.concat(F.lit("field"), (i + 1).cast("string")))
    )
    header = cells.filter(F.col("row_no") == 0).select(key, names.alias("names")).withColumn(
        # Repeated names, or one that a surplus cell could get, need the search for the last cell.
        "clash",
        (F.size(F.array_distinct("names")) < F.size("names")) | F.exists("names", lambda n: n.rlike(r"^field\d+$")),
    )
    joined = spread_join(cells.filter(F.col("row_no") > 0), header, [key], ["row_no"])

    def entry(cell: Column, i: Column) -> Column:
        name = F.coalesce(F.get(F.col("names"), i), F.concat(F.lit("field"), (i + 1).cast("string")))
        return F.struct(name.alias("k"), cell.alias("v"))

    entries = F.col("entries")
    last_only = F.filter(
        entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])
    )
    return joined.withColumn("entries", F.transform("cells", entry)).select(
        key, (F.col("row_no") - 1).alias("row_no"),
        F.map_from_entries(F.when(F.col("clash"), last_only).otherwise(entries)).alias("cells"),
    )


def read_records(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """``file, row_no, cells`` of every CSV file of a folder or glob, and ``file`` of those that cannot be read."""
    numbered, unreadable = read_lines(file_lines(spark, path))
    return parse_records(numbered), unreadable


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, row_no, cells`` of every CSV file of a folder or glob."""
    return read_records(spark, path)[0]
