"""CSV files, field recognition and standard records."""

import os

import pytest
from pyspark.sql import functions as F

from harborwatch.operators import records
from harborwatch.plans import ingest
from harborwatch.sources import csv_files

def as_of():
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


@pytest.fixture()
def dump(spark, tmp_path):
    """Write files and read them as records: ``{name: [cells, ...]}`` in row order."""
    def run(max_bytes=None, **files):
        for name, content in files.items():
            (tmp_path / f"{name}.csv").write_bytes(content.encode())
        if max_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(max_bytes))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            rows = csv_files.csv_records(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        out = {}
        for r in sorted(rows, key=lambda r: (r["file"], r["row_no"])):
            out.setdefault(os.path.basename(r["file"])[:-4], []).append((r["row_no"], r["cells"]))
        return out

    return run


def test_delimiters_quotes_and_ragged_rows(dump):
    got = dump(a='name;mail,"note"\r\n x ;y,"a;b"\nshort\n1,2,3,4\n,"q ""x"" q"," "\n\n')
    assert got["a"] == [
        (0, {"name": "x", "mail": "y", "note": "a,b"}),
        (1, {"name": "short"}),
        (2, {"name": "1", "mail": "2", "note": "3", "field4": "4"}),
        (3, {"name": "", "mail": 'q "x" q', "note": ""}),
    ]


def test_quoted_line_breaks(dump):
    got = dump(a='h,i\n"1\n\n2",x\n3,"y\nz"\n4,5\n', b="h,i\n6,7\n")
    assert got == {
        "a": [(0, {"h": "1\n\n2", "i": "x"}), (1, {"h": "3", "i": "y\nz"}), (2, {"h": "4", "i": "5"})],
        "b": [(0, {"h": "6", "i": "7"})],
    }


def test_very_long_cells(dump):
    long = "x" * 200_000
    quoted = 'y""' * 60_000
    assert dump(a=f'h,i\n{long},"{quoted}"\n')["a"] == [(0, {"h": long, "i": 'y"' * 60_000})]


@pytest.mark.parametrize("text", ['nick,size\nneo,5" disk\nmorpheus,y\n', 'nick,size\nneo,5" disk\ntrin"ity,3"\nmorpheus,y\n'])
def test_quotes_inside_plain_cells_are_characters(dump, text):
    rows = [line.split(",") for line in text.splitlines()[1:]]
    assert dump(a=text)["a"] == [(k, {"nick": a, "size": b}) for k, (a, b) in enumerate(rows)]


def test_stray_quotes_beside_quoted_line_breaks(dump):
    got = dump(a='h,i\nx 5",1\n"two\nlines, and a "word" in",2\n"""q""",""\na"b,"c;d"\n')["a"]
    assert got == [(0, {"h": 'x 5"', "i": "1"}), (1, {"h": 'two\nlines, and a "word" in', "i": "2"}), (2, {"h": '"q"', "i": ""}), (3, {"h": 'a"b', "i": "c,d"})]


def test_unreadable_file_is_rejected_and_not_registered(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('mail\n"open\n1\n')
    (tmp_path / "good.csv").write_text("mail\na@example.com\n")
    meta, ok, bad = ingest.ingest_directory(spark, str(tmp_path), spark.createDataFrame([], "_og_hashmd5 string"), as_of())
    assert [r["og_filename"] for r in meta.collect()] == ["good.csv"] and ok.count() == 1
    assert ["bad.csv" in r["misc"] for r in bad.collect()] == [True]


def test_file_ending_inside_quotes_gives_nothing(dump):
    assert dump(a='h\n"open\n1\n', b="h\n1\n") == {"b": [(0, {"h": "1"})]}


def test_empty_files_and_headers_only(dump):
    assert dump(a="", b="h,i\n", c="\n\nh\n1\n") == {"c": [(0, {"h": "1"})]}


def test_repeated_and_missing_names(dump):
    assert dump(a="x,,x\n1,2,3\n")["a"] == [(0, {"field2": "2", "x": "3"})]


def test_order_holds_over_many_splits(dump):
    plain = "k,v\n" + "".join(f"{i},{'v' * (i % 9)}\n" for i in range(800))
    broken = "k,v\n" + "".join(f'{i},"a\n\nb{i}"\n' if i % 3 else f"{i},c\n" for i in range(300))
    got = dump(max_bytes=256, plain=plain, broken=broken)
    assert [(n, c["k"]) for n, c in got["plain"]] == [(i, str(i)) for i in range(800)]
    assert [(n, c["k"], c["v"]) for n, c in got["broken"]] == [
        (i, str(i), f"a\n\nb{i}" if i % 3 else "c") for i in range(300)
    ]


def cells_df(spark, rows, file="f"):
    return spark.createDataFrame([(file, i, r) for i, r in enumerate(rows)], "file_hash string, row_no long, cells map<string,string>")


def decide(spark, rows, **kw):
    got = records.classify_fields(cells_df(spark, rows), **kw).collect()
    return {r["test"]: (r["status"], r["field"]) for r in got}


def test_decision_matched_undecided_none(spark):
    rows = [{"m": "a@example.com", "u": "neo", "v": "trinity", "p": "555-0100-1234"}] * 3
    assert decide(spark, rows) == {
        "email_address": ("matched", "m"), "phone_number": ("matched", "p"),
        "ip_address": ("none", None), "username": ("undecided", None),
    }


def test_row_1001_does_not_count(spark):
    rows = [{"a": "neo", "b": "1"}] * 1000 + [{"a": "1", "b": "neo"}] * 1500
    assert decide(spark, rows)["username"] == ("matched", "a")
    assert decide(spark, rows, lines=3000)["username"] == ("matched", "b")


def test_missing_cells_count_as_undefined_as_written(spark):
    rows = [{"a": "neo", "b": "1"}, {"a": "neo"}, {"a": "1"}, {"a": "2"}]
    assert decide(spark, rows)["username"] == ("matched", "b")
    assert decide(spark, rows, semantics="intended")["username"] == ("matched", "a")


def test_no_cell_is_lost(spark):
    rows = [{"m": "a@example.com", "u": "neo", "x": str(i), "y": None if i % 2 else "k"} for i in range(20)]
    cells = cells_df(spark, rows)
    out = records.standardize_records(cells, records.fixes_of(records.classify_fields(cells))).orderBy("row_no").collect()
    assert out[0]["email_address"] == "a@example.com" and out[0]["username"] == "neo"
    assert out[0]["misc"] == '{"x":"0","y":"k"}' and out[0]["phone_number"] is None


def test_one_field_may_fill_two_standards(spark):
    cells = cells_df(spark, [{"a": "v", "b": "w"}])
    fixes = spark.createDataFrame(
        [("f", "a", None, None, "a")],
        "file_hash string, fix_email_address string, fix_phone_number string, fix_ip_address string, fix_username string",
    )
    row = records.standardize_records(cells, fixes).collect()[0]
    assert (row["email_address"], row["username"], row["misc"]) == ("v", "v", '{"b":"w"}')


def test_over_long_value_fails_its_file_as_written(spark):
    rows = [("h1", 0, "x" * 127), ("h1", 1, "x" * 128), ("h2", 0, "ok")]
    df = spark.createDataFrame(rows, "_og_hashmd5 string, row_no long, username string")
    counts = {s: tuple(d.count() for d in records.quarantine(df, semantics=s)) for s in ("reference", "intended")}
    assert counts == {"reference": (1, 2), "intended": (2, 1)}


def test_new_files_skip_known_and_repeated_content(spark):
    meta = spark.createDataFrame([("b", "1"), ("a", "1"), ("c", "2"), ("d", "3")], "path string, _og_hashmd5 string")
    known = spark.createDataFrame([("2",)], "_og_hashmd5 string")
    assert sorted(tuple(r) for r in records.new_files(meta, known).collect()) == [("a", "1"), ("d", "3")]


def test_fingerprint_and_load_of_a_folder(spark, tmp_path):
    (tmp_path / "x y.csv").write_text("mail;nick\na@example.com;neo\nb@example.com;trinity\n")
    (tmp_path / "z+1.csv").write_text("mail;nick\na@example.com;neo\nb@example.com;trinity\n")
    (tmp_path / "known.csv").write_text("mail\nc@example.com\n")
    known = csv_files.file_fingerprint(spark, f"{tmp_path}/known.csv", as_of())
    meta, ok, bad = ingest.ingest_directory(spark, str(tmp_path), known, as_of(), F.lit(7))
    row = meta.collect()[0]
    assert meta.count() == 1 and row["og_filename"] == "x y.csv" and row["_id_source"] == 7
    got = sorted((r["email_address"], r["username"], r["misc"], r["_og_hashmd5"]) for r in ok.collect())
    assert got == [("a@example.com", "neo", "{}", row["_og_hashmd5"]), ("b@example.com", "trinity", "{}", row["_og_hashmd5"])]
    assert bad.count() == 0


def test_names_with_signs_are_joined(spark, tmp_path):
    (tmp_path / "z+1 %41.csv").write_text("nick\nneo\n")
    _, ok, _ = ingest.ingest_directory(spark, str(tmp_path), spark.createDataFrame([], "_og_hashmd5 string"), as_of())
    assert [r["username"] for r in ok.collect()] == ["neo"]


def test_plain_files_are_numbered_in_the_pass_that_parses_them(spark, tmp_path):
    """The count of lines per split is a written table; what is left is the parse and the header."""
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("m,u\n\n" + "".join(f"x{i}@example.com,ann{i}\n  \n" for i in range(k * 5)))
    rows = csv_files.csv_records(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" text") == 2, plan
    got = {(r["file"][-5], r["row_no"]): r["cells"]["u"] for r in rows.collect()}
    assert got == {(str(k), i): f"ann{i}" for k in range(3) for i in range(k * 5)}


def test_splits_cut_anew_are_an_error(spark, tmp_path):
    """Ids that don't fit the counts raise; they never give wrong numbers."""
    lines = spark.createDataFrame([("f", 0, 1, "a"), ("f", 0, 2, "b")], "file string, block long, at long, line string")
    counted = spark.createDataFrame([("f", 0, 1, 2)], "file string, block long, first_at long, n long")
    assert [r["row_no"] for r in csv_files._number_dense(lines, counted).orderBy("row_no").collect()] == [0, 1]
    for wrong in [("f", 0, 0, 2), ("f", 5, 1, 2), ("f", 0, 2, 2)]:
        other = spark.createDataFrame([wrong], counted.schema)
        with pytest.raises(Exception, match="other splits than counted"):
            csv_files._number_dense(lines, other).collect()
