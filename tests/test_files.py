import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import files_in_order
from rowsheaf import (
    column_profile,
    count_lines,
    describe_columns,
    encoding_profile,
    file_inventory,
    infer_types,
    merge_lines,
    merge_manifest,
    merge_ordered,
    merge_tables,
    name_mapping,
    numbered_inventory,
    sample_values,
    scan_csv,
    scan_lines,
    split_file,
    total_size,
    write_csv,
    write_merged_lines,
    write_merged_table,
)
from rowsheaf.plans.files import list_inputs
from rowsheaf.sources.charsets import coding_session, fits


def _values(df):
    return [r["value"] for r in df.collect()]


@pytest.fixture
def three(write):
    return [write("merge_b.csv", "x,y\n3,c\n4,d\n"), write("merge_a.csv", "a,b\n1,a\n2,b"), write("merge_c.csv", "a,b\n5,e\n")]


# ---- lines


def test_lines_keep_their_bytes(spark, write):
    path = write("crlf.csv", "id,v\r\n1,a\r\n\r\n2, b ")
    rows = scan_lines(spark, [path]).collect()
    assert [(r["line_no"], r["is_header"], r["value"]) for r in rows] == [
        (0, True, "id,v\r"),
        (1, False, "1,a\r"),
        (2, False, "\r"),
        (3, False, "2, b "),
    ]


def test_line_counts(spark, write):
    paths = [write("a.csv", "h\n1\n2\n"), write("b.csv", "h\n1"), write("only_header.csv", "h\n"), write("empty.csv", "")]
    row = count_lines(spark, paths).first()
    assert (row["total_lines"], row["data_lines"]) == (6, 3)
    row = count_lines(spark, [paths[3]]).first()
    assert (row["total_lines"], row["data_lines"]) == (0, 0)


def test_missing_input_raises_before_any_output(spark, write, tmp_path):
    out = tmp_path / "out"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        write_merged_lines(spark, [write("a.csv", "h\n1\n"), str(tmp_path / "gone.csv")], str(out))
    assert not out.exists()


def test_file_names_with_spaces(spark, write):
    path = write("a folder/näme [1]+{2}.csv", "h\n1\n2\n")
    assert _values(merge_ordered(spark, [path]).orderBy("row_no")) == ["1", "2"]
    row = merge_manifest(spark, [path]).first()
    assert (row["name"], row["rows"], row["bytes"]) == ("näme [1]+{2}.csv", 2, 4)


# ---- merge


def test_merge_in_list_order(spark, three):
    assert _values(merge_ordered(spark, three).orderBy("row_no")) == ["3,c", "4,d", "1,a", "2,b", "5,e"]
    assert [r["row_no"] for r in merge_ordered(spark, three).orderBy("row_no").collect()] == [1, 2, 3, 4, 5]


def test_listed_twice_counts_once(spark, three):
    assert len(list_inputs(spark, [three[0], three[1], three[0]])) == 2
    assert merge_lines(spark, [three[0], three[0]]).count() == 2


@pytest.mark.parametrize(
    ("header", "text"),
    [("first", "x,y\n3,c\n4,d\n1,a\n2,b\n5,e\n"), ("none", "3,c\n4,d\n1,a\n2,b\n5,e\n")],
)
def test_merged_files_concatenate(spark, three, tmp_path, header, text):
    out = str(tmp_path / "merged")
    result = write_merged_lines(spark, three, out, header=header)
    assert "".join(files_in_order(out)) == text
    assert result.input_bytes == sum(os.path.getsize(p) for p in three)


def test_merged_folder_reads_as_csv(spark, three, tmp_path):
    for i, ordered in enumerate((True, False)):
        out = str(tmp_path / f"merged{i}")
        write_merged_lines(spark, three, out, header="each", ordered=ordered)
        assert all(t.startswith("x,y\n") for t in files_in_order(out))
        df = scan_csv(spark, out)
        assert df.columns[:2] == ["x", "y"]
        assert sorted(r["x"] for r in df.collect()) == [1, 2, 3, 4, 5]


def test_merge_of_headers_only(spark, write, tmp_path):
    paths = [write("a.csv", "a,b\n"), write("b.csv", "a,b\n"), write("c.csv", "")]
    for i, header in enumerate(("each", "first")):
        out = str(tmp_path / f"m{i}")
        write_merged_lines(spark, paths, out, header=header)
        assert "".join(files_in_order(out)) == "a,b\n"


def test_merge_tables_by_position(spark, three):
    rows = merge_tables(spark, three).collect()
    assert sorted((r["x"], r["y"]) for r in rows) == [("1", "a"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "e")]


def test_ragged_rows_are_not_lost_silently(spark, write):
    paths = [write("a.csv", "a,b\n1,2\n"), write("b.csv", "a,b\n1,2,3\n")]
    with pytest.raises(Exception, match="MALFORMED"):
        merge_tables(spark, paths).collect()
    assert sorted(_values(merge_lines(spark, paths))) == ["1,2", "1,2,3"]


def test_output_over_input_is_refused(spark, write, tmp_path):
    path = write("in/a.csv", "h\n1\n")
    with pytest.raises(ValueError):
        write_merged_lines(spark, [path], str(tmp_path / "in"))
    with pytest.raises(ValueError):
        write_merged_table(spark, [path], path)


@pytest.mark.parametrize("header", ["each", "first", "none"])
def test_many_small_files_come_together(spark, write, tmp_path, header):
    paths = [write(f"small/{i}.csv", f"h{i}\n" + "".join(f"{i}-{j}\n" for j in range(i % 5))) for i in range(40)]
    expected = [f"{i}-{j}" for i in range(40) for j in range(i % 5)]
    for ordered in (True, False):
        out = str(tmp_path / f"o{ordered}")
        write_merged_lines(spark, paths, out, header=header, ordered=ordered, compact=True)
        texts = files_in_order(out)
        assert len(texts) <= 2
        lines = "".join(texts).splitlines()
        assert [x for x in lines if x != "h0"] == expected
        assert lines.count("h0") == {"each": len(texts), "first": 1, "none": 0}[header]
        assert header == "none" or lines[0] == "h0"


def test_hidden_names_raise_and_folders_are_read(spark, write):
    a, b, c = write("h/a.csv", "x\n1\n"), write("h2/_b.csv", "x\n2\n"), write("h3/.c.csv", "x\n3\n")
    write("h/inner/d.csv", "x\n4\n")
    write("h/_SUCCESS", "")
    for hidden in (b, c, os.path.dirname(b), os.path.dirname(c)):
        with pytest.raises(ValueError, match="rename"):
            merge_manifest(spark, [a, hidden])
    folder = os.path.dirname(a)
    assert sorted(_values(merge_lines(spark, [folder]))) == ["1", "4"]
    assert merge_tables(spark, [folder]).count() == 2 == file_inventory(spark, [folder]).count()


@pytest.mark.parametrize("n", [16, 17])
def test_merge_layout_does_not_follow_the_size(spark, write, tmp_path, n):
    paths = [write(f"n{n}/{i}.csv", f"h\n{i}\n") for i in range(n)]
    out = tmp_path / "o"
    write_merged_lines(spark, paths, str(out))
    assert sum(f.startswith("chunk=") for f in os.listdir(out)) == n


def test_ordered_merge_sorts_nothing(spark, three, tmp_path):
    write_merged_lines(spark, three, str(tmp_path / "o"))
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [done.apply(i).physicalPlanDescription() for i in range(done.size())]
    written = [p for p in plans if str(tmp_path / "o") in p and "InsertIntoHadoopFs" in p]
    assert written and not any("Sort" in p or "Exchange hash" in p for p in written)


def test_merge_many_splits_keeps_order(spark, write):
    """Files cut into many splits, of many lengths."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        paths = [write(f"f{i}.csv", "h\n" + "".join(f"{i}-{j}\n" for j in range(n))) for i, n in enumerate((900, 10, 2000))]
        merged = merge_ordered(spark, paths)
        expected = [f"{i}-{j}" for i, n in enumerate((900, 10, 2000)) for j in range(n)]
        assert merged.rdd.getNumPartitions() > 8
        assert _values(merged.orderBy("row_no")) == expected
        manifest = merge_manifest(spark, paths).orderBy("file_idx").collect()
        assert [r["rows"] for r in manifest] == [900, 10, 2000]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_merged_files_concatenate_over_many_splits(spark, write, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        paths = [write(f"g{i}.csv", "h\n" + "".join(f"{i}-{j}\n" for j in range(n))) for i, n in enumerate((900, 10, 2000))]
        out = str(tmp_path / "o")
        write_merged_lines(spark, paths, out, header="first")
        expected = "h\n" + "".join(f"{i}-{j}\n" for i, n in enumerate((900, 10, 2000)) for j in range(n))
        assert "".join(files_in_order(out)) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- encodings

TEXT = "编号,名\n1,张三\n2,李四\n"
BYTES = {
    "utf-8": TEXT.encode(),
    "utf-8-sig": TEXT.encode("utf-8-sig"),
    "gbk": TEXT.encode("gbk"),
    "gb18030": TEXT.replace("李四", "李🙂").encode("gb18030"),
    "utf-16-le": b"\xff\xfe" + TEXT.encode("utf-16-le"),
    "utf-16-be": b"\xfe\xff" + TEXT.encode("utf-16-be"),
    "latin-1": "a,b\n\xe9\xff,\x80\n".encode("latin-1"),
}


def test_encoding_cascade(spark, write):
    paths = [write(f"enc_{name}.csv", raw) for name, raw in BYTES.items()]
    paths += [write("enc_sig_noeol.csv", BYTES["utf-8-sig"].rstrip(b"\n")), write("enc_empty.csv", b"")]
    found = {os.path.basename(r["path"]): r["encoding"] for r in encoding_profile(spark, paths).collect()}
    expected = {f"enc_{name}.csv": name for name in BYTES}
    assert found == {**expected, "enc_sig_noeol.csv": "utf-8-sig", "enc_empty.csv": "utf-8"}


def test_encoding_of_odd_names(spark, write):
    paths = [write("o d d/a b[1].csv", BYTES["gbk"]), write("o d d/名+.csv", BYTES["utf-8"])]
    folder = os.path.dirname(paths[0])
    df = merge_tables(spark, [folder], detect_encoding=True)
    assert sorted(tuple(r) for r in df.collect()) == [("1", "张三")] * 2 + [("2", "李四")] * 2


def test_late_bytes_decide(spark, write):
    """The whole file is tested, not its head."""
    path = write("late.csv", b"a\n" * 200_000 + "名\n".encode("gbk"))
    assert encoding_profile(spark, [path]).first()["encoding"] == "gbk"


def test_merge_mixed_encodings(spark, write):
    names = ("gbk", "utf-8", "utf-16-le", "utf-16-be", "utf-8-sig")
    paths = [write(f"mix_{n}.csv", BYTES[n]) for n in names]
    df = merge_tables(spark, paths, detect_encoding=True)
    assert df.columns == ["编号", "名"]
    rows = [tuple(r) for r in df.collect()]
    assert sorted(rows) == sorted([("1", "张三"), ("2", "李四")] * len(names))


def test_lines_of_five_encodings(spark, write, tmp_path):
    """Merged and split by lines, files are cut at the line end of their encoding and decoded."""
    names = ("gbk", "utf-16-le", "gb18030", "utf-16-be", "utf-8-sig", "latin-1")
    paths = [write(f"mix_{n}.csv", BYTES[n]) for n in names]
    expected = [line for n in names for line in _decoded(n).splitlines()[1:]]
    found = merge_ordered(spark, paths, detect_encoding=True).orderBy("row_no").collect()
    assert [r["value"] for r in found] == expected
    out = str(tmp_path / "merged")
    write_merged_lines(spark, paths, out, header="first", detect_encoding=True)
    assert "".join(files_in_order(out)) == "\n".join([_decoded("gbk").splitlines()[0], *expected, ""])
    listed = merge_manifest(spark, paths, detect_encoding=True).orderBy("file_idx").collect()
    assert [r["rows"] for r in listed] == [2, 2, 2, 2, 2, 1]


def _decoded(name):
    return BYTES[name].decode(name).removeprefix("\ufeff")


@pytest.mark.parametrize("name", ["utf-16-le", "utf-16-be", "gb18030"])
def test_encoded_lines_over_many_splits(spark, write, tmp_path, name):
    """Splits begin anywhere in a character or a line end."""
    text = "编号\n" + "".join(f"{i},{'名' * (i % 7)}🙂\r\n" for i in range(3000))
    mark = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}.get(name, b"")
    path = write("many.csv", mark + text.encode(name))
    encodings = encoding_profile(spark, [path])
    lines = scan_lines(spark, [path], 1024, encodings).orderBy("block_start", "line_no").collect()
    assert "".join(r["value"] + "\n" for r in lines) == text
    assert len({r["task"] for r in lines}) > 20
    assert [r["value"] for r in lines if r["is_header"]] == ["编号"]
    split_file(spark, path, str(tmp_path / "parts"), "rows", 700, layout="files", detect_encoding=True)
    parts = files_in_order(tmp_path / "parts")
    assert len(parts) == 5 and all(p.startswith("编号\n") for p in parts)
    assert "".join(p.removeprefix("编号\n") for p in parts) == text.removeprefix("编号\n")


def test_characters_like_a_line_end_raise(spark, write):
    path = write("torn.csv", b"\xff\xfe" + "a\n\u0a05\u4e00\n".encode("utf-16-le"))
    with pytest.raises(Exception, match="look like a line end"):
        merge_lines(spark, [path], detect_encoding=True).collect()


def test_strict_tests_against_plain_python(spark):
    """All pairs of bytes, and quadruples at random, fit the encodings that Python's strict decoders say."""
    draw = random.Random(5)
    pairs = [bytes([a, b]) for a in range(256) for b in range(256)]
    fours = [bytes([draw.randrange(0x81, 0xFF), draw.randrange(0x30, 0x3A)] * 2) for _ in range(500)]
    fours += [draw.randbytes(4) for _ in range(5000)]
    rows = coding_session(spark).createDataFrame([(raw,) for raw in {*pairs, *fours}], "raw binary")
    found = rows.select("raw", fits(F.col("raw"), "GBK").alias("gbk"), fits(F.col("raw"), "GB18030").alias("gb18030"))
    wrong = {name: [] for name in ("gbk", "gb18030")}
    for row in found.collect():
        for name in wrong:
            try:
                bytes(row["raw"]).decode(name)
                strict = True
            except UnicodeDecodeError:
                strict = False
            if row[name] != strict:
                wrong[name].append((bytes(row["raw"]).hex(), row[name]))
    assert {name: (len(w), sorted(w)[:20]) for name, w in wrong.items()} == {name: (0, []) for name in wrong}


# ---- tables


def test_quoted_line_ends(spark, write):
    path = write("q.csv", 'a,b\n1,"x\ny"\n2,"say ""hi"""\n')
    rows = scan_csv(spark, path, multi_line=True).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x\ny"), (2, 'say "hi"')]
    assert merge_lines(spark, [path]).count() == 3


def test_any_suffix_and_separator(spark, write):
    assert scan_csv(spark, write("t.txt", "a;b\n1;2.5\n"), sep=";").dtypes == [("a", "bigint"), ("b", "double")]


def test_types(spark, write):
    path = write(
        "types.csv",
        "i,f,k,d,t,c,s,n\n"
        "1,1.5,true,2024-01-02,2024-01-02 03:04:05,10:00:00,x,\n"
        "007,2,False,2024-01-03,2024-01-02 03:04:05.5,11:30:00,,\n",
    )
    df = scan_csv(spark, path)
    types = [t for _, t in df.dtypes]
    assert types == ["bigint", "double", "boolean", "date", "timestamp_ntz", "string", "string", "string"]
    assert df.collect()[1]["i"] == 7


def test_late_misfit_raises(spark, write):
    path = write("late_type.csv", "a\n" + "1\n" * 1500 + "x\n")
    with pytest.raises(Exception, match="MALFORMED"):
        scan_csv(spark, path, sample_rows=1000).collect()
    assert scan_csv(spark, path).dtypes == [("a", "string")]


def test_infer_types_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert [f.dataType.simpleString() for f in infer_types(df)] == ["string", "string"]


def test_csv_export_text(spark, tmp_path):
    df = spark.sql(
        "SELECT ' pad ' AS a, 'q\"x' AS b, '' AS c, CAST(NULL AS STRING) AS d, "
        "timestamp_ntz'2024-01-02 03:04:05.179575' AS t, 1.5D AS f, 'x,y' AS g, true AS k"
    )
    out = str(tmp_path / "o")
    write_csv(df.coalesce(1), out)
    assert files_in_order(out) == ['a,b,c,d,t,f,g,k\n pad ,"q""x","",,2024-01-02 03:04:05.179575,1.5,"x,y",true\n']


def test_bom_once_per_file_and_gone_on_read(spark, tmp_path):
    out = str(tmp_path / "o")
    write_csv(spark.range(4).toDF("编号").repartition(2), out, bom=True)
    assert all(t.startswith("\ufeff编号\n") for t in files_in_order(out))
    assert scan_csv(spark, out).columns == ["编号"]


def test_inventory(spark, write):
    paths = [write("inv/a.csv", "x" * 2048), write("inv/b.csv", "y")]
    rows = file_inventory(spark, paths).orderBy("name").collect()
    assert [(r["name"], r["folder"], r["size"], r["size_text"]) for r in rows] == [
        ("a.csv", "inv", 2048, "2.0 KB"),
        ("b.csv", "inv", 1, "1.0 B"),
    ]
    assert rows[0]["modified"].second == 0


def test_inventory_in_list_order(spark, write):
    paths = [write("inv/b.csv", "y"), write("inv/sub/z.csv", "zz"), write("inv/a 1.csv", "xxx"), write("other/c.csv", "")]
    listed = numbered_inventory(spark, [paths[2], os.path.dirname(paths[3]), os.path.dirname(paths[0])])
    assert [(r["index"], r["name"]) for r in listed.orderBy("index").collect()] == [
        (1, "a 1.csv"),
        (2, "c.csv"),
        (3, "b.csv"),
        (4, "z.csv"),
    ]
    totals = total_size(listed).first()
    assert (totals["n_files"], totals["total_bytes"]) == (4, 6)


# ---- profile and samples


def test_profile(spark, write):
    path = write("p.csv", ' a b ,"x""y"\n1,2.5\n2,3\n')
    rows = column_profile(spark, path).orderBy("pos").collect()
    assert [(r["pos"], r["column"], r["type"], r["total_rows"]) for r in rows] == [(1, "ab", "BIGINT", 2), (2, "xy", "DOUBLE", 2)]
    assert rows[0]["size_mb"] == pytest.approx(os.path.getsize(path) / 1024**2)


def test_same_cleaned_name_raises(spark):
    with pytest.raises(ValueError, match="ab"):
        describe_columns(spark.createDataFrame([(1, 2)], "`a b` int, ab int"))
    assert name_mapping(["a b", "", "'"]) == {"ab": "a b", "列_2": "", "列_3": "'"}


def test_sample_values(spark):
    values = [" b", "b ", "a\t", "", "  ", None, "c"] * 10
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r["v"] for r in sample_values(df, "v").collect()] == ["b", "a", "c"]
    assert [r["v"] for r in sample_values(df, "v", limit=2).collect()] == ["b", "a"]
    assert sample_values(df, "v", limit=1).count() == 0  # the first two raw values are blank


def test_sample_values_of_a_large_table(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN concat(' v', lpad(string(id % 200), 3, '0')) END AS v")
    got = [r["v"] for r in sample_values(df, "v", seed=1).collect()]
    assert len(got) == 50 and got == sorted(got) and set(got) <= {f"v{i:03d}" for i in range(200)}


def test_sample_is_of_the_asked_size(spark):
    from rowsheaf.operators.sampling import random_rows

    df = spark.range(100_000)
    sample = random_rows(df, 10_000, 100_000, seed=3)
    assert sample.count() == 10_000 == sample.distinct().count()
    assert random_rows(df, 1_000_000, 100_000, seed=3).count() == 100_000
