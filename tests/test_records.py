"""Records with quoted line ends over file splits, against the reader that takes a file whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rowsheaf import scan_csv, scan_csv_records, scan_records, write_csv


def test_a_quoted_line_end_keeps_a_record_whole(spark, write):
    path = write("q.csv", 'a,b\n1,"x\n2,y"\n3,z\n')
    assert [tuple(r) for r in scan_csv_records(spark, path).orderBy("a").collect()] == [(1, "x\n2,y"), (3, "z")]


@pytest.mark.parametrize("split", [1024, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_equal_a_parser_for_whole_files(spark, write, split, end):
    rng = random.Random(split)
    fields = ["", "plain", "two\nlines", 'a "quoted" word', "x,y", "\n\n\n", "long " * 30 + "\n" + "tail", "é\n日本"]
    wanted, paths = [], []
    for name in ("one.csv", "two.csv"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["id", "text", "other\nname"])
        for i in range(60):
            row = [str(i), rng.choice(fields), rng.choice(fields)]
            writer.writerow(row)
            wanted.append(row)
        text = out.getvalue()
        paths.append(write(name, ("﻿" if name == "one.csv" else "") + (text if name == "one.csv" else text.rstrip(end))))
    records = scan_records(spark, paths, split_bytes=split)
    assert records.where("is_head").count() == 2
    ordered = [r["value"] for r in records.where("NOT is_head").orderBy("chunk", "record_no").collect()]
    assert [next(csv.reader(io.StringIO(v, newline=""))) for v in ordered] == wanted
    table = scan_csv_records(spark, paths, split_bytes=split)
    assert table.columns == ["id", "text", "other\nname"]
    got = sorted((str(r[0]), r[1] or "", r[2] or "") for r in table.collect())
    assert got == sorted(map(tuple, wanted))


def test_one_long_record_over_many_splits(spark, write):
    path = write("long.csv", 'a,b\n1,"' + "line of text\n" * 5000 + '"\n2,end\n')
    table = scan_csv_records(spark, path, split_bytes=1024)
    assert [tuple(r) for r in table.orderBy("a").collect()] == [(1, "line of text\n" * 5000), (2, "end")]


def test_a_quote_that_stays_open_raises(spark, write):
    good, bad = write("good.csv", 'a\n"x"\n'), write("bad.csv", 'a\n"x\ny\n')
    with pytest.raises(ValueError, match="1 of 2 files"):
        scan_records(spark, [good, bad])


def test_exports_of_a_table(spark, tmp_path):
    df = spark.range(500).select("id", F.concat_ws("\n", F.lit("first"), F.col("id").cast("string"), F.lit('"third",')).alias("text"))
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    table = scan_csv_records(spark, str(tmp_path / "out"), split_bytes=1024)
    assert table.schema["id"].dataType.simpleString() == "bigint"
    assert table.exceptAll(df).isEmpty() and table.count() == 500


def test_hidden_files_raise(spark, write, tmp_path):
    from rowsheaf.sources.inventory import file_inventory

    write("in/a.csv", "x\n1\n")
    write("in/_b.csv", "x\n2\n")
    for read in (lambda p: scan_csv(spark, p), lambda p: file_inventory(spark, [p]), lambda p: scan_csv_records(spark, p)):
        with pytest.raises(ValueError, match="_b.csv"):
            read(str(tmp_path / "in"))


def test_empty_files(spark, write):
    assert scan_csv_records(spark, write("h.csv", "a,b\n")).columns == ["a", "b"]
    assert scan_records(spark, [write("e.csv", "")]).count() == 0


def test_small_splits_share_tasks(spark, write):
    from rowsheaf.sources.lines import scan_splits

    path = write("many.csv", "a,b\n" + "".join(f'{i},"line {i}\nend"\n' for i in range(9000)))
    lines = scan_splits(spark, [path], split_bytes=1024)
    assert lines.select("block_start").distinct().count() > 100
    # a task for each split before
    assert lines.select(F.spark_partition_id()).distinct().count() <= 2
    table = scan_csv_records(spark, path, split_bytes=1024)
    assert sorted(map(tuple, table.collect())) == [(i, f"line {i}\nend") for i in range(9000)]
