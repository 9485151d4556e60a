import dataclasses
import itertools
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import files_in_order
from rowsheaf import manifest, scan_csv, split_file, split_lines, split_table, split_table_to_csv, write_merged_lines
from rowsheaf.operators.split import assign_parts
from rowsheaf.plans import numbering
from rowsheaf.plans.numbering import with_greedy_parts
from rowsheaf.sources.lines import order_lines


def _sizes(split):
    return [(r["part"], r["rows"]) for r in manifest(split).orderBy("part").collect()]


def _counted(split):
    return {r["part"]: r["count"] for r in split.rows.groupBy("part").count().collect()}


@pytest.fixture
def ten(write):
    return write("ten.csv", "id,v\n" + "".join(f"{i},x\n" for i in range(10)))


@pytest.mark.parametrize(
    ("by", "n", "sizes"),
    [
        ("rows", 3, [3, 3, 3, 1]),
        ("rows", 10, [10]),
        ("rows", 100, [10]),
        ("rows", 1, [1] * 10),
        ("count", 6, [2, 2, 2, 2, 2, 0]),
        ("count", 3, [4, 4, 2]),
        ("count", 1, [10]),
    ],
)
def test_part_sizes(spark, ten, by, n, sizes):
    split = split_lines(spark, ten, by, n)
    assert _sizes(split) == list(enumerate(sizes, 1))
    assert _counted(split) == {i: s for i, s in enumerate(sizes, 1) if s}


def test_part_files(spark, ten, tmp_path):
    out = str(tmp_path / "parts")
    result = split_file(spark, ten, out, "count", 6, prefix=" a/b. ", layout="files")
    names = [f"a_b_{i:04d}.csv" for i in range(1, 7)]
    assert sorted(f for f in os.listdir(out) if f.endswith(".csv") and not f.startswith(".")) == names
    texts = files_in_order(out)
    assert texts[0] == "id,v\n0,x\n1,x\n" and texts[5] == "id,v\n"
    rows = result.manifest.orderBy("part").collect()
    assert [(r["part"], r["file"], r["rows"], r["bytes"]) for r in rows] == [
        (i, names[i - 1], 2 if i < 6 else 0, len(texts[i - 1])) for i in range(1, 7)
    ]
    assert result.layout == "files"


@pytest.mark.parametrize("layout", ["files", "folders"])
@pytest.mark.parametrize(("by", "n"), [("rows", 4), ("count", 3), ("bytes", 11)])
def test_parts_concatenate_to_the_input(spark, write, tmp_path, layout, by, n):
    data = [f"{i},{'y' * (i % 7)}\r" for i in range(57)]
    path = write("in.csv", "id,v\r\n" + "\n".join(data))
    out = str(tmp_path / "parts")
    result = split_file(spark, path, out, by, n, layout=layout)
    if layout == "files":
        texts = files_in_order(out)
    else:
        texts = ["".join(files_in_order(f"{out}/part={r['part']}")) for r in result.manifest.orderBy("part").collect()]
    lines = []
    for text in texts:
        head, *rest = text.split("\n")
        assert head == "id,v\r" and rest.pop() == ""
        lines += rest
    assert lines == data


def test_bytes_against_plain_python(spark, write):
    """Many splits, lines of many lengths, targets from below one line to above the file."""
    rng = random.Random(5)
    lines = ["z" * rng.randrange(0, 90) for _ in range(9000)]
    path = write("b.csv", "h\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        ordered = order_lines(spark, [path])
        assert ordered.n_chunks > 4 and ordered.total_bytes == sum(len(x) + 1 for x in lines)
        for target in (7, 100, 5000, 40_000, 65_536, 10**7):
            expected, offset = {}, 0
            for line in lines:
                n, size = expected.get(offset // target + 1, (0, 0))
                expected[offset // target + 1] = (n + 1, size + len(line) + 1)
                offset += len(line) + 1
            split = assign_parts(ordered, "bytes", target)
            got = {r["part"]: (r["rows"], r["bytes"]) for r in manifest(split).collect()}
            assert got == expected, target
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_line_leaves_no_gap_in_the_names(spark, write, tmp_path):
    path = write("long.csv", "h\na\n" + "b" * 50 + "\nc\nd\n")
    out = str(tmp_path / "o")
    result = split_file(spark, path, out, "bytes", 10, layout="files")
    rows = result.manifest.orderBy("part").collect()
    assert [(r["part"], r["file"], r["rows"]) for r in rows] == [(1, "split_part_0001.csv", 2), (2, "split_part_0002.csv", 2)]
    assert files_in_order(out) == ["h\na\n" + "b" * 50 + "\n", "h\nc\nd\n"]


def test_empty_and_header_only(spark, write, tmp_path):
    for name, text in (("e.csv", ""), ("h.csv", "id,v\n"), ("n.csv", "id,v")):
        path = write(name, text)
        for by in ("rows", "count", "bytes"):
            split = split_lines(spark, path, by, 3)
            assert split.total_rows == 0 and split.rows.count() == 0
    out = str(tmp_path / "o")
    split_file(spark, write("h2.csv", "id,v\n"), out, "rows", 3)
    assert files_in_order(out) == ["id,v\n"]


def test_unknown_method_and_bad_number(spark, ten):
    with pytest.raises(ValueError):
        split_lines(spark, ten, "pages", 3)
    with pytest.raises(ValueError):
        split_lines(spark, ten, "rows", 0)


def test_records_stay_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, f'l1 "{i}"\nl2,{i}') for i in range(20)], "id int, v string")
    out = str(tmp_path / "o")
    split_table_to_csv(df, out, "rows", 6, ["id"], layout="files")
    files = sorted(f for f in os.listdir(out) if f.endswith(".csv") and not f.startswith("."))
    assert len(files) == 4
    for i, f in enumerate(files):
        rows = scan_csv(spark, f"{out}/{f}", multi_line=True).collect()
        assert [r["id"] for r in rows] == list(range(i * 6, min(i * 6 + 6, 20)))
        assert all(r["v"] == f'l1 "{r["id"]}"\nl2,{r["id"]}' for r in rows)


@pytest.mark.parametrize("n", [10, 100_000])
def test_layout_does_not_follow_the_size(spark, tmp_path, n):
    df = spark.range(n)
    assert split_table_to_csv(df, str(tmp_path / "a"), "count", 2, ["id"]).layout == "folders"
    assert sorted(f for f in os.listdir(tmp_path / "a") if f[0] not in "._") == ["part=1", "part=2"]


def test_columns_of_the_user_are_kept(spark, tmp_path):
    df = spark.range(12).selectExpr("id % 5 AS part", "id AS _chunk", "id AS n_rows")
    out = str(tmp_path / "o")
    split_table_to_csv(df, out, "rows", 5, ["part", "_chunk"], layout="files")
    rows = scan_csv(spark, out).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, df.collect()))
    for name in ("part", "_chunk", "_PLACE"):
        with pytest.raises(ValueError, match="rename"):
            split_table(spark.range(3).toDF(name), "rows", 2, [name])


def test_split_then_merge_gives_the_input(spark, ten, tmp_path):
    parts, merged = str(tmp_path / "parts"), str(tmp_path / "merged")
    split_file(spark, ten, parts, "rows", 3, layout="files")
    names = sorted(f for f in os.listdir(parts) if f.endswith(".csv") and not f.startswith("."))
    write_merged_lines(spark, [f"{parts}/{n}" for n in names], merged, header="first")
    assert "".join(files_in_order(merged)) == open(ten).read()


@pytest.mark.parametrize("changed", ["block_start", "file_key"])
def test_rows_of_an_unknown_split_raise(spark, ten, changed):
    ordered = order_lines(spark, [ten])
    moved = dataclasses.replace(ordered, starts=ordered.starts.withColumn(changed, F.col(changed) + 1024))
    for wrong in (moved, dataclasses.replace(ordered, starts=ordered.starts.where("false"))):
        with pytest.raises(Exception, match="changed between two scans"):
            numbering.with_row_numbers(wrong).select(numbering.ROW).collect()
        with pytest.raises(Exception, match="changed between two scans"):
            assign_parts(wrong, "rows", 3).rows.select("part").collect()


def test_hot_key_spreads(spark):
    """A third of all rows share one key, and half of those are copies of one row."""
    df = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, 5).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") < 5_000, 0).otherwise(F.col("id")).alias("v"),
    )
    ordered = numbering.order_rows(df, ["k"])
    sizes = [r["n_rows"] for r in ordered.starts.collect()]
    assert sum(sizes) == 30_000 and max(sizes) < 10_000
    rows = numbering.with_row_numbers(ordered)
    assert rows.select(numbering.ROW).distinct().count() == 30_000
    assert rows.where((F.col(numbering.ROW) <= 10_000) != (F.col("k") == 5)).count() == 0


def test_no_task_gets_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).selectExpr("id", "string(id) AS s").write.parquet(path)
    for by, n in (("rows", 700), ("count", 7), ("bytes", 900)):
        split = split_table(spark.read.parquet(path), by, n, ["id"], unique=True)
        assert "SinglePartition" not in split.rows._jdf.queryExecution().executedPlan().toString()


def test_numbers_follow_the_order(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"))
    rows = numbering.with_row_numbers(numbering.order_rows(df, ["k"], unique=True))
    assert rows.where(F.col("k") + 1 != F.col(numbering.ROW)).count() == 0
    rows = numbering.with_row_numbers(numbering.order_rows(df, [F.col("k").desc()]))
    assert rows.where(3000 - F.col("k") != F.col(numbering.ROW)).count() == 0


def _greedy(lines, target, early, late):
    """Part of each line, by going through the bytes once."""
    total, at, parts = sum(len(x) + 1 for x in lines), 0, []
    ends = list(itertools.accumulate(len(x) + 1 for x in lines))
    cuts = []
    while at < total:
        stop = total
        if at + target < total:
            stop = next((e for e in ends if e > at + max(target - early, 0)), total)
            stop = stop if stop <= at + target + late else total
        cuts.append(stop)
        at = stop
    for e in ends:
        parts.append(next(k for k, c in enumerate(cuts, 1) if e <= c))
    return parts


@pytest.mark.parametrize(("target", "early", "late"), [(1, 4, 30), (64, 4, 30), (13, 0, 9), (1500, 1024, 1 << 20)])
def test_greedy_cuts_against_plain_python(spark, write, target, early, late):
    rng = random.Random(early)
    lines = ["x" * rng.choice([0, 1, 2, 5, 9, 25]) for _ in range(150)]
    for kind in (lines, [*lines[:100], "y" * 170, *lines[100:]], ["ab"] * 80):
        path = write(f"g{len(kind)}.csv", "h\n" + "".join(x + "\n" for x in kind))
        rows, sizes = with_greedy_parts(order_lines(spark, [path], measured=True), target, early, late)
        expected = Counter(_greedy(kind, target, early, late))
        assert {r["part"]: r["rows"] for r in sizes.collect()} == expected
        assert Counter(r["part"] for r in rows.select("part").collect()) == expected


def test_greedy_split_of_many_chunks(spark, write, tmp_path):
    rng = random.Random(5)
    lines = [f"{i}," + "é" * rng.choice([3, 40, 400]) for i in range(9000)]
    path = write("many.csv", "h,v\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(300_000))
    try:
        split = split_lines(spark, path, "bytes", 200_000, cut="greedy")
        result = split_file(spark, path, str(tmp_path / "o"), "bytes", 200_000, layout="files", cut="greedy")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    parts = _greedy([x.encode() for x in lines], 200_000, 1024, 1 << 20)
    expected = Counter(parts)
    assert len(expected) > 10 and {r["part"]: r["rows"] for r in manifest(split).collect()} == expected
    texts = files_in_order(result.path)
    by_part = [[x for x, p in zip(lines, parts) if p == k] for k in sorted(expected)]
    assert texts == ["h,v\n" + "".join(x + "\n" for x in own) for own in by_part]


def test_greedy_cut_of_an_empty_file_and_of_rows(spark, write):
    empty = write("none.csv", "h\n")
    assert split_lines(spark, empty, "bytes", 100, cut="greedy").rows.count() == 0
    for by, cut in (("rows", "greedy"), ("bytes", "other")):
        with pytest.raises(ValueError, match="cut"):
            split_lines(spark, empty, by, 5, cut=cut)


def test_parts_of_a_table_are_read_back_in_pieces(spark, tmp_path):
    from rowsheaf import read_parts

    text = F.concat(F.lit("two\r\nlines, "), F.col("id").cast("string"), F.lit('\n"end"\r'))
    text = F.when(F.col("id") % 5 < 4, text)
    df = spark.range(400).select("id", text.alias("part"), F.lit(None).cast("double").alias("chunk"))
    out = str(tmp_path / "out")
    split_table_to_csv(df.toDF("id", "text", "none"), out, "count", 3, ["id"], prefix="p")
    rows = read_parts(spark, out, df.schema, prefix="p")
    assert rows.columns == ["file", "id", "part", "chunk"] and rows.drop("file").exceptAll(df).isEmpty()
    assert Counter(r["file"] for r in rows.collect()) == {"p_0001.csv": 134, "p_0002.csv": 134, "p_0003.csv": 132}
    assert max(r["id"] for r in rows.where("file = 'p_0001.csv'").collect()) == 133
    files = [len(os.listdir(f"{out}/part={i}")) - 1 for i in (1, 2, 3)]
    assert min(files) > 1


def test_the_query_of_whole_records_spreads_each_part(spark, tmp_path):
    import __spark_entry__

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit('a\n"b"'), F.col("id").cast("string")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = __spark_entry__.queries()["split_records"](spark, str(tmp_path))
    assert rows.groupBy("file").count().where("count = 200").count() == 5 and rows.drop("file").exceptAll(docs).isEmpty()
    read = [f for f in rows.inputFiles() if "chunk=1" not in f]
    assert len(read) > 5  # one for each part before
