import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import files_in_order
from rowsheaf import count_matches, extract, extract_to_csv, scan_csv

ROWS = [
    (0, None, None, None),
    (1, 0, 0.0, ""),
    (2, 7, 1.1, " \t\n "),
    (3, 16777216, 7.0, "007"),
    (4, 16777217, 7.0000004, " 7.0 "),
    (5, -3, float("nan"), "3d"),
    (6, 1000, float("inf"), "1_000"),
    (7, 70, 7.1, "a\tb"),
    (8, 5, -0.0, "ab\r"),
    (9, 1, 1.1000001, " ab "),
    (10, 2, 0.05, "7e0"),
]
SCHEMA = "id int, i bigint, f double, s string"


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _ids(df, column, value, **options):
    return sorted(r["id"] for r in extract(df, column, value, **options).collect())


@pytest.mark.parametrize(
    ("column", "value", "ids"),
    [
        ("i", "", [0, 1]),
        ("i", " \t\r\n", [0, 1]),
        ("i", None, [0, 1]),
        ("f", "", [0, 1, 8]),
        ("s", "", [0, 1, 2]),
        ("i", "7", [2]),
        ("i", "7.0", [2]),
        ("i", "-3", [5]),
        ("i", "1_000", [6]),
        ("i", "1e3", [6]),
        ("i", "16777216", [3, 4]),  # 32-bit floats cannot tell these apart
        ("i", "7.5", []),
        ("f", "7", [3, 4]),
        ("f", "1.1", [2, 9]),
        ("f", "0.05", [10]),
        ("f", "nan", [5]),
        ("f", "inf", [6]),
        ("i", "abc", []),
        ("s", "7", [3, 4, 10]),
        ("s", "1000", [6]),
        ("s", "3", []),  # "3d" is no number
        ("s", "3d", [5]),
        ("s", "ab", [7, 9]),  # a stored carriage return stays in the way
        ("s", " ab\n", [7, 9]),
        ("s", "nan", []),
    ],
)
def test_match(mixed, column, value, ids):
    assert _ids(mixed, column, value) == ids


def test_double_precision_tells_large_numbers_apart(mixed):
    assert _ids(mixed, "i", "16777216", precision="double") == [3]


@pytest.mark.parametrize("number", [0, 1, -1, 7, 16777215, 16777217, 33554435, 2**53 + 1, 2**63 - 1, -(2**63)])
def test_implied_range_loses_nothing(spark, number):
    """Every neighbour that equals the number in 32 bits is found."""
    import numpy as np

    near = sorted({max(min(number + d, 2**63 - 1), -(2**63)) for d in (-600, -5, -2, -1, 0, 1, 2, 5, 600)})
    df = spark.createDataFrame([(n,) for n in near], "id bigint")
    expected = [n for n in near if np.float32(n) == np.float32(number)]
    assert _ids(df, "id", str(number)) == expected


def test_other_types(spark):
    df = spark.sql(
        "SELECT 1 AS id, date'2024-01-02' AS d, timestamp_ntz'2024-01-02 03:04:05' AS t, true AS k, 1.5BD AS n"
    )
    assert _ids(df, "d", "2024-01-02") == [1]
    assert _ids(df, "d", "2024") == []
    assert _ids(df, "t", "2024-01-02 03:04:05") == [1]
    assert _ids(df, "k", "1") == [1]
    assert _ids(df, "k", "true") == [1]
    assert _ids(df, "n", "1.5") == [1]
    assert _ids(df, "d", "") == []


def test_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(1000).select("id", (F.col("id") / 7).alias("f"), F.lit("x").alias("wide")).write.parquet(path)
    df = spark.read.parquet(path)
    plan = extract(df, "id", "7").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "wide" not in plan
    plan = extract(df, "f", "0.5").select("f")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(f" in plan
    assert "ReadSchema: struct<id:bigint>" in count_matches(df, "id", "7")._jdf.queryExecution().executedPlan().toString()


def test_absent_text_reads_no_rows(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(5000).selectExpr("id", "concat('kind-', id % 7) AS kind").coalesce(1).write.parquet(path)
    for value, scanned in (("kind-9", 0), ("kind-3", 5000)):
        found = extract(spark.read.parquet(path), "kind", value)
        assert len(found.collect()) == (714 if scanned else 0)
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        assert scan.metrics().get("numOutputRows").get().value() == scanned


@pytest.mark.parametrize("value", ["", "ab", "a b", "b"])
def test_plain_test_loses_no_text(spark, value):
    """Every way to pad a text with tabs, line feeds and spaces, and what does not count as padding."""
    pads = ["", " ", "\t", "\n", " \t ", "\r", "\u3000", "  \n"]
    texts = [None, *{p + core + q for core in ("", "ab", "a\tb", "a b", "a\nb", "b", "x") for p in pads for q in pads}]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")

    def hit(s):
        plain = None if s is None else s.replace("\t", "").replace("\n", "").strip(" ")
        return plain == value or (value == "" and s is None)

    assert _ids(df, "s", value) == [i for i, s in enumerate(texts) if hit(s)]


def test_unknown_column_and_precision(mixed):
    with pytest.raises(KeyError):
        extract(mixed, "nope", "1")
    with pytest.raises(ValueError):
        extract(mixed, "i", "1", precision="half")


def test_cleaned_name(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], T.StructType.fromDDL("id int, v string")).toDF("id", ' "my col" ')
    assert _ids(df, "mycol", "x") == [1]


def test_extract_to_csv(spark, mixed, tmp_path):
    out = str(tmp_path / "out")
    result = extract_to_csv(mixed, "s", "ab", out)
    assert (result.rows, result.path) == (2, out)
    assert all(t.startswith("\ufeffid,") for t in files_in_order(out))
    assert scan_csv(spark, out, multi_line=True).columns == ["id", "i", "f", "s"]


def test_nothing_found_leaves_nothing(mixed, tmp_path):
    out = tmp_path / "none"
    result = extract_to_csv(mixed, "s", "no such value", str(out))
    assert (result.rows, result.path) == (0, None)
    assert not out.exists()


def test_against_plain_python(spark):
    """The dispatch against a plain re-statement of the rules."""
    data = [(i, v) for i, v in enumerate([None, "", " ", "5", "05", "5.0", " 5", "x5", "5x", "1_0", "10", "\t5", "1e1", "é"])]
    df = spark.createDataFrame(data, "id int, s string")

    def number(text):
        try:
            f = float(text)
            return f if math.isfinite(f) else None
        except ValueError:
            return None

    for value in ["", "5", "10", "x5", "é", "1_0"]:
        expected = []
        for i, s in data:
            plain = None if s is None else s.replace("\t", "").replace("\n", "").strip(" ")
            if value == "":
                hit = s is None or plain == ""
            elif number(value) is not None:
                hit = s is not None and number(s) == number(value)
            else:
                hit = plain == value
            expected += [i] if hit else []
        assert _ids(df, "s", value) == expected, value
