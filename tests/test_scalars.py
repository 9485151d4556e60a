import pytest
from pyspark.sql import functions as F

from rowsheaf.functions import clean_column_name, clean_filename, clean_value, format_file_size, local_timestamp


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn("v").alias("o")).orderBy("i").collect()]


def test_clean_value(spark):
    values = [None, "", " a\t\r\nb ", "\u3000x ", "\x1fy", "a b"]
    assert _apply(spark, values, clean_value) == ["", "", "ab", "x", "y", "a b"]


def test_clean_filename(spark):
    values = ['a<b>:"/\\|?*c', "  ..x.. ", "", " . ", "y" * 300, ". a ."]
    expected = ["a_b________c", "x", "output", "output", "y" * 200, " a "]
    assert _apply(spark, values, clean_filename) == expected


@pytest.mark.parametrize(
    ("size", "text"),
    [
        (0, "0.0 B"),
        (1023, "1023.0 B"),
        (1024, "1.0 KB"),
        (1280, "1.2 KB"),  # a tie goes to the even digit
        (1792, "1.8 KB"),
        (1024**2 - 1, "1024.0 KB"),
        (1024**3, "1.0 GB"),
        (5 * 1024**4, "5.0 TB"),
        (3000 * 1024**4, "3000.0 TB"),
    ],
)
def test_format_file_size(spark, size, text):
    assert spark.range(1).select(format_file_size(F.lit(size)).alias("s")).first()["s"] == text


def test_clean_column_name(spark):
    df = spark.createDataFrame([(1, " a b "), (2, "'q'"), (3, "  "), (4, None), (5, "a\u3000\tb")], "pos int, name string")
    rows = df.select("pos", clean_column_name("name", "pos").alias("c")).orderBy("pos").collect()
    assert [r["c"] for r in rows] == ["ab", "q", "列_3", "", "ab"]


def test_local_timestamp(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 20:00:00' AS t").select(local_timestamp("t").alias("l"))
    assert str(df.first()["l"]) == "2024-01-02 04:00:00"
