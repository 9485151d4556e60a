"""CSV files as tables: header row, types from all rows, from a sample, or given; any file suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.plans.files import list_inputs

BOM = "\ufeff"

# Tried in this order; a column takes the first type all its sampled values have.
_TYPE_TESTS = [
    (T.LongType(), r"^[+-]?\d+$", "bigint"),
    (T.DoubleType(), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", "double"),
    (T.BooleanType(), r"(?i)^(true|false)$", "boolean"),
    (T.DateType(), r"^\d{4}-\d{1,2}-\d{1,2}$", "date"),
    (T.TimestampNTZType(), r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$", "timestamp_ntz"),
]

READ_OPTIONS = {"quote": '"', "escape": '"', "enforceSchema": "true"}


def _reader(spark: SparkSession, sep: str, header: bool, multi_line: bool, encoding: str | None):
    reader = spark.read.options(**READ_OPTIONS).option("sep", sep)
    reader = reader.option("header", header).option("multiLine", multi_line)
    if encoding and encoding.lower() not in ("utf-8", "utf-8-sig"):
        if encoding.lower() in ("gbk", "gb18030") and spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        # With its line end named, wide text is cut into lines without reading a file whole.
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    return reader


def header_names(
    spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str | None = None, multi_line: bool = False
) -> list[str]:
    """Names in the header of the first file, without a byte order mark."""
    names = _reader(spark, sep, True, multi_line, encoding).csv(path).columns
    return [n.removeprefix(BOM) for n in names]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def infer_types(df: DataFrame, sample_rows: int | None = None) -> T.StructType:
    """Types of an all-text table from every row, by one aggregate, or from the first ``sample_rows``.

    NULL fits every type; a column of NULLs only is text, and so is a time of day. A cell says what it fits as the bits of
    a number, and a column's types are the bits that all its cells have.
    """
    # A limit inside a plan runs every task; taking the first rows reads as few splits as it needs.
    sample = df if sample_rows is None else df.sparkSession.createDataFrame(df.take(sample_rows), df.schema)
    found = sample.agg(*[F.bit_and(_type_bits(quoted(name))).alias(f"c{i}") for i, name in enumerate(df.columns)]).first()
    fields = []
    for name, bits in zip(df.columns, found):
        types = [dtype for i, (dtype, _, _) in enumerate(_TYPE_TESTS) if (bits or 0) >> i & 1]
        fields.append(T.StructField(name, types[0] if types else T.StringType()))
    return T.StructType(fields)


def _type_bits(c: Column) -> Column:
    """The types of :data:`_TYPE_TESTS` that a cell fits, as bits; NULL for NULL.

    Whole numbers are decimal numbers too; otherwise a cell fits one type at most, and its first character tells which
    of them to try. Most text is told by that alone.
    """

    def fits(i: int) -> Column:
        _, regex, to = _TYPE_TESTS[i]
        return c.rlike(regex) & c.try_cast(to).isNotNull()

    whole, number, truth, day, instant = range(len(_TYPE_TESTS))
    first = F.substring(c, 1, 1)
    digits = F.when(fits(whole), F.when(fits(number), 1 << whole | 1 << number).otherwise(1 << whole))
    digits = digits.when(fits(number), 1 << number).when(fits(day), 1 << day).when(fits(instant), 1 << instant)
    bits = F.when(first.between("0", "9") | first.isin("+", "-", "."), digits.otherwise(0))
    bits = bits.when(first.isin(*"tTfF"), F.when(fits(truth), 1 << truth).otherwise(0))
    return F.when(c.isNotNull(), bits.otherwise(0))


def scan_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    sep: str = ",",
    header: bool = True,
    encoding: str | None = None,
    multi_line: bool = False,
    sample_rows: int | None = None,
) -> DataFrame:
    """CSV table. Without a schema the types come from all rows, or the first ``sample_rows``.

    A later row that does not fit the schema raises; it is never read as NULL. ``multi_line`` keeps
    records with quoted line ends whole, at the price that a file is not split between tasks; ``scan_csv_records`` splits it.
    A file that Spark would leave out for its name (``_x.csv``) raises.
    """
    list_inputs(spark, [path] if isinstance(path, str) else path)
    reader = _reader(spark, sep, header, multi_line, encoding)
    if schema is None:
        names = header_names(spark, path, sep, encoding, multi_line)
        schema = infer_types(reader.schema(text_schema(names)).csv(path), sample_rows)
    return _reader(spark, sep, header, multi_line, encoding).option("mode", "FAILFAST").schema(schema).csv(path)


def count_rows(df: DataFrame) -> DataFrame:
    """``total_rows``, one row."""
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")
