"""Spreadsheet-friendly CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.sources.tables import BOM, quoted, scan_csv

WRITE_OPTIONS = {
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "emptyValue": '""',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _printed(df: DataFrame) -> list[Column]:
    """Columns as they are written: times as text, to the microsecond and without trailing zeros."""
    return [
        quoted(f.name).cast("string").alias(f.name) if isinstance(f.dataType, _TIMES) else quoted(f.name)
        for f in df.schema.fields
    ]


def write_csv(df: DataFrame, out: str, header: bool = True, bom: bool = False, mode: str = "errorifexists") -> None:
    """Write ``df`` as a folder of CSV files, each with the header; ``bom`` marks each as UTF-8."""
    df = df.select(*_printed(df))
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.options(**WRITE_OPTIONS).option("header", header).mode(mode).csv(out)


def read_export(spark: SparkSession, out: str, schema: T.StructType, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Read back what :func:`write_csv` wrote."""
    return scan_csv(spark, out, schema, header=header, multi_line=multi_line)


def csv_line(df: DataFrame) -> Column:
    """The CSV text of a row of ``df``, as :func:`write_csv` would write it."""
    return F.to_csv(F.struct(*_printed(df)), WRITE_OPTIONS)


def header_text(columns: list[str]) -> str:
    """The CSV text of a header."""
    shown = ['"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\r\n') else c for c in columns]
    return ",".join(shown)
