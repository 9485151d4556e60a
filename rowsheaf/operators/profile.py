"""What a table looks like: columns, cleaned names, types, rows, size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.functions.scalars import EMPTY_COLUMN_NAME, clean_column_name
from rowsheaf.sources.inventory import file_inventory
from rowsheaf.sources.tables import scan_csv

_TYPE_NAMES = {
    T.ByteType: "BIGINT",
    T.ShortType: "BIGINT",
    T.IntegerType: "BIGINT",
    T.LongType: "BIGINT",
    T.FloatType: "DOUBLE",
    T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
}


def type_name(dtype: T.DataType) -> str:
    """Name of a column type as the profile shows it."""
    return _TYPE_NAMES.get(type(dtype), "VARCHAR")


def name_mapping(columns: list[str]) -> dict[str, str]:
    """Cleaned name -> original name. Two columns with one cleaned name raise."""
    mapping: dict[str, str] = {}
    for position, name in enumerate(columns, 1):
        clean = re.sub(r"[\"'\s]", "", name) or f"{EMPTY_COLUMN_NAME}{position}"
        if clean in mapping:
            raise ValueError(f"columns {mapping[clean]!r} and {name!r} have the same cleaned name {clean!r}")
        mapping[clean] = name
    return mapping


def resolve_column(columns: list[str], column: str) -> str:
    """The column meant by an original or a cleaned name."""
    if column in columns:
        return column
    mapping = name_mapping(columns)
    if column not in mapping:
        raise KeyError(column)
    return mapping[column]


def describe_columns(df: DataFrame) -> DataFrame:
    """``pos, column, original, type``, one row per column; built from the schema alone."""
    name_mapping(df.columns)
    rows = [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "pos int, original string, type string").select(
        "pos", clean_column_name("original", "pos").alias("column"), "original", "type"
    )


def column_profile(spark: SparkSession, path: str, sample_rows: int | None = None, **scan) -> DataFrame:
    """:func:`describe_columns` of a CSV file, with its ``total_rows`` and ``size_mb`` on each row."""
    df = scan_csv(spark, path, sample_rows=sample_rows, **scan)
    total = df.select(F.lit(1)).agg(F.count("*")).first()[0]
    size = file_inventory(spark, [path]).agg(F.sum("size")).first()[0] or 0
    return describe_columns(df).select(
        "*", F.lit(total).cast("long").alias("total_rows"), F.lit(size / (1024 * 1024)).alias("size_mb")
    )
