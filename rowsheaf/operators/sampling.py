"""Example values of a column, to pick a search value from."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsheaf.functions.scalars import clean_value
from rowsheaf.operators.profile import resolve_column
from rowsheaf.sources.tables import quoted

# Fixed values
SAMPLE_ROWS = 10_000
SHOWN_VALUES = 50


def random_rows(df: DataFrame, n: int, available: int, seed: int | None = None) -> DataFrame:
    """``n`` random rows out of ``available``.

    A top-n over random numbers alone would send ``n`` rows from every task to one. Rows are thinned
    first, to ``n`` plus ten standard deviations, so that the top-n merges little more than ``n``.
    """
    fraction = min(1.0, (n + 10 * math.sqrt(n) + 10) / max(available, 1))
    thinned = df if fraction >= 1.0 else df.withColumn("_r", F.rand(seed)).where(F.col("_r") < fraction)
    key = F.rand(None if seed is None else seed + 1)
    return thinned.orderBy(key).limit(n).select(*[quoted(c) for c in df.columns])


def sample_values(
    df: DataFrame, column: str, limit: int = SHOWN_VALUES, sample_rows: int | None = SAMPLE_ROWS, seed: int | None = None
) -> DataFrame:
    """Up to ``limit`` distinct cleaned values ``v`` of ``column``, in the column's order.

    A table of more than ``sample_rows`` rows is represented by that many random non-NULL rows;
    with ``None`` all rows count, however many.
    """
    name = resolve_column(df.columns, column)
    present = df.select(quoted(name).alias("raw")).where(F.col("raw").isNotNull())
    facts = df.agg(F.count(F.lit(1)).alias("total"), F.count(quoted(name)).alias("present")).first()
    if sample_rows is not None and facts["total"] > sample_rows:
        present = random_rows(present, sample_rows, facts["present"], seed)
    # Twice as many as wanted, since cleaning may blank or merge some.
    first = present.distinct().orderBy("raw").limit(2 * limit)
    shown = F.initcap(F.col("raw").cast("string")) if isinstance(df.schema[name].dataType, T.BooleanType) else F.col("raw")
    values = first.select("raw", clean_value(shown).alias("v")).where(F.col("v") != "")
    return values.groupBy("v").agg(F.min("raw").alias("raw")).orderBy("raw").limit(limit).select("v")
