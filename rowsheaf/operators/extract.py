"""Extract the rows where one column matches one value."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rowsheaf.functions.predicates import match_column
from rowsheaf.operators.profile import resolve_column
from rowsheaf.plans.files import delete_tree
from rowsheaf.sinks.csv import write_csv


@dataclass(frozen=True)
class ExtractResult:
    rows: int
    seconds: float
    path: str | None  # None when nothing matched: then nothing is left on disk


def extract(df: DataFrame, column: str, value: object, precision: str = "float32") -> DataFrame:
    """Rows of ``df`` whose ``column`` (original or cleaned name) matches ``value``; nothing runs yet."""
    return df.where(match_column(df, resolve_column(df.columns, column), value, precision))


def count_matches(df: DataFrame, column: str, value: object, precision: str = "float32") -> DataFrame:
    """``n``, the number of matching rows; only ``column`` is read."""
    return extract(df, column, value, precision).agg(F.count(F.lit(1)).alias("n"))


def extract_to_csv(
    df: DataFrame, column: str, value: object, out: str, precision: str = "float32", bom: bool = True, rebalance: bool = False
) -> ExtractResult:
    """Write the matching rows as CSV, counting them in the same pass.

    Each task writes what it finds, without a shuffle. With ``rebalance`` the rows are brought together
    into files of the session's advisory size first, for matches that are few and spread thinly.
    """
    started = time.monotonic()
    seen = Observation("extract")
    found = extract(df, column, value, precision)
    found = found.hint("rebalance") if rebalance else found
    # Counted after the rebalancing: a stage that turns out empty is cut from the plan, its counts too.
    write_csv(found.observe(seen, F.count(F.lit(1)).alias("rows")), out, bom=bom)
    rows = seen.get["rows"]
    if rows == 0:
        delete_tree(df.sparkSession, out)
    return ExtractResult(rows, time.monotonic() - started, out if rows else None)
