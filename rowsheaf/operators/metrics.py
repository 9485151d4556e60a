"""Activity metrics over an event table, as of a given instant.

Every function reads only the columns it needs, and its time range reaches the file scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
RECENT_MINUTES = 5
TREND_HOURS = 24
LATEST_ROWS = 15


def instant(events: DataFrame, ts: str, as_of: datetime | str | Column) -> Column:
    """``as_of`` in the type of the time column, so that comparing needs no cast of the column."""
    now = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return now.cast(events.schema[ts].dataType)


def _day_start(events: DataFrame, ts: str, now: Column) -> Column:
    if not _is_instant(events, ts):
        return F.date_trunc("day", now).cast(events.schema[ts].dataType)
    return F.from_utc_timestamp(F.date_trunc("day", _utc_clock(events, ts, now)), F.current_timezone())


def _is_instant(events: DataFrame, ts: str) -> bool:
    return isinstance(events.schema[ts].dataType, T.TimestampType)


def _utc_clock(events: DataFrame, ts: str, at: Column) -> Column:
    """``at`` so that its hour and day are those in UTC, whatever the session's zone; a clock reading is UTC already."""
    return F.to_utc_timestamp(at, F.current_timezone()) if _is_instant(events, ts) else at


def _recent(now: Column) -> Column:
    return now - F.expr(f"INTERVAL '{RECENT_MINUTES}' MINUTE")


def total(events: DataFrame) -> DataFrame:
    """``n``, rows in the table."""
    return events.agg(F.count(F.lit(1)).alias("n"))


def today(events: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    """``n``, rows since the start of the UTC day."""
    now = instant(events, ts, as_of)
    return total(events.where((F.col(ts) >= _day_start(events, ts, now)) & (F.col(ts) <= now)))


def last_minutes(events: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    """``n``, rows of the last five minutes, both ends included."""
    now = instant(events, ts, as_of)
    return total(events.where((F.col(ts) >= _recent(now)) & (F.col(ts) <= now)))


def core(events: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    """``total, today, last_5m`` in one pass."""
    now = instant(events, ts, as_of)
    return events.where(F.col(ts) <= now).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(ts) >= _day_start(events, ts, now)).alias("today"),
        F.count_if(F.col(ts) >= _recent(now)).alias("last_5m"),
    )


def trend(events: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    """``hour, n`` for the 24 UTC hours of the day over the last 24 hours; no row if nothing happened.

    The 24 counters are one aggregate, merged before the shuffle: one row per task leaves the scan.
    """
    now = instant(events, ts, as_of)
    window = events.where((F.col(ts) >= now - F.expr(f"INTERVAL '{TREND_HOURS}' HOUR")) & (F.col(ts) <= now))
    counts = F.array(*[F.count_if(F.hour(_utc_clock(events, ts, F.col(ts))) == h) for h in range(24)])
    return (
        window.agg(counts.alias("counts"), F.count(F.lit(1)).alias("total"))
        .where(F.col("total") > 0)
        .select(F.posexplode("counts").alias("hour", "n"))
    )


def latest(events: DataFrame, columns: list[str], ts: str = "created_at", key: str = "id", n: int = LATEST_ROWS) -> DataFrame:
    """The ``n`` newest rows, the higher ``key`` first among equals; a top-n per task, then a merge."""
    return events.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n).select(*columns)
