"""Keyed event counters: insert a first count, or add to the one that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTER_COLUMNS = ["key", "download_count", "created_at", "updated_at"]


def count_events(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Counter rows of a set of events. Partial counts are merged before the shuffle, so a hot key is one row per task."""
    return events.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("download_count"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at")
    )


def upsert(counters: DataFrame, added: DataFrame) -> DataFrame:
    """``counters`` with ``added`` counted in; one aggregation over both."""
    return (
        counters.select(*COUNTER_COLUMNS)
        .unionByName(added.select(*COUNTER_COLUMNS))
        .groupBy("key")
        .agg(
            F.sum("download_count").alias("download_count"),
            F.min("created_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
    )
