"""Keyed counters fed by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rowsheaf.operators.counter import count_events
from rowsheaf.streaming.tables import VersionedTable


def counter_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, keys=["key"])


def follow_counter(
    events: DataFrame, table: VersionedTable, checkpoint: str, key: str, ts: str, every: str | None = None
) -> StreamingQuery:
    """Keep ``table`` at one row per key while events arrive.

    The counts are Spark's own keyed state; each batch writes the new absolute values of the keys it
    touched, so its cost follows the batch, not the number of keys, and a replay changes nothing.
    """
    return table.follow(count_events(events, key, ts), checkpoint, "update", every)
