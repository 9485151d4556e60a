"""Event metrics kept current while events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from rowsheaf.operators import metrics
from rowsheaf.streaming.tables import SummedTable, VersionedTable, start

# Fixed values
LIVE_REFRESH = "30 seconds"
IDLE_REFRESH = "60 seconds"
RATE_WINDOW, RATE_SLIDE = "5 minutes", "1 minute"


def read_events(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream: those there, then those that come."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _windowed(events: DataFrame, ts: str, length: str, slide: str | None, lateness: str | None) -> DataFrame:
    # Windows start at instants; a clock reading is one in UTC, whatever the session's zone.
    at = F.col(ts).cast("timestamp")
    if not isinstance(events.schema[ts].dataType, T.TimestampType):
        at = F.from_utc_timestamp(at, F.current_timezone())
    timed = events.select(at.alias("_at"))
    # Only a caller who can do without events later than that names a lateness.
    timed = timed.withWatermark("_at", lateness) if lateness else timed
    window = F.window("_at", length, slide) if slide else F.window("_at", length)
    counts = timed.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.to_utc_timestamp("w.start", F.current_timezone()).cast("timestamp_ntz").alias("window_start"), "n")


def moving_rate(events: DataFrame, ts: str = "created_at", lateness: str | None = None) -> DataFrame:
    """``window_start, n`` of five-minute windows, one starting each minute."""
    return _windowed(events, ts, RATE_WINDOW, RATE_SLIDE, lateness)


def hourly(events: DataFrame, ts: str = "created_at", lateness: str | None = None) -> DataFrame:
    """``window_start, n`` per hour."""
    return _windowed(events, ts, "1 hour", None, lateness)


def daily(events: DataFrame, ts: str = "created_at", lateness: str | None = None) -> DataFrame:
    """``window_start, n`` per UTC day."""
    return _windowed(events, ts, "1 day", None, lateness)


def follow_windows(events: DataFrame, windows, table: SummedTable, checkpoint: str, ts: str = "created_at", every: str | None = None) -> StreamingQuery:
    """Add the window counts of each batch to ``table``; ``windows`` is one of the three functions above.

    Counts are sums, so the stream keeps no state: a window that is long over costs nothing, and a late row is added
    to it all the same. What grows is the table, by one row per window once its batches are folded.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        table.write(windows(batch, ts), batch_id)

    return start(events.writeStream.foreachBatch(on_batch), checkpoint, every)


def refresh_on_timer(
    spark: SparkSession, event_table, table: VersionedTable, checkpoint: str, as_of, ts: str = "created_at", every: str = LIVE_REFRESH
) -> StreamingQuery:
    """Refresh the core metrics in ``table`` every ``every`` (:data:`IDLE_REFRESH` where nobody looks), until stopped.

    A clock stream wakes it, so "today" and "last 5 minutes" also fall when no event comes.
    ``event_table()`` is a batch read and ``as_of()`` the instant of each refresh.
    """
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def on_tick(batch: DataFrame, batch_id: int) -> None:
        table.write(metrics.core(event_table(), as_of(), ts), batch_id)

    return start(clock.writeStream.foreachBatch(on_tick), checkpoint, every)


class MetricTables:
    """``core``, ``trend`` and ``latest`` tables, recomputed from the event table on every change."""

    def __init__(self, spark: SparkSession, path: str):
        self.core = VersionedTable(spark, f"{path}/core")
        self.trend = VersionedTable(spark, f"{path}/trend")
        self.latest = VersionedTable(spark, f"{path}/latest")

    def refresh(self, events: DataFrame, batch_id: int, as_of, ts: str, key: str, columns: list[str]) -> None:
        self.core.write(metrics.core(events, as_of, ts), batch_id)
        self.trend.write(metrics.trend(events, as_of, ts), batch_id)
        self.latest.write(metrics.latest(events, columns, ts, key), batch_id)


def follow_metrics(
    changes: DataFrame,
    event_table,
    tables: MetricTables,
    checkpoint: str,
    as_of,
    ts: str = "created_at",
    key: str = "id",
    columns: list[str] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Refresh all metrics whenever ``changes`` brings rows.

    ``changes`` only wakes the refresh; the numbers come from ``event_table()``, a batch read whose
    time filters prune it. ``as_of()`` gives the instant of each refresh.
    """

    def on_change(batch: DataFrame, batch_id: int) -> None:
        tables.refresh(event_table(), batch_id, as_of(), ts, key, columns or [key, ts])

    return start(changes.writeStream.foreachBatch(on_change), checkpoint, every)
