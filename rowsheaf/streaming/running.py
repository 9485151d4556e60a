"""All metrics from maintained counts: a batch adds what it brings, and the event table is not read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowsheaf.operators import metrics
from rowsheaf.streaming.metrics import LIVE_REFRESH
from rowsheaf.streaming.tables import SummedTable, VersionedTable, start

# Instants stay as they are for so many hours, the trend's and one to spare; older ones become their days.
EXACT_HOURS = metrics.TREND_HOURS + 1
# Newest rows that are kept, so that deleted ones have successors at hand.
RESERVE = 4 * metrics.LATEST_ROWS


def core_of(counts: DataFrame, as_of) -> DataFrame:
    """``total, today, last_5m`` from ``at, n``: so many events at that instant."""
    now = metrics.instant(counts, "at", as_of)

    def since(start=None):
        return F.coalesce(F.sum(F.when(F.col("at") >= start, F.col("n")) if start is not None else F.col("n")), F.lit(0))

    return counts.where(F.col("at") <= now).agg(
        since().alias("total"), since(metrics._day_start(counts, "at", now)).alias("today"), since(metrics._recent(now)).alias("last_5m")
    )


def trend_of(counts: DataFrame, as_of) -> DataFrame:
    """``hour, n`` as :func:`metrics.trend` gives it, from ``at, n``."""
    now = metrics.instant(counts, "at", as_of)
    window = counts.where((F.col("at") >= now - F.expr(f"INTERVAL '{metrics.TREND_HOURS}' HOUR")) & (F.col("at") <= now))
    hour = F.hour(metrics._utc_clock(counts, "at", F.col("at")))
    by_hour = F.array(*[F.coalesce(F.sum(F.when(hour == h, F.col("n"))), F.lit(0)) for h in range(24)])
    summed = window.agg(by_hour.alias("counts"), F.sum("n").alias("total")).where(F.col("total") > 0)
    return summed.select(F.posexplode("counts").alias("hour", "n"))


class RunningMetrics:
    """``core``, ``trend`` and ``latest`` of a log of changes, from counts per instant and a reserve of newest rows.

    A change is a row of the event table, added (``sign`` 1, and so without such a column) or taken away (-1, with the values it had);
    an update is both. Each batch is summed by instant before it is written, and a repeated batch replaces itself. The
    instants of the last :data:`EXACT_HOURS` hours are exact and older ones folded into days, so the table holds those hours and
    a row per day, and a row however late still counts. ``as_of`` must not go back by more than an hour.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str = "created_at", key: str = "id", columns: list[str] | None = None, keep: int = 100):
        self.spark, self.ts, self.key, self.columns = spark, ts, key, list(dict.fromkeys([key, ts, *(columns or [])]))
        self.as_of = None
        self.counts = SummedTable(spark, f"{path}/counts", ["at"], keep=keep, fold=self._folded)
        self.newest = VersionedTable(spark, f"{path}/newest", keep=keep)
        self.core, self.trend, self.latest = (VersionedTable(spark, f"{path}/{t}", keep=keep) for t in ("core", "trend", "latest"))

    def _folded(self, counts: DataFrame) -> DataFrame:
        now = metrics.instant(counts, "at", self.as_of)
        old = F.col("at") < now - F.expr(f"INTERVAL '{EXACT_HOURS}' HOUR")
        return counts.withColumn("at", F.when(old, metrics._day_start(counts, "at", F.col("at"))).otherwise(F.col("at")))

    def add(self, changes: DataFrame, batch_id: int, as_of, event_table: Callable[[], DataFrame] | None = None) -> None:
        """Count a batch of ``changes`` in, then refresh the results."""
        self.as_of = as_of
        sign = F.col("sign") if "sign" in changes.columns else F.lit(1)
        changes = changes.select(*self.columns, sign.cast("long").alias("sign")).persist()
        try:
            counted = changes.groupBy(F.col(self.ts).alias("at")).agg(F.sum("sign").alias("n"))
            self.counts.write(counted, batch_id)
            self._keep_newest(changes, batch_id, event_table)
        finally:
            changes.unpersist()
        self.refresh(batch_id, as_of)

    def _keep_newest(self, changes: DataFrame, batch_id: int, event_table: Callable[[], DataFrame] | None) -> None:
        """The newest rows, all down to the oldest of them; ``cut`` says that there are, or were, older ones."""
        kept = self.newest.before(batch_id)
        rows, cut = changes, False
        if kept is not None:
            held = kept.agg(F.count(self.key).alias("rows"), F.bool_or("cut").alias("cut"), F.min(F.struct(self.ts, self.key)).alias("oldest")).first()
            cut = bool(held["cut"])
            if cut and held["rows"]:
                # what is older than the reserve has unknown rows above it
                oldest = F.struct(*(F.lit(held["oldest"][c]).cast(changes.schema[c].dataType).alias(c) for c in (self.ts, self.key)))
                rows = rows.where(F.struct(self.ts, self.key) >= oldest)
            rows = rows.unionByName(kept.where(F.col(self.key).isNotNull()).select(*self.columns, F.lit(1).cast("long").alias("sign")))
        rows = rows.groupBy(*self.columns).agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign")
        found = metrics.latest(rows, self.columns, self.ts, self.key, RESERVE + 1).collect()
        if cut and len(found) < metrics.LATEST_ROWS:
            if event_table is None:
                raise ValueError("rows were deleted down to the end of the reserve: name the event table to refill it from")
            found, cut = metrics.latest(event_table(), self.columns, self.ts, self.key, RESERVE + 1).collect(), False
        cut = cut or len(found) > RESERVE
        schema = changes.select(*self.columns).schema
        newest = self.spark.createDataFrame(found[:RESERVE], schema).withColumn("cut", F.lit(cut))
        self.newest.write(newest.coalesce(1), batch_id)

    def refresh(self, batch_id: int, as_of) -> None:
        """Write the results anew from what is kept."""
        counts = self.counts.read()
        self.core.write(core_of(counts, as_of), batch_id)
        self.trend.write(trend_of(counts, as_of), batch_id)
        self.latest.write(metrics.latest(self.newest.read(), self.columns, self.ts, self.key), batch_id)


def follow_changes(
    changes: DataFrame, running: RunningMetrics, checkpoint: str, as_of: Callable, event_table: Callable[[], DataFrame] | None = None, every: str | None = None
) -> StreamingQuery:
    """Keep ``running`` up to date with a stream of changes; ``as_of()`` gives the instant of each batch.

    ``event_table()`` is read only if deletions empty the reserve of newest rows.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        running.add(batch, batch_id, as_of(), event_table)

    return start(changes.writeStream.foreachBatch(on_batch), checkpoint, every)


def follow_clock(spark: SparkSession, running: RunningMetrics, table: VersionedTable, checkpoint: str, as_of: Callable, every: str = LIVE_REFRESH) -> StreamingQuery:
    """Write the core metrics to ``table`` every ``every`` from the counts alone, until stopped; they fall also when no event comes."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def on_tick(batch: DataFrame, batch_id: int) -> None:
        table.write(core_of(running.counts.read(), as_of()), batch_id)

    return start(clock.writeStream.foreachBatch(on_tick), checkpoint, every)
