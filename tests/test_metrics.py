import os

import pytest
from pyspark.sql import functions as F

from rowsheaf.operators import metrics
from rowsheaf.operators.counter import count_events, upsert
from rowsheaf.streaming import metrics as live
from rowsheaf.streaming.counter import counter_table, follow_counter
from rowsheaf.streaming.tables import VersionedTable

AS_OF = "2024-01-30 12:30:00"
SCHEMA = "id bigint, created_at timestamp_ntz, kind string"
STAMPS = [
    "2024-01-29 12:29:59",  # one second before the last 24 hours
    "2024-01-29 12:30:00",  # exactly 24 hours ago
    "2024-01-29 23:59:59.999999",
    "2024-01-30 00:00:00",
    "2024-01-30 12:24:59.999999",
    "2024-01-30 12:25:00",  # exactly five minutes ago
    "2024-01-30 12:30:00",
    "2024-01-30 12:30:00",
    "2024-01-30 12:30:01",  # after the instant
]


def _log(spark, stamps, first=1):
    rows = [(i, s, "ab"[i % 2]) for i, s in enumerate(stamps, first)]
    return spark.createDataFrame(rows, "id bigint, s string, kind string").select(
        "id", F.col("s").cast("timestamp_ntz").alias("created_at"), "kind"
    )


@pytest.fixture(scope="module")
def log(spark):
    return _log(spark, STAMPS).cache()


def test_counts_and_bounds(log):
    assert metrics.total(log).first()["n"] == 9
    assert metrics.today(log, AS_OF).first()["n"] == 5
    assert metrics.last_minutes(log, AS_OF).first()["n"] == 3
    assert tuple(metrics.core(log, AS_OF).first()) == (8, 5, 3)


def test_trend_adds_both_ends_of_the_partial_hour(log):
    trend = {r["hour"]: r["n"] for r in metrics.trend(log, AS_OF).collect()}
    assert list(trend) == list(range(24))
    assert {h: n for h, n in trend.items() if n} == {0: 1, 12: 5, 23: 1}


def test_trend_of_nothing_is_empty(log):
    assert metrics.trend(log, "2025-01-01 00:00:00").count() == 0


def test_latest_breaks_ties_by_key(spark, log):
    rows = metrics.latest(log, ["id"], n=4).collect()
    assert [r["id"] for r in rows] == [9, 8, 7, 6]
    many = _log(spark, STAMPS * 3)
    assert metrics.latest(many, ["id", "created_at"]).count() == 15


def test_instants_with_a_zone(spark, log):
    zoned = log.withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert tuple(metrics.core(zoned, AS_OF).first()) == (8, 5, 3)


def test_time_range_reaches_the_scan(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log.write.parquet(path)
    plan = metrics.today(spark.read.parquet(path), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_at,2024-01-30T00:00" in plan
    assert "ReadSchema: struct<created_at:timestamp_ntz>" in plan


def test_upsert(spark, log):
    first, second = log.where("id <= 4"), log.where("id > 4")
    whole = upsert(count_events(first, "kind", "created_at"), count_events(second, "kind", "created_at"))
    expected = count_events(log, "kind", "created_at")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, expected.collect()))


# ---- streams


@pytest.fixture
def event_folder(spark, tmp_path):
    """Events in several files, out of order."""
    path = str(tmp_path / "events")
    for i in (2, 0, 1):
        _log(spark, STAMPS[i::3], first=1 + 10 * i).coalesce(1).write.mode("append").parquet(path)
    return path


def _minute_windows(log):
    starts = F.explode(F.sequence(F.lit(0), F.lit(4)))
    minute = F.date_trunc("minute", "created_at").cast("timestamp_ntz")
    return log.select(minute.alias("m"), starts.alias("back")).groupBy(
        (F.col("m") - F.make_dt_interval(mins=F.col("back"))).alias("window_start")
    ).agg(F.count("*").alias("n"))


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_windows_equal_the_batch(spark, event_folder, tmp_path, files_per_batch):
    batch = spark.read.parquet(event_folder)
    wanted = {
        "rate": (live.moving_rate, _minute_windows(batch)),
        "hourly": (live.hourly, batch.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz")).count()),
        "daily": (live.daily, batch.groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz")).count()),
    }
    for name, (windows, expected) in wanted.items():
        stream = live.read_events(spark, event_folder, batch.schema, files_per_batch=files_per_batch)
        table = VersionedTable(spark, str(tmp_path / name))
        table.follow(windows(stream), str(tmp_path / f"{name}-cp"), "complete").awaitTermination()
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, expected.collect())), name


def test_windows_by_changes_only(spark, tmp_path):
    """Update mode keeps one row per window, from the changed windows of each batch."""
    path = str(tmp_path / "events")
    batches = [STAMPS[:3], STAMPS[3:6], STAMPS[6:]]
    schema = _log(spark, STAMPS).schema
    table = VersionedTable(spark, str(tmp_path / "t"), keys=["window_start"], keep=2)
    for i, stamps in enumerate(batches):
        _log(spark, stamps, first=1 + 10 * i).coalesce(1).write.mode("append").parquet(path)
        stream = live.hourly(live.read_events(spark, path, schema))
        table.follow(stream, str(tmp_path / "cp"), "update").awaitTermination()
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz")
    expected = spark.read.parquet(path).groupBy(hour).count()
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, expected.collect()))


def test_metrics_follow_new_events(spark, event_folder, tmp_path):
    schema = spark.read.parquet(event_folder).schema
    tables = live.MetricTables(spark, str(tmp_path / "m"))

    def run():
        live.follow_metrics(
            live.read_events(spark, event_folder, schema),
            lambda: spark.read.parquet(event_folder),
            tables,
            str(tmp_path / "cp"),
            lambda: AS_OF,
        ).awaitTermination()

    run()
    assert tuple(tables.core.read().first()) == (8, 5, 3)
    assert tables.latest.read().count() == 9
    _log(spark, ["2024-01-30 12:29:00"], first=99).write.mode("append").parquet(event_folder)
    run()
    assert tuple(tables.core.read().first()) == (9, 6, 4)
    assert sum(r["n"] for r in tables.trend.read().collect()) == 8


def test_counter_follows_and_survives_replay(spark, event_folder, tmp_path):
    batch = spark.read.parquet(event_folder)
    table = counter_table(spark, str(tmp_path / "c"))
    stream = live.read_events(spark, event_folder, batch.schema, files_per_batch=1)
    follow_counter(stream, table, str(tmp_path / "cp"), "kind", "created_at").awaitTermination()
    expected = sorted(map(tuple, count_events(batch, "kind", "created_at").collect()))
    assert sorted(map(tuple, table.read().collect())) == expected
    done = table.batches()
    assert len(done) > 1

    last = spark.read.parquet(f"{table.path}/batch_id={done[-1]}").collect()
    table.write(spark.createDataFrame(last, table.read().schema), done[-1])
    assert sorted(map(tuple, table.read().collect())) == expected

    table.compact()
    assert table.batches() == [] and len(os.listdir(table.path)) == 1
    assert sorted(map(tuple, table.read().collect())) == expected
    table.write(spark.createDataFrame([("b", 77, None, None)], table.read().schema), done[-1] + 1)
    assert {r["key"]: r["download_count"] for r in table.read().collect()} == {"a": 3, "b": 77}


def test_table_compacts_itself(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"), keys=["k"], keep=3)
    whole = VersionedTable(spark, str(tmp_path / "whole"), keep=3)
    for i in range(9):
        log.write(spark.createDataFrame([(i % 2, i), (100 + i, i)], "k int, v int"), i)
        whole.write(spark.range(i), i)
        assert len(log.batches()) <= 3 and len(whole.batches()) <= 3
    expected = {0: 8, 1: 7, **{100 + i: i for i in range(9)}}
    assert {r["k"]: r["v"] for r in log.read().collect()} == expected
    assert whole.read().count() == 8


def test_unfinished_batch_is_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(1), 0)
    table.write(spark.range(5), 1)
    os.remove(f"{table.path}/batch_id=1/_SUCCESS")
    assert table.batches() == [0] and table.read().count() == 1


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_days_and_hours_are_utc_in_any_session_zone(spark, tmp_path, zone, kind):
    times = ["2024-01-29T20:00:00", "2024-01-30T00:30:00", "2024-01-30T12:00:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        suffix = "Z" if kind == "timestamp" else ""
        events = spark.createDataFrame([(i, t + suffix) for i, t in enumerate(times)], "id long, t string")
        events = events.select("id", F.col("t").cast(kind).alias("created_at"))
        as_of = F.lit("2024-01-30T12:30:00" + suffix)
        assert metrics.today(events, as_of).first().n == 2
        assert metrics.core(events, as_of).first().today == 2
        hours = {r.hour for r in metrics.trend(events, as_of).where("n > 0").collect()}
        assert hours == {20, 0, 12}
        days = {str(r.window_start): r.n for r in live.daily(events, "created_at").collect()}
        assert days == {"2024-01-29 00:00:00": 1, "2024-01-30 00:00:00": 2}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_timer_refreshes_without_events(spark, tmp_path):
    """Three refreshes over the same rows, each an hour later."""
    _log(spark, ["2024-01-30 12:29:00"]).write.parquet(str(tmp_path / "e"))
    table = live.VersionedTable(spark, str(tmp_path / "t"))
    hours = iter(range(12, 23))
    query = live.refresh_on_timer(
        spark,
        lambda: spark.read.parquet(str(tmp_path / "e")),
        table,
        str(tmp_path / "cp"),
        lambda: f"2024-01-30 {next(hours)}:30:00",
        every="1 second",
    )
    try:
        for _ in range(150):
            if len(table.batches()) >= 3 or not query.isActive:
                break
            query.awaitTermination(0.2)
    finally:
        query.stop()
    first, last = (spark.read.parquet(f"{tmp_path}/t/batch_id={n}").first() for n in (table.batches()[0], table.batches()[-1]))
    assert (first["last_5m"], last["last_5m"], last["total"]) == (1, 0, 1)
