"""Maintained counts against the batch metrics, with late rows, deletions, updates and repeated batches."""

import random
from datetime import datetime, timedelta

import pytest

from rowsheaf.operators import metrics
from rowsheaf.streaming import metrics as live
from rowsheaf.streaming.running import RESERVE, RunningMetrics, follow_changes
from rowsheaf.streaming.tables import SummedTable

NOW = datetime(2024, 1, 30, 12, 34, 56)
SCHEMA = "id long, created_at timestamp_ntz"


def rows(n, seed, hours=60):
    rng = random.Random(seed)
    return [(i, NOW - timedelta(microseconds=rng.randrange(hours * 3600 * 10**6))) for i in range(n)]


def same(running, table):
    assert running.core.read().first() == metrics.core(table, NOW).first()
    assert running.trend.read().collect() == metrics.trend(table, NOW).collect()
    columns = ["id", "created_at"]
    assert running.latest.read().collect() == metrics.latest(table, columns).collect()


def test_ten_batches_equal_the_batch_metrics_without_reading_the_table(spark, tmp_path):
    data = rows(400, 1)
    edges = [(1000 + i, NOW - d) for i, d in enumerate([timedelta(minutes=5), timedelta(hours=24), timedelta(0), timedelta(days=9), timedelta(hours=-2)])]
    data += edges
    for i in range(10):
        spark.createDataFrame(data[i::10], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    running = RunningMetrics(spark, f"{tmp_path}/m", keep=3)
    stream = live.read_events(spark, f"{tmp_path}/events", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)

    def never():
        raise AssertionError("the event table was read")

    follow_changes(stream, running, f"{tmp_path}/cp", lambda: NOW, never).awaitTermination()
    same(running, spark.createDataFrame(data, SCHEMA))
    # old instants become days
    old = f"at < timestamp_ntz'{NOW - timedelta(hours=26)}'"
    before = running.counts.read().where(old).count()
    running.counts.compact()
    assert running.counts.read().where(old).count() <= 4 < before + 4
    running.refresh(99, NOW)
    same(running, spark.createDataFrame(data, SCHEMA))


def test_updates_deletions_and_repeated_batches(spark, tmp_path):
    data = rows(200, 2)
    running = RunningMetrics(spark, f"{tmp_path}/m", keep=2)
    table = dict(data)
    first = spark.createDataFrame([(*r, 1) for r in data], SCHEMA + ", sign int")
    running.add(first, 0, NOW, lambda: spark.createDataFrame(list(table.items()), SCHEMA))
    newest = sorted(data, key=lambda r: (r[1], r[0]), reverse=True)
    for batch, gone in enumerate([newest[:5], newest[5 : RESERVE - 5], newest[RESERVE : RESERVE + 20]], 1):
        moved = [(i, at, i, at - timedelta(minutes=1)) for i, at in newest[150 + batch : 152 + batch]]
        changes = [(i, at, -1) for i, at in gone] + [(i, at, -1) for i, at, _, _ in moved] + [(i, at, 1) for _, _, i, at in moved]
        table = {i: at for i, at in table.items() if i not in {g[0] for g in gone}} | {i: at for _, _, i, at in moved}
        for _ in range(2):  # the same batch again
            running.add(spark.createDataFrame(changes, SCHEMA + ", sign int"), batch, NOW, lambda: spark.createDataFrame(list(table.items()), SCHEMA))
        same(running, spark.createDataFrame(list(table.items()), SCHEMA))
        newest = [r for r in newest if table.get(r[0]) == r[1]] + [(i, at) for _, _, i, at in moved]


def test_deletions_beyond_the_reserve_need_the_table(spark, tmp_path):
    data = sorted(rows(RESERVE + 30, 3), key=lambda r: r[1], reverse=True)
    running = RunningMetrics(spark, f"{tmp_path}/m")
    running.add(spark.createDataFrame(data, SCHEMA), 0, NOW)
    gone = spark.createDataFrame([(*r, -1) for r in data[:RESERVE]], SCHEMA + ", sign int")
    with pytest.raises(ValueError, match="reserve"):
        running.add(gone, 1, NOW)
    left = spark.createDataFrame(data[RESERVE:], SCHEMA)
    running.add(gone, 1, NOW, lambda: left)
    same(running, left)


def test_windows_hold_late_rows_and_stay_small(spark, tmp_path):
    start = datetime(2024, 1, 1)
    table = SummedTable(spark, f"{tmp_path}/t", ["window_start"], keep=4)
    schema = spark.createDataFrame([], SCHEMA).schema
    for i in range(6):
        hours = [(i * 200 + h, start + timedelta(hours=i * 200 + h)) for h in range(200)]
        late = [(10_000 + i, start)] if i else []  # days after its window was over
        spark.createDataFrame(hours + late, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = live.read_events(spark, f"{tmp_path}/events", schema, files_per_batch=1)
    query = live.follow_windows(stream, live.hourly, table, f"{tmp_path}/cp")
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)
    got = {r["window_start"]: r["n"] for r in table.read().collect()}
    assert len(got) == 1200 and got[start] == 6 and set(got.values()) == {1, 6}


def test_nothing(spark, tmp_path):
    running = RunningMetrics(spark, f"{tmp_path}/m")
    running.add(spark.createDataFrame([], SCHEMA), 0, NOW)
    assert tuple(running.core.read().first()) == (0, 0, 0) and running.latest.read().count() == 0 and running.trend.read().count() == 0
    running.add(spark.createDataFrame([(1, NOW)], SCHEMA), 1, NOW)
    assert tuple(running.core.read().first()) == (1, 1, 1) and running.latest.read().count() == 1
