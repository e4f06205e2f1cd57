"""Streams that keep tables, findings and timers: replays, restarts, late and missing events."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from graphspark.operators import gates
from graphspark.operators.repos import latest_status
from graphspark.streaming import stalls, status, tables

EVENTS = "event_id long, ts timestamp, repo_id long, stage string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def events_of(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts string, repo_id long, stage string").withColumn("ts", F.col("ts").cast("timestamp"))


def drop_in(df, folder):
    """Adds one file to a folder, later than those before."""
    df.coalesce(1).write.mode("append").parquet(str(folder))


def uncommit(checkpoint, batch):
    """As if the query was killed after a batch's rows were written and before the batch was committed: it comes again."""
    for name in (str(batch), f".{batch}.crc"):
        os.remove(checkpoint / "commits" / name)


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_latest_status_table_survives_replays(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"2024-01-0{rng.randint(1, 5)} 0{rng.randint(0, 9)}:00:00", rng.randint(0, 6), rng.choice(["started", "active", "error"])) for i in range(120)]
    table = tables.latest_status_table(spark, str(tmp_path / "t"), compact_every=3)
    assert table.read().count() == 0
    for k in range(5):  # events come out of order
        drop_in(events_of(spark, rows[k::5]), tmp_path / "in")
    run = lambda: table.start(stream(spark, tmp_path / "in"), str(tmp_path / "c"), availableNow=True).awaitTermination()
    run()
    want = rows_of(latest_status(events_of(spark, rows)).select("repo_id", "ts", "stage"))
    got = lambda: rows_of(table.read().select("repo_id", "ts", "stage"))
    assert got() == want and table._numbers("commits") == [2]
    uncommit(tmp_path / "c", 4)
    run()
    assert got() == want
    # A base without its commit is not used; the batch that wrote it may come again.
    shutil.rmtree(tmp_path / "t" / "commits" / "upto=0000000002")
    assert got() == want
    table.merge(spark.read.schema(table.schema).parquet(str(tmp_path / "t" / "changes" / "batch=0000000002")).persist(), 2)
    assert got() == want and table._numbers("commits") == [2]
    drop_in(events_of(spark, [(999, "2024-02-01 00:00:00", 3, "active"), (1000, "2023-01-01 00:00:00", 4, "error")]), tmp_path / "in")
    run()
    later = rows_of(latest_status(events_of(spark, rows + [(999, "2024-02-01 00:00:00", 3, "active"), (1000, "2023-01-01 00:00:00", 4, "error")])).select("repo_id", "ts", "stage"))
    assert got() == later != want and rows_of(table.read(4).select("repo_id", "ts", "stage")) == want
    table.vacuum()
    assert got() == later and table._numbers("changes") == [] and table._numbers("base") == [5]


def test_counts_table(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 00:00:00", i % 2, ["started", "active"][i % 4 == 0]) for i in range(40)]
    for k in range(3):
        drop_in(events_of(spark, rows[k::3]), tmp_path / "in")
    table = tables.counts_table(spark, str(tmp_path / "t"), 2)
    tables.start_counts(status.stream_status_counts(stream(spark, tmp_path / "in"), "1 day", "10 days"), table, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert rows_of(table.read().select("window_start", "status", "n")) == rows_of(status.stream_status_counts(events_of(spark, rows), "1 day"))


def test_findings_are_written_once(spark, tmp_path):
    schema = "payload_id long, persona string, action_id long, action string, description string, has_api boolean, url string"
    rows = [(i, "Buyer", i, "Submit order" if i % 2 else "Click the tab", None, False, None) for i in range(30)]
    part = lambda k: spark.createDataFrame(rows[k::3], schema)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start = lambda: tables.start_findings(read(), str(tmp_path / "out"), str(tmp_path / "c"), availableNow=True)
    drop_in(part(0), tmp_path / "in")
    drop_in(part(1), tmp_path / "in")
    start().awaitTermination()
    uncommit(tmp_path / "c", 1)
    drop_in(part(2), tmp_path / "in")
    start().awaitTermination()
    columns = ["payload_id", "check", "action_id", "detail"]
    assert rows_of(tables.read_findings(spark, str(tmp_path / "out")).select(columns)) == rows_of(gates.row_gates(spark.createDataFrame(rows, schema)).select(columns))


BASE = [
    (1, "2024-01-01 00:00:00", 1, "connected"), (2, "2024-01-01 00:10:00", 1, "node_creation"),  # stalls at 00:40
    (3, "2024-01-01 00:00:00", 2, "started"), (4, "2024-01-01 00:20:00", 2, "still_running"), (5, "2024-01-01 00:45:00", 2, "active"),  # probed, then done
    (6, "2024-01-01 00:00:00", 3, "error"), (7, "2024-01-01 00:05:00", 3, "retried"), (8, "2024-01-01 00:06:00", 3, "error"), (9, "2024-01-01 00:07:00", 3, "retry_check_failed"), (10, "2024-01-01 00:08:00", 3, "retry_check_failed"), (11, "2024-01-01 00:09:00", 3, "error"),
    (12, "2024-01-01 00:00:00", 4, "started"), (13, "2024-01-01 02:00:00", 4, "metadata_addition"), (14, "2024-01-01 02:00:00", 5, "active"),
]


def test_a_table_of_events(spark):
    got = {(r.repo_id, r.kind, str(r["at"])[11:16], r.attempts) for r in stalls.stall_candidates(events_of(spark, BASE), "2024-01-01 02:30:00").collect()}
    assert got == {(1, "stalled", "00:40", 0), (3, "error", "00:00", 0), (3, "error", "00:06", 1), (3, "error", "00:07", 2), (4, "stalled", "00:30", 0), (4, "stalled", "02:30", 0)}


@pytest.mark.parametrize("seed", [0, 1])
def test_timers_equal_the_table(spark, tmp_path, seed):
    """Events out of order within the watermark's delay, in several batches; repositories that fall silent."""
    stalls.use_timers(spark)
    rng = random.Random(seed)
    stages = ["connected", "started", "node_creation", "still_running", "active", "error", "retried", "retry_check_failed", "other"]
    minutes = sorted(rng.randint(0, 900) for _ in range(150))
    rows = BASE if seed == 0 else [(i, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", rng.randint(1, 7), rng.choice(stages)) for i, m in enumerate(minutes)]
    shuffled = sorted(rows, key=lambda r: (r[1][:13], rng.random())) if seed else rows  # late by less than an hour
    end = [(9_000, "2024-01-03 00:00:00", 99, "active")]
    parts = [shuffled[k : k + 40] for k in range(0, len(shuffled), 40)] + [end]
    for part in parts:
        drop_in(events_of(spark, part), tmp_path / "in")
    found = stalls.stream_candidates(stream(spark, tmp_path / "in"), watermark="1 hour")
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    want = stalls.stall_candidates(events_of(spark, rows + end), "2024-01-02 23:00:00")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(got) == rows_of(want) and got.where("kind = 'stalled'").count() > 2
