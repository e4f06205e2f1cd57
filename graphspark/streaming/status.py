"""Ingest status as streams of (event_id, ts, repo_id, stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gates import row_gates
from ..operators.repos import latest_status, status_of


def stream_latest_status(events: DataFrame) -> DataFrame:
    """Newest stage of each repository, by time and then id (update mode)."""
    return latest_status(events)


def stream_stalls(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions that a gap closed while the last stage was in flight (append mode)."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    last = rows.groupBy("repo_id", F.session_window("ts", gap).alias("session")).agg(F.max(F.struct("ts", "event_id", "stage")).alias("m"))
    return last.select("repo_id", F.col("session.end").alias("stalled_at"), "m.stage").where(status_of() == "ingesting")


def stream_status_counts(events: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), status_of().alias("status")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def stream_gate_payloads(payloads: DataFrame) -> DataFrame:
    """Violations of all row-level gates in a stream (or batch) of action rows (append mode)."""
    return row_gates(payloads)
