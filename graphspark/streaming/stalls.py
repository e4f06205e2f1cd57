"""Stalls and retries as they happen: state and event-time timers for each repository.

Events are (event_id, ts, repo_id, stage). A stage is that of an ingest (in flight, ``active`` or ``error``), or an act of the operator:
``connected`` begins anew, ``retried`` and ``retry_check_failed`` count as attempts (the former restarts the ingest), and ``still_running``
says that a probe found the ingest alive. A repository is a candidate

* ``error``: when an event leaves it in error;
* ``stalled``: when it is ingesting and neither progress nor a probe came for ``gap``;

as long as its attempts are below ``max_retries``. Each event is judged once, so a stall is told once until something else comes.

The stream holds events until the watermark has passed them and takes them in the order of (ts, event_id), so that a late event within the
watermark's delay counts where it belongs, and a stall is told without a later event of its repository: by a timer. Events beyond the delay
are dropped, as by any watermark. ``stall_candidates`` gives the same rows for a table, by windows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import IN_FLIGHT

#: Acts of the operator among the events.
CONNECTED, RETRIED, FAILED, ALIVE = "connected", "retried", "retry_check_failed", "still_running"
OUT = "repo_id long, kind string, at timestamp, stage string, attempts int"
#: Microseconds of a day: a repository's waiting events are kept as one text a day, so that state is read and written once a day and batch, and not for each event.
DAY = 86_400_000_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _status(stage: str, before: str) -> str:
    if stage in (CONNECTED, RETRIED) or stage in IN_FLIGHT:
        return "ingesting"
    return {"active": "indexed", "error": "error"}.get(stage, before)


def _events(text: str) -> dict[tuple[int, int], str]:
    return {(at, event_id): stage for at, event_id, stage in json.loads(text)}


class _Watch(StatefulProcessor):
    def __init__(self, gap: int, max_retries: int):
        self.gap, self.max_retries = gap, max_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: What is known up to the watermark; times in microseconds. ``armed``: when a stall is due, 0 for never.
        self.now = handle.getValueState("now", "status string, stage string, progress long, probed long, attempts int, armed long")
        self.pending = handle.getMapState("pending", "day long", "events string")

    def _keep(self, day: int, events: dict[tuple[int, int], str]) -> None:
        if events:
            self.pending.updateValue((day,), (json.dumps([[*k, stage] for k, stage in events.items()]),))
        else:
            self.pending.removeKey((day,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new: dict[int, dict[tuple[int, int], str]] = {}
        for r in rows:
            new.setdefault(r.at // DAY, {})[r.at, r.event_id] = r.stage
        held = {k[0]: v[0] for k, v in self.pending.iterator()} if new else {}
        for day, events in new.items():
            self._keep(day, _events(held.get(day, "[]")) | events)
        if new:
            self._timer(min(new[min(new)])[0])
        return iter([])

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting, left, rest, later = [], None, {}, False
        for day, events in [(k[0], _events(v[0])) for k, v in self.pending.iterator()]:
            due = [k for k in events if k[0] <= passed]
            waiting.extend((*k, events.pop(k)) for k in due)
            if due:
                rest[day] = events
            later = later or not due
            if events:
                first = min(events)[0]
                left = first if left is None else min(left, first)
        if rest and not later:  # one call where all days are taken
            self.pending.clear()
        for day, events in rest.items():
            if events or later:
                self._keep(day, events)
        status, stage, progress, probed, attempts, armed = self.now.get() if self.now.exists() else ("unknown", None, 0, 0, 0, 0)
        found = []
        for at, _, what in sorted(waiting):
            if armed and armed < at:
                found.append(("stalled", armed, stage, attempts))
            if what == ALIVE:
                probed = at
            elif what == FAILED:
                attempts += 1
            else:
                attempts = 0 if what == CONNECTED else attempts + (what == RETRIED)
                status, stage, progress = _status(what, status), what, at
            open_ = attempts < self.max_retries
            if status == "error" and open_:
                found.append(("error", at, stage, attempts))
            armed = max(max(progress, probed) + self.gap, at) if status == "ingesting" and open_ else 0
        if armed and armed <= passed and (left is None or armed < left):
            found.append(("stalled", armed, stage, attempts))
            armed = 0
        self.now.update((status, stage, progress, probed, attempts, armed))
        for at in {x for x in (left, armed) if x}:
            self._timer(at)
        return (Row(repo_id=key[0], kind=kind, micros=at, stage=what, attempts=n) for kind, at, what, n in found)


def stream_candidates(events: DataFrame, gap_minutes: int = 30, max_retries: int = 3, watermark: str = "1 hour") -> DataFrame:
    """Candidates for a retry of streaming events (append mode), as ``OUT``. The session needs the RocksDB state store (``use_timers``)."""
    rows = events.where("repo_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", watermark).select("repo_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("event_id", F.lit(0)).alias("event_id"), F.coalesce("stage", F.lit("")).alias("stage"))
    watch = _Watch(gap_minutes * 60_000_000, max_retries)
    found = rows.groupBy("repo_id").transformWithState(watch, "repo_id long, kind string, micros long, stage string, attempts int", "append", "eventTime")
    return found.select("repo_id", "kind", F.timestamp_micros("micros").alias("at"), "stage", "attempts")


def use_timers(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def stall_candidates(events: DataFrame, until, gap_minutes: int = 30, max_retries: int = 3) -> DataFrame:
    """The same for a table of events up to the time ``until`` (a watermark), by windows over each repository's events."""
    rows = events.where("repo_id IS NOT NULL AND ts IS NOT NULL").where(F.col("ts") <= F.lit(until).cast("timestamp")).withColumn("stage", F.coalesce("stage", F.lit("")))
    by = Window.partitionBy("repo_id").orderBy("ts", "event_id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    is_stage = ~F.col("stage").isin(ALIVE, FAILED)
    status = F.when(F.col("stage").isin(CONNECTED, RETRIED, *IN_FLIGHT), "ingesting").when(F.col("stage") == "active", "indexed").when(F.col("stage") == "error", "error")
    known = rows.withColumns({
        "status": F.coalesce(last(status), F.lit("unknown")), "last_stage": last(F.when(is_stage, F.col("stage"))), "progress": last(F.when(is_stage, F.col("ts"))), "probed": last(F.when(F.col("stage") == ALIVE, F.col("ts"))),
        "life": F.sum((F.col("stage") == CONNECTED).cast("int")).over(so_far), "next": F.lead("ts").over(by),
    })
    of_life = Window.partitionBy("repo_id", "life").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("attempts", F.sum(F.col("stage").isin(RETRIED, FAILED).cast("int")).over(of_life).cast("int")).where(F.col("attempts") < max_retries)
    due = F.greatest(F.greatest("progress", "probed") + F.expr(f"INTERVAL {gap_minutes} MINUTES"), "ts")
    errors = known.where("status = 'error'").select("repo_id", F.lit("error").alias("kind"), F.col("ts").alias("at"), F.col("last_stage").alias("stage"), "attempts")
    stalls = known.where("status = 'ingesting'").withColumn("at", due).where((F.col("at") < F.col("next")) | (F.col("next").isNull() & (F.col("at") <= F.lit(until).cast("timestamp"))))
    return errors.union(stalls.select("repo_id", F.lit("stalled").alias("kind"), "at", F.col("last_stage").alias("stage"), "attempts"))
