"""Streaming telemetry and run status."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tabloom.operators.logs import UNEXPECTED_END


def telemetry_stream(telemetry: DataFrame) -> DataFrame:
    """Last value per run and telemetry key, emitted on change.

    A native streaming aggregation: values are combined before the shuffle, late rows with an older `seq`
    never win, and the state holds one row per run and key.
    """
    pairs = telemetry.select("run_key", "seq", "ts", F.explode("fields").alias("key", "value"))
    return pairs.groupBy("run_key", "key").agg(F.max_by("value", "seq").alias("value"), F.max("ts").alias("ts"))


def heartbeat_stream(lines: DataFrame) -> DataFrame:
    """Time of the last line per run."""
    return lines.groupBy("run_key").agg(F.max("ts").alias("last_update"))


STATUS_SCHEMA = "run_key bigint, status string, error string, finished_at timestamp_ntz, last_seq bigint"
STATE_SCHEMA = "status string, error string, finished_at timestamp_ntz, last_seq bigint"
STATUS_OF = {"result_ok": "completed", "result_fail": "failed", "cancel": "cancelled", "worker_end": "failed"}


def _decisive(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that can still decide a run: first start, first result, and endings before that result."""
    result = rows["kind"].isin(["result_ok", "result_fail"])
    first_result = rows.loc[result, "seq"].min()
    first_start = rows.loc[rows["kind"] == "start", "seq"].min()
    ending = rows["kind"].isin(["cancel", "worker_end"])
    if pd.notna(first_result):
        ending &= rows["seq"] < first_result
    return rows.loc[ending | (rows["seq"] == first_start) | (rows["seq"] == first_result)]


def _advance(timeout_ms: int | None):
    """State function of one run; closed over the timeout only."""

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, error, finished, last = state.get if state.exists else ("queued", None, None, -1)
        if state.hasTimedOut:
            # No event for the whole timeout: the worker is gone, and so is the need for its state.
            if status == "running":
                status, error = "failed", UNEXPECTED_END
            state.remove()
        else:
            rows, newest, seen = None, last, 0
            for b in batches:
                new = b.loc[b["seq"] > last]
                if len(new):
                    newest = max(newest, int(new["seq"].max()))
                    seen = max(seen, int(new["millis"].max()))
                    rows = _decisive(new if rows is None else pd.concat([rows, new]))
            for row in [] if rows is None else rows.sort_values("seq").itertuples(index=False):
                if status not in ("queued", "running"):
                    continue
                if row.kind == "start":
                    status = "running"
                elif row.kind in ("result_ok", "result_fail") or (row.kind in STATUS_OF and status == "running"):
                    status, finished = STATUS_OF[row.kind], row.ts
                    error = UNEXPECTED_END if row.kind == "worker_end" else None
            last = newest
            state.update((status, error, finished, last))
            if timeout_ms is not None and seen:
                state.setTimeoutTimestamp(max(seen + timeout_ms, state.getCurrentWatermarkMs() + 1))
        stamp = pd.Series([pd.NaT if finished is None else finished], dtype="datetime64[ns]")
        yield pd.DataFrame(
            {"run_key": [key[0]], "status": [status], "error": [error], "finished_at": stamp, "last_seq": [last]}
        )

    return advance


def run_status_stream(events: DataFrame, timeout_minutes: int | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Status per run from a stream of (run_key, seq, ts, kind), emitted on change.

    The state is four scalars per run. Events of one micro-batch are ordered by `seq`; events older than
    the last one seen are ignored. With a timeout, a run whose events stop for that long (in event time)
    fails if it was running, and its state is dropped.
    """
    kinds = ["start", *STATUS_OF]
    relevant = events.where(F.col("kind").isin(kinds)).select("run_key", "seq", "ts", "kind")
    relevant = relevant.withColumn("event_time", F.col("ts").cast("timestamp"))
    relevant = relevant.withColumn("millis", F.unix_millis("event_time"))
    if timeout_minutes is None:
        mode, timeout_ms = GroupStateTimeout.NoTimeout, None
    else:
        mode, timeout_ms = GroupStateTimeout.EventTimeTimeout, timeout_minutes * 60_000
        relevant = relevant.withWatermark("event_time", lateness)
    return relevant.groupBy("run_key").applyInPandasWithState(
        _advance(timeout_ms), STATUS_SCHEMA, STATE_SCHEMA, "update", mode
    )
