"""Telemetry and heartbeats with state that expires.

The plain streams keep a row for every run that ever reported. Here a run's state lives as long as it reports: each
batch moves the run's end to its last row plus the expiry, and when the watermark passes it the run's state is cleared.
Rows behind the watermark are late and dropped before they reach the state. A run that reports again after its state
has gone starts afresh. The state is held in RocksDB on the executors, so it may exceed their memory. Runs share the
state row of their bucket, whose event-time timeout is the first end among them: a call of Python per run and batch
would take most of the time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VALUES_SCHEMA = "run_key bigint, key string, value string, ts timestamp_ntz"
BEATS_SCHEMA = "run_key bigint, last_update timestamp_ntz, expired boolean"
#: State of a bucket of runs: flat lists of its runs and values, times as microseconds, and until when a run is kept.
VALUES_STATE = """of array<bigint>, keys array<string>, seqs array<bigint>, texts array<string>, micros array<bigint>,
    runs array<bigint>, untils array<bigint>"""
BEATS_STATE = "runs array<bigint>, micros array<bigint>, untils array<bigint>"
#: Buckets of runs; a call of Python handles the rows of one.
BUCKETS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    """State in RocksDB; set it before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _milliseconds(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def _micros(times: pd.Series) -> list[int]:
    return times.to_numpy("datetime64[us]").astype("int64").tolist()


def _times(micros: list[int]) -> np.ndarray:
    return np.array(micros, dtype="datetime64[us]").astype("datetime64[ns]")


def _runs(batch: pd.DataFrame) -> list[int | None]:
    """Run of each row; rows without one are a bucket of their own."""
    return [None] * len(batch) if batch["run_key"].isna().any() else batch["run_key"].tolist()


def _prolong(until: dict, runs: list, batch: pd.DataFrame, expiry_ms: int) -> None:
    for run, millis in zip(runs, batch["millis"].tolist()):
        if millis + expiry_ms > until.get(run, 0):
            until[run] = int(millis) + expiry_ms


def _expired(until: dict, state: GroupState) -> set:
    """The runs whose time is over, taken out of `until`."""
    gone = {run for run, end in until.items() if end < state.getCurrentWatermarkMs()}
    for run in gone:
        del until[run]
    return gone


def _keep(state: GroupState, until: dict, values: tuple) -> None:
    """Store the runs that are left, to be seen again when the first of them may expire."""
    if not until:
        state.remove()
        return
    state.update(values)
    state.setTimeoutTimestamp(max(min(until.values()), state.getCurrentWatermarkMs() + 1))


def last_values(expiry_ms: int) -> Callable:
    """State function: the value with the largest `seq` of every telemetry key of a run."""

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, until = {}, {}
        if state.exists:
            of, names, seqs, texts, micros, runs, untils = state.get
            held, until = {(r, n): h for r, n, *h in zip(of, names, seqs, texts, micros)}, dict(zip(runs, untils))
        newest: dict[tuple, tuple] = {}
        latest: dict[tuple, int] = {}
        for batch in () if state.hasTimedOut else batches:
            runs = _runs(batch)
            _prolong(until, runs, batch, expiry_ms)
            for run, name, seq, value, at in zip(runs, batch["key"].tolist(), batch["seq"].tolist(), batch["value"].tolist(), _micros(batch["ts"])):
                place = (run, name)
                if place not in newest or seq > newest[place][0]:
                    newest[place] = (seq, value)
                if place not in latest or at > latest[place]:
                    latest[place] = at
        for place, (seq, value) in newest.items():
            at = latest[place]
            if place in held:
                old_seq, old_value, old_at = held[place]
                seq, value = (old_seq, old_value) if old_seq > seq else (seq, value)
                at = max(at, old_at)
            held[place] = (int(seq), value, at)
        out = [(*place, *held[place][1:]) for place in newest]
        gone = _expired(until, state)
        kept = [(*place, *h) for place, h in held.items() if place[0] not in gone]
        _keep(state, until, (*([k[i] for k in kept] for i in range(5)), list(until), list(until.values())))
        if out:
            runs, names, values, micros = zip(*out)
            yield pd.DataFrame({"run_key": list(runs), "key": list(names), "value": list(values), "ts": _times(list(micros))})

    return advance


def last_beat(expiry_ms: int) -> Callable:
    """State function: time of the last line of a run, and a closing row once the run has been silent for the expiry."""

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, until, seen = {}, {}, {}
        if state.exists:
            runs, micros, untils = state.get
            held, until = dict(zip(runs, micros)), dict(zip(runs, untils))
        for batch in () if state.hasTimedOut else batches:
            runs = _runs(batch)
            _prolong(until, runs, batch, expiry_ms)
            for run, at in zip(runs, _micros(batch["ts"])):
                seen[run] = None
                if run not in held or at > held[run]:
                    held[run] = at
        gone = _expired(until, state)
        out = [(run, held[run], False) for run in seen] + [(run, held[run], True) for run in gone]
        _keep(state, until, (list(until), [held[run] for run in until], list(until.values())))
        if out:
            runs, micros, expired = zip(*out)
            yield pd.DataFrame({"run_key": list(runs), "last_update": _times(list(micros)), "expired": list(expired)})

    return advance


def _timed(stream: DataFrame, lateness: str) -> DataFrame:
    timed = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withColumn("millis", F.unix_millis("event_time"))
    return timed.withWatermark("event_time", lateness)


def _run(stream: DataFrame, advance: Callable, schema: str, state: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    hashed = F.pmod(F.xxhash64("run_key"), F.lit(BUCKETS))
    bucket = F.when(F.col("run_key").isNull(), -1).otherwise(hashed)
    return stream.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(advance, schema, state, "update", GroupStateTimeout.EventTimeTimeout)


def telemetry_expiring(telemetry: DataFrame, expiry: str = "2 days", lateness: str = "1 hour") -> DataFrame:
    """Last value per run and telemetry key, emitted on change; `telemetry` has (run_key, seq, ts, fields map)."""
    pairs = telemetry.select("run_key", "seq", "ts", F.explode("fields").alias("key", "value")).where("ts is not null")
    return _run(_timed(pairs, lateness), last_values(_milliseconds(expiry)), VALUES_SCHEMA, VALUES_STATE)


def heartbeat_expiring(lines: DataFrame, expiry: str = "2 days", lateness: str = "1 hour") -> DataFrame:
    """Last line per run, emitted on change, and once more with `expired` when the run has gone silent."""
    timed = _timed(lines.where("ts is not null").select("run_key", "ts"), lateness)
    return _run(timed, last_beat(_milliseconds(expiry)), BEATS_SCHEMA, BEATS_STATE)
