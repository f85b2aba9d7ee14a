"""Streams whose state expires, over several files and batches, with late rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabloom.operators import logs as L
from tabloom.plans import q_logs
from tabloom.plans.registry import Tables
from tabloom.session import scratch_path
from tabloom.streaming import expiring
from tabloom.streaming.sinks import run_update

START = datetime.datetime(2024, 1, 1)


def hours(n):
    return START + datetime.timedelta(hours=n)


def run_files(spark, batches, schema, build, keys):
    """Feed one file a batch; all emitted rows by batch and the number of state rows after each."""
    folder, out = scratch_path(spark, "files"), scratch_path(spark, "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = build(stream).writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    late = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    return spark.read.option("basePath", out).parquet(f"{out}/*"), states, late


def test_state_falls_after_the_expiry(spark):
    # Ten runs report once, one run goes on; files lie twelve hours apart.
    batches = [[(k, 0, hours(0), {"a": f"v{k}"}) for k in range(10)]]
    batches += [[(99, i, hours(12 * i), {"a": f"w{i}", "b": "x"})] for i in range(1, 9)]
    schema = "run_key bigint, seq bigint, ts timestamp_ntz, fields map<string,string>"
    found, states, _ = run_files(
        spark, batches, schema, lambda s: expiring.telemetry_expiring(s, "1 day", "1 hour"), ["run_key", "key"]
    )
    assert max(states) >= 10 and states[-1] < max(states) - 5
    last = found.groupBy("run_key", "key").agg(F.max_by(F.struct("value", "ts"), "batch").alias("v")).select("run_key", "key", "v.*")
    flat = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, L.telemetry_state(flat).select("run_key", "key", "value", "ts").collect()))


def test_beats_expire_once_and_late_rows_are_dropped(spark):
    batches = [[(1, hours(0)), (2, hours(0))], [(2, hours(30))], [(2, hours(60))], [(1, hours(1)), (2, hours(61))], [(2, hours(62)), (3, hours(62))]]
    found, states, late = run_files(
        spark, batches, "run_key bigint, ts timestamp_ntz", lambda s: expiring.heartbeat_expiring(s, "1 day", "1 hour"), ["run_key"]
    )
    rows = [(r["run_key"], r["last_update"], r["expired"]) for r in found.collect()]
    assert [r for r in rows if r[0] == 1 and r[2]] == [(1, hours(0), True)]
    assert late == 1 and (1, hours(1), False) not in rows  # came 59 hours behind
    assert {r[0] for r in rows if r[2]} <= {1, 2}
    assert max(r[1] for r in rows if r[0] == 2) == hours(62)


@pytest.mark.parametrize("name", ["telemetry_expiring", "heartbeat_expiring"])
def test_rows_without_time_or_no_rows(spark, name):
    schema = "run_key bigint, seq bigint, ts timestamp_ntz, fields map<string,string>"
    found, _, _ = run_files(spark, [[(1, 1, None, {"a": "1"}), (2, 1, hours(1), {"a": None, "b": "2"}), (3, 1, hours(1), None)]], schema, getattr(expiring, name), [])
    assert {r["run_key"] for r in found.collect()} == ({2} if name.startswith("tele") else {2, 3})


def test_a_slice_of_several_files_is_one_batch(spark, tmp_path):
    # Four input files: rows of a slice's later files came late, and were lost, when each file was a batch.
    rows = [(i, (i * 7) % 40, hours(float(i % 720)), ("click", "view", "error", "signup")[i % 4], float(i % 60), f'{{"k": {i % 9}}}') for i in range(2000)]
    table = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string")
    table.repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    t = Tables(spark, str(tmp_path))
    stream = q_logs.sliced_event_stream(t, file_rows=100)
    found = run_update(expiring.heartbeat_expiring(stream.select(F.col("user_id").alias("run_key"), "ts")), ["run_key"], "beats")
    want = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert sorted(map(tuple, found.select("run_key", "last_update").collect())) == sorted(map(tuple, want.collect()))
