"""Sources, snapshots, images and streams over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from tabloom.operators import logs as L
from tabloom.session import scratch_path
from tabloom.sources import images, snapshots, tables
from tabloom.streaming import runs as SR
from tabloom.streaming.sinks import run_append, run_update


def test_unknown_extension(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.docx")
    with pytest.raises(ValueError):
        tables.read_headerless(spark, "x.parquet")


def test_fingerprint_ignores_order_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "i int, s string")
    one = snapshots.fingerprint(df).first()
    assert one == snapshots.fingerprint(df.orderBy(F.desc("i")).repartition(3)).first()
    changed = df.withColumn("s", F.coalesce("s", F.lit("")))
    assert one["fingerprint"] != snapshots.fingerprint(changed).first()["fingerprint"]
    twice = df.unionByName(df.limit(1))
    assert one["fingerprint"] != snapshots.fingerprint(twice).first()["fingerprint"]


def test_snapshots_newest_first(spark):
    lake = scratch_path(spark, "lake")
    df = spark.range(5)
    a = snapshots.write_snapshot(df, lake, "a", 10)
    snapshots.write_snapshot(df, lake, "b", 20)
    assert [r["name"] for r in snapshots.list_snapshots(spark, lake).collect()] == ["b_20", "a_10"]
    assert snapshots.lookup_fingerprint(spark, lake, a["path"]).first()["short8"] == a["short8"]
    assert snapshots.list_snapshots(spark, lake, "images").count() == 0


def test_image_tree(spark, tmp_path):
    for name, data in {"class_a/img1.png": b"w", "class_b/img2.PNG": b"x", "class_b/deep/img3.jpeg": b"y", "class_b/note.txt": b"z"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    index = images.image_index(spark, str(tmp_path))
    assert sorted(r["label"] for r in index.collect()) == ["class_a", "class_b", "deep"]
    before = images.image_set_fingerprint(spark, str(tmp_path)).first()
    (tmp_path / "class_a/img1.png").write_bytes(b"changed")
    assert before["n_rows"] == 3 and before != images.image_set_fingerprint(spark, str(tmp_path)).first()


EVENTS = [
    # Runs: 1 completes, 2 is cancelled and stays so, 3 dies, 4 is cancelled before its start (ignored), 5 fails queued.
    (1, 1, "start"), (2, 2, "start"), (3, 3, "start"), (4, 4, "cancel"), (5, 5, "result_fail"),
    (1, 6, "log"), (2, 7, "cancel"), (4, 8, "start"), (1, 9, "result_ok"), (2, 10, "result_ok"), (3, 11, "worker_end"),
    (1, 12, "cancel"), (3, 13, "result_ok"), (5, 14, "start"),
]
WANT = {1: "completed", 2: "cancelled", 3: "failed", 4: "running", 5: "failed"}


def status_folder(spark, chunks, minutes=1):
    folder = scratch_path(spark, "events")
    for part in chunks:
        rows = [(k, s, f"2024-01-01 00:00:00", kind) for k, s, kind in part]
        df = spark.createDataFrame(rows, "run_key bigint, seq bigint, t string, kind string")
        ts = F.col("t").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("seq") * minutes).cast("int"))
        df.select("run_key", "seq", ts.alias("ts"), "kind").coalesce(1).write.mode("append").parquet(folder)
    return folder, "run_key bigint, seq bigint, ts timestamp_ntz, kind string"


@pytest.mark.parametrize("size", [2, 5, 14])
def test_status_stream_equals_batch(spark, size):
    folder, schema = status_folder(spark, [EVENTS[i:i + size] for i in range(0, len(EVENTS), size)])
    batch = {r["run_key"]: (r["status"], r["error"], r["finished_at"]) for r in L.run_status(spark.read.schema(schema).parquet(folder)).collect()}
    assert {k: v[0] for k, v in batch.items()} == WANT
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_update(SR.run_status_stream(stream), ["run_key"], "status")
    assert {r["run_key"]: (r["status"], r["error"], r["finished_at"]) for r in got.collect()} == batch


def test_status_stream_times_out(spark):
    folder, schema = status_folder(spark, [[(1, 1, "start"), (2, 1, "start")], [(2, 200, "result_ok")], [(2, 201, "cancel")]])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_update(SR.run_status_stream(stream, timeout_minutes=30), ["run_key"], "status")
    status = {r["run_key"]: (r["status"], r["error"]) for r in got.collect()}
    assert status == {1: ("failed", L.UNEXPECTED_END), 2: ("completed", None)}


def test_telemetry_stream_ignores_older(spark):
    folder = scratch_path(spark, "telemetry")
    for seq, value in ((1, "a"), (3, "c"), (2, "b")):
        one = spark.range(1).select(F.lit(1).cast("bigint").alias("run_key"), F.lit(seq).cast("bigint").alias("seq"),
                                    F.lit(f"2024-01-01 00:0{seq}:00").cast("timestamp_ntz").alias("ts"), F.create_map(F.lit("k"), F.lit(value)).alias("fields"))
        one.write.mode("append").parquet(folder)
    schema = "run_key bigint, seq bigint, ts timestamp_ntz, fields map<string, string>"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run_update(SR.telemetry_stream(stream), ["run_key", "key"], "telemetry").collect()
    assert [(r["key"], r["value"]) for r in got] == [("k", "c")]


def test_append_stream(spark):
    folder = scratch_path(spark, "lines")
    lines = spark.createDataFrame([("Error <1>",), ("all saved",), ("f1 0.9",), ("x",)], "line string")
    lines.write.parquet(folder)
    got = run_append(L.classify_lines(spark.readStream.schema("line string").parquet(folder)), "classes")
    assert {r["line"]: r["line_class"] for r in got.collect()} == {
        "Error <1>": "error", "all saved": "success", "f1 0.9": "metric", "x": "normal"
    }
