"""Training logs and telemetry as tables: line classes, tails, run steps, run status.

The row-wise functions take batch and streaming tables alike; their stateful streaming twins live in
`tabloom.streaming`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.fixed import RUN_STEPS
from tabloom.functions.text import any_word, clean_line, escape_markup, has_word, line_class
from tabloom.operators.ranks import join_lookup

TAIL_LINES = 80
BOARD_LINES = 16
HEARTBEAT_SECONDS = 5


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds the class of each line and its escaped text."""
    return lines.withColumns({"line_class": line_class(F.col("line")), "safe_line": escape_markup(F.col("line"))})


def clean_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Blank lines removed, glyphs replaced, trimmed."""
    cleaned = clean_line(F.col(column))
    return lines.where(cleaned != "").withColumn(column, cleaned)


def tail_lines(lines: DataFrame, n: int = TAIL_LINES) -> DataFrame:
    """The last n lines of each run; a limited window, cut to n lines per run before the shuffle."""
    w = W.partitionBy("run_key").orderBy(F.desc("seq"))
    return lines.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def route_lines(lines: DataFrame, threads: DataFrame, default: str = "default") -> DataFrame:
    """Sets `run_key` to the owner of the line's thread, or the default sink for unregistered threads."""
    owners = threads.select("thread_id", F.col("run_key").alias("_owner"))
    joined = join_lookup(lines, owners, "thread_id", "left")
    return joined.withColumn("run_key", F.coalesce("_owner", F.lit(default))).drop("_owner")


def _last_step(line: Column, family: Column, which: int) -> Column:
    """Highest step (from 0) of the run's family with one of its words in the line; null if none."""
    result = None
    for name, steps in RUN_STEPS.items():
        hit = None
        for i in reversed(range(len(steps))):
            found = has_word(line, steps[i][which])
            hit = F.when(found, i) if hit is None else hit.when(found, i)
        result = F.when(family == name, hit) if result is None else result.when(family == name, hit)
    return result


def run_steps(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Status of every step of every run.

    `runs` has (run_key, family, status). completed: all done. failed or cancelled: the last started step
    takes that status, earlier ones are done, later ones pending. Otherwise everything up to the last
    finished step is done and the next one active if the run is running.
    """
    families = runs.select("run_key", F.lower("family").alias("_family"))
    joined = join_lookup(lines.select("run_key", F.lower("line").alias("_line")), families, "run_key")
    seen = joined.groupBy("run_key").agg(
        F.max(_last_step(F.col("_line"), F.col("_family"), 1)).alias("_started"),
        F.max(_last_step(F.col("_line"), F.col("_family"), 2)).alias("_finished"),
    )
    labels = None
    for name, steps in RUN_STEPS.items():
        one = F.array(*[F.lit(s[0]) for s in steps])
        hit = F.lower("family") == name
        labels = F.when(hit, one) if labels is None else labels.when(hit, one)
    known = runs.join(seen, "run_key", "left").withColumns(
        {"_started": F.coalesce("_started", F.lit(-1)), "_finished": F.coalesce("_finished", F.lit(-1)), "_labels": labels}
    )
    steps = known.select(
        "run_key", "status", "_started", "_finished", F.size("_labels").alias("_k"), F.posexplode("_labels").alias("step", "label")
    )
    step, started, finished = F.col("step"), F.col("_started"), F.col("_finished")
    stopped = F.col("status").isin("failed", "cancelled")
    active = F.least(finished + 1, F.col("_k") - 1)
    step_status = (
        F.when(F.col("status") == "completed", "done")
        .when(stopped & (step < started), "done")
        .when(stopped & (step == started), F.col("status"))
        .when(stopped, "pending")
        .when(step <= finished, "done")
        .when((step == active) & (F.col("status") == "running"), "active")
        .otherwise("pending")
    )
    return steps.select("run_key", "step", "label", step_status.alias("step_status"))


BEST_MARKERS = ["best pipeline:", "fitted_pipeline_", "pipeline("]


def best_pipeline_line(lines: DataFrame) -> DataFrame:
    """Last line per run that names the best pipeline, trimmed."""
    found = lines.where(any_word(F.col("line"), BEST_MARKERS))
    return found.groupBy("run_key").agg(F.max_by(F.btrim("line", F.lit(" \t\n\r")), "seq").alias("best_line"))


def leaderboard_block(lines: DataFrame, n: int = BOARD_LINES) -> DataFrame:
    """At most n lines per run from the first line that has both `model` and `score_val`."""
    low = F.lower("line")
    heads = lines.where(low.contains("model") & low.contains("score_val"))
    first = heads.groupBy("run_key").agg(F.min("seq").alias("_head"))
    after = join_lookup(lines, first, "run_key").where(F.col("seq") >= F.col("_head"))
    w = W.partitionBy("run_key").orderBy("seq")
    return after.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).drop("_head")


def telemetry_state(telemetry: DataFrame) -> DataFrame:
    """Last value of every telemetry key per run; `telemetry` has (run_key, seq, ts, fields map)."""
    pairs = telemetry.select("run_key", "seq", "ts", F.explode("fields").alias("key", "value"))
    return pairs.groupBy("run_key", "key").agg(F.max_by("value", "seq").alias("value"), F.max("ts").alias("ts"))


def telemetry_progress(state: DataFrame) -> DataFrame:
    """One row per run: models trained (or iterations), best value (or loss), metric name, last update."""

    def last(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.col("value")))

    return state.groupBy("run_key").agg(
        F.coalesce(last("models_trained"), last("iterations")).try_cast("double").alias("models_trained"),
        F.coalesce(F.coalesce(last("best_value"), last("best_loss")).try_cast("double"), F.lit(0.0)).alias("best_value"),
        F.coalesce(last("best_metric"), F.lit("Score")).alias("best_metric"),
        F.max("ts").alias("last_update"),
    ).withColumn("models_trained", F.coalesce("models_trained", F.lit(0.0)))


def normalise_results(events: DataFrame) -> DataFrame:
    """Result events in one shape (success, run_id, type, error, cancelled), whatever fields a worker sent."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return events.select(
        "run_key",
        "seq",
        F.coalesce(field("success").try_cast("boolean"), F.lit(True)).alias("success"),
        field("run_id").alias("run_id"),
        F.coalesce(field("type"), F.lit("unknown")).alias("type"),
        field("error").alias("error"),
        F.coalesce(field("cancelled").try_cast("boolean"), F.lit(False)).alias("cancelled"),
    )


UNEXPECTED_END = "Thread terminated unexpectedly"


def run_status(events: DataFrame) -> DataFrame:
    """Status of each run from its events (run_key, seq, ts, kind).

    Kinds: start, result_ok, result_fail, cancel, worker_end. A result ends a queued or running run; cancel
    and worker_end count only while it runs; whatever ends the run first stays. Two combined aggregations:
    the first start per run, then the first ending event after it.
    """
    starts = events.groupBy("run_key").agg(F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("_start"))
    joined = join_lookup(events, starts, "run_key")
    is_result = F.col("kind").isin("result_ok", "result_fail")
    while_running = F.col("kind").isin("cancel", "worker_end") & (F.col("seq") > F.col("_start"))
    ending = F.when(is_result | while_running, F.col("seq"))
    ended = joined.groupBy("run_key").agg(
        F.max("_start").alias("_start"), F.min_by(F.struct("kind", "ts"), ending).alias("_end")
    )
    kind = F.col("_end.kind")
    status = (
        F.when(kind == "result_ok", "completed")
        .when(kind.isin("result_fail", "worker_end"), "failed")
        .when(kind == "cancel", "cancelled")
        .when(F.col("_start").isNotNull(), "running")
        .otherwise("queued")
    )
    error = F.when(kind == "worker_end", UNEXPECTED_END)
    return ended.select("run_key", status.alias("status"), error.alias("error"), F.col("_end.ts").alias("finished_at"))


def heartbeat(lines: DataFrame, runs: DataFrame, now: Column, seconds: int = HEARTBEAT_SECONDS) -> DataFrame:
    """A running run is active while its last update is less than `seconds` old."""
    last = lines.groupBy("run_key").agg(F.max("ts").alias("last_update"))
    joined = runs.select("run_key", "status").join(last, "run_key", "left")
    fresh = F.col("last_update") > now - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return joined.withColumn("is_active", F.coalesce((F.col("status") == "running") & fresh, F.lit(False)).cast("int"))
