"""Log, telemetry and run-status queries, in batch and as streams over the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.fixed import LINE_CLASSES, RUN_STEPS
from tabloom.operators import logs as L
from tabloom.plans.derived import LINES_SQL, log_lines
from tabloom.plans.registry import query
from tabloom.session import scratch_path
from tabloom.streaming import runs as SR
from tabloom.streaming.expiring import heartbeat_expiring, telemetry_expiring
from tabloom.streaming.sinks import run_append, run_update


def event_stream(t):
    """The events table as a file stream."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{t.folder}/events.parque[t]")


#: Rows of a file of a slice.
FILE_ROWS = 500_000


def sliced_event_stream(t, slices: int = 5, file_rows: int = FILE_ROWS):
    """All events as a file stream that brings one time slice after the other.

    A batch is a whole slice, as rows of a slice that came in a later batch than others would be late: every slice has
    the same number of files, empty ones included.
    """
    folder = scratch_path(t.spark, "event-slices")
    first, last = t.events.agg(F.min("ts"), F.max("ts")).first()
    bounds = [(first + (last - first) * i / slices, first + (last - first) * (i + 1) / slices) for i in range(slices)]
    inside = [(F.col("ts") >= low) & ((F.col("ts") < high) if i + 1 < slices else F.lit(True)) for i, (low, high) in enumerate(bounds)]
    files = 1 + max(t.events.agg(*[F.count_if(c) for c in inside]).first()) // file_rows
    for i, c in enumerate(inside):
        path = f"{folder}/slice={i}"
        t.events.where(c).repartition(files).write.parquet(path)
        for _ in range(files - len(t.spark.read.parquet(path).inputFiles())):
            t.events.limit(0).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files)
    return stream.parquet(f"{folder}/slice=*")


def _contains(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _class_sql(line: str) -> str:
    cases = " ".join(f"when {_contains(f'lower({line})', ws)} then '{name}'" for name, ws in LINE_CLASSES.items())
    return f"case {cases} else 'normal' end"


_ESCAPE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_CLASSIFY = f"with {LINES_SQL} select run_key, seq, {_class_sql('line')} as line_class, {_ESCAPE.format('line')} as safe_line from log_lines"


@query("k1_classify_lines", _CLASSIFY)
def k1(t):
    return L.classify_lines(log_lines(t.events)).drop("ts", "line")


@query("k1_classify_lines_stream", _CLASSIFY)
def k1_stream(t):
    return run_append(L.classify_lines(log_lines(event_stream(t))).drop("ts", "line"), "classify")


@query("k1_classify_documents", f"select doc_id, {_class_sql('text')} as line_class from documents")
def k1_documents(t):
    return L.classify_lines(t.documents.select("doc_id", F.col("text").alias("line"))).select("doc_id", "line_class")


@query(
    "k3_tail_lines",
    f"""with {LINES_SQL}, r as (select run_key, seq, line, row_number() over (partition by run_key order by seq desc) as r from log_lines)
    select run_key, seq, line from r where r <= 80""",
)
def k3(t):
    return L.tail_lines(log_lines(t.events).drop("ts"), 80)


@query(
    "k3_tail_conversations",
    """with r as (select conv_id as run_key, turn as seq, text as line, row_number() over (partition by conv_id order by turn desc) as r from conversations)
    select run_key, seq, line from r where r <= 2""",
)
def k3_conversations(t):
    lines = t.conversations.select(F.col("conv_id").alias("run_key"), F.col("turn").alias("seq"), F.col("text").alias("line"))
    return L.tail_lines(lines, 2)


_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


@query(
    "k4_clean_line",
    f"""with {LINES_SQL}, c as (select run_key, seq, trim(translate(line, '█▌▄', '#|-'), {_BLANK}) as line from log_lines)
    select run_key, seq, line, {_ESCAPE.format('line')} as safe_line from c where line <> ''""",
)
def k4(t):
    cleaned = L.clean_lines(log_lines(t.events).drop("ts"))
    return L.classify_lines(cleaned).drop("line_class")


@query(
    "k4_clean_html",
    f"""with c as (select page_id, trim(translate(html, '█▌▄', '#|-'), {_BLANK}) as line from pages)
    select page_id, {_ESCAPE.format('line')} as safe_line from c where line <> ''""",
)
def k4_html(t):
    cleaned = L.clean_lines(t.pages.select("page_id", F.col("html").alias("line")))
    return L.classify_lines(cleaned).select("page_id", "safe_line")


# Threads registered to runs: every supplier except those of the first nations.
_THREADS_SQL = "threads as (select s_suppkey as thread_id, 'run_' || s_nationkey as run_key from supplier where s_nationkey > 4)"
_ROUTE = f"""with {LINES_SQL}, {_THREADS_SQL} select l.run_key as thread_id, seq, coalesce(t.run_key, 'default') as run_key
    from log_lines l left join threads t on t.thread_id = l.run_key"""


def _threads(t):
    return t.supplier.where("s_nationkey > 4").select(
        F.col("s_suppkey").alias("thread_id"), F.concat(F.lit("run_"), F.col("s_nationkey").cast("string")).alias("run_key")
    )


@query("k5_route_lines", _ROUTE)
def k5(t):
    lines = log_lines(t.events).select(F.col("run_key").alias("thread_id"), "seq")
    return L.route_lines(lines, _threads(t))


@query("k5_route_lines_stream", _ROUTE)
def k5_stream(t):
    lines = log_lines(event_stream(t)).select(F.col("run_key").alias("thread_id"), "seq")
    return run_append(L.route_lines(lines, _threads(t)), "route")


def _step_sql(family: str, which: int) -> str:
    cases = [f"case when {_contains('lower(line)', s[which])} then {i} else -1 end" for i, s in enumerate(RUN_STEPS[family])]
    return f"greatest({', '.join(cases)})"


_FAMILIES = list(RUN_STEPS)


def _family_sql(which: int) -> str:
    return "case family " + " ".join(f"when '{f}' then {_step_sql(f, which)}" for f in _FAMILIES) + " end"


_LABELS = " union all ".join(
    f"select '{f}' as family, {i} as step, '{s[0]}' as label" for f, steps in RUN_STEPS.items() for i, s in enumerate(steps)
)
_RUN_TABLE_SQL = f"""runs as (select distinct user_id as run_key,
    case when user_id % 9 < 4 then 'tpot' else (['{"', '".join(_FAMILIES)}'])[user_id % 6 + 1] end as family,
    (['running', 'completed', 'failed', 'cancelled', 'queued'])[user_id % 5 + 1] as status from events)"""


def _run_table(t):
    families = F.array(*[F.lit(f) for f in _FAMILIES])
    states = F.array(*[F.lit(s) for s in ("running", "completed", "failed", "cancelled", "queued")])
    user = F.col("user_id")
    family = F.when(user % 9 < 4, "tpot").otherwise(F.get(families, (user % 6).cast("int")))
    return t.events.select(user).distinct().select(
        user.alias("run_key"), family.alias("family"), F.get(states, (user % 5).cast("int")).alias("status")
    )


@query(
    "k6_run_steps",
    f"""with {LINES_SQL}, {_RUN_TABLE_SQL}, labels as ({_LABELS}),
    s as (select run_key, max({_family_sql(1)}) as started, max({_family_sql(2)}) as finished from log_lines join runs using (run_key) group by 1)
    select r.run_key, step, label, case when status = 'completed' then 'done'
      when status in ('failed', 'cancelled') then (case when step < started then 'done' when step = started then status else 'pending' end)
      when step <= finished then 'done' when step = least(finished + 1, 4) and status = 'running' then 'active' else 'pending' end as step_status
    from runs r join s using (run_key) join labels using (family)""",
)
def k6(t):
    return L.run_steps(log_lines(t.events), _run_table(t))


@query(
    "k7_best_candidate_line",
    f"""with {LINES_SQL} select run_key, arg_max(trim(line), seq) as best_line from log_lines
    where {_contains('lower(line)', L.BEST_MARKERS)} group by 1""",
)
def k7(t):
    return L.best_pipeline_line(log_lines(t.events))


@query(
    "k8_leaderboard_block",
    f"""with {LINES_SQL}, h as (select run_key, min(seq) as head from log_lines where contains(lower(line), 'model') and contains(lower(line), 'score_val') group by 1),
    a as (select l.run_key, seq, line, row_number() over (partition by l.run_key order by seq) as position from log_lines l join h using (run_key) where seq >= head)
    select run_key, seq, line, position::int as position from a where position <= 16""",
)
def k8(t):
    return L.leaderboard_block(log_lines(t.events).drop("ts"))


_TELEMETRY_SQL = """pairs as (select user_id as run_key, event_id as seq, ts, unnest([
      {'key': case event_type when 'click' then 'iterations' when 'view' then 'models_trained' when 'error' then 'best_loss' else 'best_value' end, 'value': props ->> '$.k'},
      {'key': 'last_kind', 'value': event_type}], recursive := true) from events),
    state as (select run_key, key, arg_max(value, seq) as value, max(ts) as ts from pairs group by 1, 2)"""


def _telemetry(events):
    kind = F.col("event_type")
    key = F.when(kind == "click", "iterations").when(kind == "view", "models_trained").when(kind == "error", "best_loss").otherwise("best_value")
    fields = F.create_map(key, F.get_json_object("props", "$.k"), F.lit("last_kind"), kind)
    return events.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("seq"), "ts", fields.alias("fields"))


@query("k9_telemetry_state", f"with {_TELEMETRY_SQL} select * from state")
def k9(t):
    return L.telemetry_state(_telemetry(t.events))


@query("k9_telemetry_state_stream", f"with {_TELEMETRY_SQL} select * from state")
def k9_stream(t):
    return run_update(SR.telemetry_stream(_telemetry(event_stream(t))), ["run_key", "key"], "telemetry")


@query(
    "k9_telemetry_progress",
    f"""with {_TELEMETRY_SQL} select run_key, coalesce(max(value) filter (key = 'models_trained'), max(value) filter (key = 'iterations'), '0')::double as models_trained,
    coalesce(max(value) filter (key = 'best_value'), max(value) filter (key = 'best_loss'), '0')::double as best_value, 'Score' as best_metric, max(ts) as last_update from state group by 1""",
)
def k9_progress(t):
    return L.telemetry_progress(L.telemetry_state(_telemetry(t.events)))


_STATUS_EVENTS_SQL = """ev as (select user_id as run_key, event_id as seq, ts, case
    when event_type = 'signup' then 'start' when event_type = 'purchase' and value > 45 then 'result_ok' when event_type = 'purchase' and value > 40 then 'result_fail'
    when event_type = 'click' and value > 50 then 'cancel' when event_type = 'error' and value > 50 then 'worker_end' else 'log' end as kind from events)"""
_STATUS_SQL = f"""with {_STATUS_EVENTS_SQL}, s as (select run_key, min(seq) filter (kind = 'start') as start from ev group by 1),
    x as (select run_key, max(start) as start, min(seq) filter (kind in ('result_ok', 'result_fail') or (kind in ('cancel', 'worker_end') and seq > start)) as fin
      from ev join s using (run_key) group by 1)
    select x.run_key, case when fin is null then (case when start is null then 'queued' else 'running' end)
      when e.kind = 'result_ok' then 'completed' when e.kind = 'cancel' then 'cancelled' else 'failed' end as status,
      case when e.kind = 'worker_end' then 'Thread terminated unexpectedly' end as error, e.ts as finished_at
    from x left join ev e on e.run_key = x.run_key and e.seq = x.fin"""


def _status_events(events):
    kind, value = F.col("event_type"), F.col("value")
    what = (
        F.when(kind == "signup", "start")
        .when((kind == "purchase") & (value > 45), "result_ok")
        .when((kind == "purchase") & (value > 40), "result_fail")
        .when((kind == "click") & (value > 50), "cancel")
        .when((kind == "error") & (value > 50), "worker_end")
        .otherwise("log")
    )
    return events.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("seq"), "ts", what.alias("kind"))


@query("k10_run_status", _STATUS_SQL)
def k10(t):
    return L.run_status(_status_events(t.events))


@query("k10_run_status_stream", _STATUS_SQL)
def k10_stream(t):
    return run_update(SR.run_status_stream(_status_events(event_stream(t))), ["run_key"], "status").drop("last_seq")


@query(
    "k10_normalise_results",
    """select user_id as run_key, event_id as seq, event_type <> 'error' as success, case when event_type = 'click' then 'r' || (props ->> '$.k') end as run_id,
    case when event_type = 'view' then 'tpot' else 'unknown' end as type, case when event_type = 'error' then 'bad' end as error, event_type = 'error' and value > 20 as cancelled from events""",
)
def k10_results(t):
    kind = F.col("event_type")
    payload = F.to_json(
        F.struct(
            F.when(kind == "error", "false").alias("success"),
            F.when(kind == "click", F.concat(F.lit("r"), F.get_json_object("props", "$.k"))).alias("run_id"),
            F.when(kind == "view", "tpot").alias("type"),
            F.when(kind == "error", "bad").alias("error"),
            F.when((kind == "error") & (F.col("value") > 20), "true").alias("cancelled"),
        )
    )
    results = t.events.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("seq"), payload.alias("payload"))
    return L.normalise_results(results)


@query(
    "k11_heartbeat",
    f"""with {LINES_SQL}, {_RUN_TABLE_SQL}, l as (select run_key, max(ts) as last_update from log_lines group by 1)
    select run_key, status, last_update, (status = 'running' and last_update > timestamp '2024-01-30 12:00:00' - interval 3600 second)::int as is_active
    from runs left join l using (run_key)""",
)
def k11(t):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return L.heartbeat(log_lines(t.events), _run_table(t), now, 3600)


@query("k9_telemetry_expiring_stream", f"with {_TELEMETRY_SQL} select * from state")
def k9_expiring(t):
    return run_update(telemetry_expiring(_telemetry(sliced_event_stream(t))), ["run_key", "key"], "telemetry")


@query("k11_heartbeat_expiring_stream", f"with {LINES_SQL} select run_key, max(ts) as last_update from log_lines group by 1")
def k11_expiring(t):
    beats = run_update(heartbeat_expiring(log_lines(sliced_event_stream(t))), ["run_key"], "heartbeat")
    return beats.select("run_key", "last_update")


@query("k11_heartbeat_stream", f"with {LINES_SQL} select run_key, max(ts) as last_update from log_lines group by 1")
def k11_stream(t):
    return run_update(SR.heartbeat_stream(log_lines(event_stream(t))), ["run_key"], "heartbeat")
