"""Tables derived from the given ones, each stated once per engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels with a rule-based prediction and made-up class scores.
PREDICTIONS_SQL = """predictions as (select o_orderkey, o_orderstatus as label,
    case when o_totalprice > 330000 then 'F' when o_totalprice > 150000 then 'O' when o_totalprice > 2000 then 'P' else 'X' end as prediction,
    round(o_totalprice % 1000) / 1000 as p_f, round((o_totalprice * 3) % 1000) / 1000 as p_o, round((o_totalprice * 7) % 1000) / 1000 as p_p from orders)"""
CLASS_SCORES = {"F": "p_f", "O": "p_o", "P": "p_p"}


def predictions(t) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderstatus").alias("label"),
        F.when(price > 330000, "F").when(price > 150000, "O").when(price > 2000, "P").otherwise("X").alias("prediction"),
        (F.round(price % 1000) / 1000).alias("p_f"),
        (F.round((price * 3) % 1000) / 1000).alias("p_o"),
        (F.round((price * 7) % 1000) / 1000).alias("p_p"),
    )


# Experiment runs in long form: one row per parameter, metric or tag.
RUNS_SQL = """runs as (select o_orderkey::varchar as run_id, o_orderpriority as experiment,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status, o_orderdate as started_at,
    o_orderdate + to_seconds(o_custkey * 7) as finished_at, 'model_' || (o_custkey % 9) as model,
    (o_orderkey % 11) + 1 as fold_count, round(o_totalprice % 100) / 100 as auc, o_totalprice / 1000 as rmse, o_custkey as custkey, o_orderkey as seq from orders),
entries as (select run_id, experiment, 'param' as kind, 'model' as key, model as value, started_at as ts from runs
  union all select run_id, experiment, 'param', 'folds', '1', started_at - interval 1 day from runs
  union all select run_id, experiment, 'param', 'folds', fold_count::varchar, started_at from runs
  union all select run_id, experiment, 'metric', 'auc', auc::varchar, started_at from runs where seq % 7 <> 0
  union all select run_id, experiment, 'metric', 'rmse', rmse::varchar, started_at from runs)"""


def runs(t) -> DataFrame:
    started = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("experiment"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        started.alias("started_at"),
        (started + F.make_dt_interval(secs=(F.col("o_custkey") * 7).cast("decimal(18,6)"))).alias("finished_at"),
        F.concat(F.lit("model_"), (F.col("o_custkey") % 9).cast("string")).alias("model"),
        ((F.col("o_orderkey") % 11) + 1).alias("fold_count"),
        (F.round(F.col("o_totalprice") % 100) / 100).alias("auc"),
        (F.col("o_totalprice") / 1000).alias("rmse"),
        F.col("o_custkey").alias("custkey"),
        F.col("o_orderkey").alias("seq"),
    )


def entries(t) -> DataFrame:
    """Long run table (run_id, experiment, kind, key, value, ts) from one pass over the runs."""

    def row(kind, key, value, ts="started_at", keep=None):
        ts = F.col(ts) if isinstance(ts, str) else ts
        item = F.struct(
            F.lit(kind).alias("kind"), F.lit(key).alias("key"), value.cast("string").alias("value"), ts.alias("ts"),
            (F.lit(True) if keep is None else keep).alias("keep"),
        )
        return item

    day_before = F.col("started_at") - F.make_dt_interval(days=F.lit(1))
    rows = F.array(
        row("param", "model", F.col("model")),
        row("param", "folds", F.lit("1"), day_before),
        row("param", "folds", F.col("fold_count")),
        row("metric", "auc", F.col("auc"), keep=F.col("seq") % 7 != 0),
        row("metric", "rmse", F.col("rmse")),
    )
    return runs(t).select("run_id", "experiment", F.inline(rows)).where("keep").drop("keep")


# Log lines of runs: one line per event, one run per user.
LINES_SQL = """log_lines as (select user_id as run_key, event_id as seq, ts, case event_type
    when 'signup' then 'INFO: Starting TPOT training <' || user_id || '>' when 'view' then 'Generation: ' || (props ->> '$.k') || ' █▌▄ score_val model & auc'
    when 'click' then '  Training completed ' when 'purchase' then case when value > 12 then 'Pipeline exported' else ' best pipeline: Pipeline(' || value || ')' end
    else case when value > 10 then '   ' else 'ERROR ' || event_id end end as line from events)"""


def log_lines(events: DataFrame) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    line = (
        F.when(kind == "signup", F.concat(F.lit("INFO: Starting TPOT training <"), F.col("user_id").cast("string"), F.lit(">")))
        .when(kind == "view", F.concat(F.lit("Generation: "), F.get_json_object("props", "$.k"), F.lit(" █▌▄ score_val model & auc")))
        .when(kind == "click", "  Training completed ")
        .when(
            kind == "purchase",
            F.when(value > 12, "Pipeline exported").otherwise(F.concat(F.lit(" best pipeline: Pipeline("), value.cast("string"), F.lit(")"))),
        )
        .otherwise(F.when(value > 10, "   ").otherwise(F.concat(F.lit("ERROR "), F.col("event_id").cast("string"))))
    )
    return events.select(F.col("user_id").alias("run_key"), F.col("event_id").alias("seq"), "ts", line.alias("line"))


# Daily event counts per type: the forecasting series.
DAILY_SQL = "daily as (select event_type as series, ts::date as day, count(*)::double as y from events group by 1, 2)"


def daily(t) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(
        F.count("*").cast("double").alias("y")
    )
