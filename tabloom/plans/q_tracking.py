"""Experiment-tracking queries over runs derived from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import tracking as T
from tabloom.plans.derived import RUNS_SQL, entries, runs
from tabloom.plans.registry import query

NAMES = ["metrics.auc", "metrics.rmse", "params.folds", "params.model"]
_LATEST = f"""{RUNS_SQL}, latest as (select run_id, experiment, kind, key, arg_max(value, ts) as value from entries group by all),
  wide as (select run_id, max(value) filter (kind = 'metric' and key = 'auc')::double as "metrics.auc", max(value) filter (kind = 'metric' and key = 'rmse')::double as "metrics.rmse",
  max(value) filter (kind = 'param' and key = 'folds') as "params.folds", max(value) filter (kind = 'param' and key = 'model') as "params.model"
  from latest where experiment = '1-URGENT' group by 1)"""


@query("j2_search_runs", f"with {_LATEST} select * from wide")
def j2(t):
    return T.search_runs(entries(t), "1-URGENT")


def _selected(t):
    return runs(t).where("status = 'completed'")


@query(
    "j3_compare_runs",
    f"""with {_LATEST} select run_id, "metrics.auc" as auc, "metrics.rmse" as rmse from wide
    where run_id in (select run_id from runs where status = 'completed')""",
)
def j3(t):
    return T.compare_runs(T.search_runs(entries(t), "1-URGENT", NAMES), _selected(t))


@query(
    "j3_compare_runs_long",
    f"""with {_LATEST}, s as (select * from wide where run_id in (select run_id from runs where status = 'completed'))
    select run_id, 'auc' as metric, "metrics.auc" as value from s union all select run_id, 'rmse', "metrics.rmse" from s""",
)
def j3_long(t):
    return T.compare_runs_long(T.search_runs(entries(t), "1-URGENT", NAMES), _selected(t))


@query(
    "j4_leaderboard_top5",
    f"""with {RUNS_SQL}, r as (select experiment, run_id, auc, row_number() over (partition by experiment order by auc desc, run_id) as rank from runs)
    select * from r where rank <= 5""",
)
def j4(t):
    return T.leaderboard(runs(t).select("experiment", "run_id", "auc"), "auc", "auc", ["experiment"], "run_id", 5)


@query(
    "j4_leaderboard_full",
    f"with {RUNS_SQL} select experiment, run_id, rmse, row_number() over (partition by experiment order by rmse, run_id) as rank from runs",
)
def j4_full(t):
    return T.leaderboard(runs(t).select("experiment", "run_id", "rmse"), "rmse", "rmse", ["experiment"], "run_id", None)


@query(
    "j5_best_metric",
    f"""with {RUNS_SQL}, b as (select experiment, model, min(case when experiment = '2-HIGH' then null when experiment = '3-MEDIUM' then 0.0 else 1 - auc end) as auc,
      min(rmse) as rmse from runs where experiment <> '5-LOW' group by 1, 2),
    r as (select *, row_number() over (partition by experiment order by rmse, model) as rk, count(*) over (partition by experiment) as n_models from b),
    s as (select experiment, n_models, case when auc is not null then 'auc' else 'rmse' end as m, coalesce(auc, rmse) as v, rmse from r where rk = 1)
    select e.experiment, coalesce(n_models, 0) as n_models, case when m is null then 'none' when v = 0.0 then 'rmse' else m end as best_metric_name,
    coalesce(case when v = 0.0 then rmse else v end, 0.0) as best_model_score from (select distinct experiment from runs) e left join s using (experiment)""",
)
def j5(t):
    r = runs(t)
    auc = F.when(F.col("experiment") == "3-MEDIUM", 0.0).when(F.col("experiment") != "2-HIGH", 1 - F.col("auc"))
    board = r.where("experiment <> '5-LOW'").groupBy("experiment", "model").agg(F.min("rmse").alias("rmse"), F.min(auc).alias("auc"))
    ranked = T.leaderboard(board, "rmse", "rmse", ["experiment"], "model", None)
    return T.best_metric(ranked, "experiment", "rank", ["rmse", "auc"], r)


@query(
    "j6_run_details",
    f"""with {RUNS_SQL}, latest as (select kind, key, arg_max(value, ts) as value from entries where run_id = '42' group by all)
    select kind, key, case when kind = 'param' then value end as text, case when kind = 'metric' then round(value::double, 6) end as number from latest""",
)
def j6(t):
    return T.run_details(entries(t), "42")


@query(
    "j7_status_counts",
    f"""with {RUNS_SQL}, s as (select unnest(['running', 'completed', 'failed', 'cancelled']) as status)
    select s.status, count(r.run_id) as n from s left join runs r using (status) group by 1""",
)
def j7(t):
    return T.status_counts(runs(t))


@query(
    "j8_list_runs",
    f"""with {RUNS_SQL}, r as (select run_id, started_at, date_diff('second', started_at, finished_at) as s from runs)
    select run_id, started_at, (s // 60)::varchar || 'm ' || lpad((s % 60)::varchar, 2, '0') || 's' as elapsed from r order by started_at desc, run_id""",
)
def j8(t):
    return T.list_runs(runs(t).select("run_id", "started_at", "finished_at")).drop("finished_at")


@query("j9_keep_well_formed", "select doc_id, source from documents where doc_id in (select doc_id from labels)")
def j9(t):
    return T.drop_malformed(t.documents.select("doc_id", "source"), t.labels, "doc_id")[0]


@query("j9_report_malformed", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def j9_report(t):
    return T.drop_malformed(t.documents.select("doc_id", "source"), t.labels, "doc_id")[1]


@query(
    "j10_register_version",
    """with e as (select 'model_' || p_brand as name, max(p_size) as top from part group by 1),
    n as (select 'model_Brand#' || (o_custkey % 30) as name, o_orderdate, o_orderkey from orders)
    select n.name, o_orderdate, o_orderkey, coalesce(top, 0) + row_number() over (partition by n.name order by o_orderdate, o_orderkey) as version
    from n left join e using (name)""",
)
def j10(t):
    existing = t.part.select(F.concat(F.lit("model_"), "p_brand").alias("name"), F.col("p_size").cast("long").alias("version"))
    name = F.concat(F.lit("model_Brand#"), (F.col("o_custkey") % 30).cast("string"))
    new = t.orders.select(name.alias("name"), "o_orderdate", "o_orderkey")
    return T.register_versions(new, existing, "name", ["o_orderdate", "o_orderkey"])


@query(
    "j11_lineage",
    """with m as (select 'set_' || p_partkey as name, substr(md5(p_name || p_partkey), 1, 8) as short8 from part),
    u as (select o_orderkey::varchar as run_id, 'train' as role, 'set_' || o_custkey as name from orders
      union all select o_orderkey::varchar, 'valid', 'set_' || (o_custkey * 2) from orders where o_orderstatus <> 'F'
      union all select o_orderkey::varchar, 'test', 'set_' || (o_custkey + 7) from orders)
    select run_id, role, name, coalesce(short8, 'unknown') as short8 from u left join m using (name)""",
)
def j11(t):
    text = lambda c: F.concat(F.lit("set_"), c.cast("string"))
    manifest = t.part.select(
        text(F.col("p_partkey")).alias("name"), F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("fingerprint")
    )
    r = t.orders.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        text(F.col("o_custkey")).alias("train"),
        F.when(F.col("o_orderstatus") != "F", text(F.col("o_custkey") * 2)).alias("valid"),
        text(F.col("o_custkey") + 7).alias("test"),
    )
    return T.lineage(r, manifest, {"train": "train", "valid": "valid", "test": "test"})
