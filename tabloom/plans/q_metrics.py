"""Evaluation metrics of rule-based predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import metrics as M
from tabloom.plans.derived import CLASS_SCORES, DAILY_SQL, PREDICTIONS_SQL, daily, predictions
from tabloom.plans.registry import query


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("h1_confusion", f"with {PREDICTIONS_SQL} select label, prediction, count(*) as n from predictions group by 1, 2")
def h1(t):
    return M.confusion(predictions(t))


@query(
    "h1_confusion_pivot",
    f"""with {PREDICTIONS_SQL} select label, count(*) filter (prediction = 'F') as "F", count(*) filter (prediction = 'O') as "O",
    count(*) filter (prediction = 'P') as "P", count(*) filter (prediction = 'X') as "X" from predictions group by 1""",
)
def h1_pivot(t):
    return M.confusion_pivot(predictions(t), ["F", "O", "P", "X"])


@query("h2_accuracy", f"with {PREDICTIONS_SQL} select round(avg((label = prediction)::int), 6) as accuracy from predictions")
def h2(t):
    return rounded(M.accuracy(predictions(t)))


_CLASSES_SQL = f"""{PREDICTIONS_SQL},
  names as (select label as k from predictions union select prediction from predictions),
  sums as (select k, count(*) filter (label = k) as support, count(*) filter (prediction = k) as predicted, count(*) filter (label = k and prediction = k) as hits
    from names, predictions group by 1),
  classes as (select k as label, case when predicted > 0 then hits / predicted::double else 0 end as "precision", case when support > 0 then hits / support::double else 0 end as recall,
    case when support + predicted > 0 then 2.0 * hits / (support + predicted) else 0 end as f1, support, hits from sums)"""


@query(
    "h3_f1_scores",
    f"""with {_CLASSES_SQL} select round(sum(hits)::double / sum(support)::double, 6) as accuracy, round(avg(f1), 6)::double as f1_macro,
    round(sum(f1 * support) / sum(support)::double, 6)::double as f1_weighted, round(sum(hits)::double / sum(support)::double, 6) as f1_micro from classes""",
)
def h3(t):
    scores = M.classification_scores(predictions(t))
    return rounded(scores.select("accuracy", "f1_macro", "f1_weighted", "f1_micro"))


@query(
    "h4_classification_report",
    f"""with {_CLASSES_SQL} select label, round("precision", 6) as "precision", round(recall, 6) as recall, round(f1, 6)::double as f1, support from classes
    union all select 'accuracy', null, null, round(sum(hits)::double / sum(support)::double, 6), sum(support)::bigint from classes
    union all select 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint from classes
    union all select 'weighted avg', round(sum("precision" * support) / sum(support)::double, 6), round(sum(recall * support) / sum(support)::double, 6),
      round(sum(f1 * support) / sum(support)::double, 6), sum(support)::bigint from classes""",
)
def h4(t):
    return rounded(M.classification_report(predictions(t)))


@query(
    "h5_macro_scores",
    f"""with {_CLASSES_SQL} select round(avg(recall) filter (support > 0), 6) as balanced_accuracy, round(avg("precision"), 6) as precision_macro,
    round(avg(recall), 6) as recall_macro from classes""",
)
def h5(t):
    return rounded(M.classification_scores(predictions(t)).select("balanced_accuracy", "precision_macro", "recall_macro"))


def _auc_sql(positive: str, score: str, where: str = "true") -> str:
    return f"""(select (sum(r) filter ({positive}) - count(*) filter ({positive}) * (count(*) filter ({positive}) + 1) / 2.0)
      / (count(*) filter ({positive}) * count(*) filter (not ({positive})))::double
      from (select *, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as r from predictions where {where}))"""


@query("h6_roc_auc", f"with {PREDICTIONS_SQL} select round({_auc_sql(chr(39).join(['label = ', 'F', '']), 'p_f')}, 6)::double as roc_auc")
def h6(t):
    return rounded(M.roc_auc(predictions(t), F.col("label") == "F", "p_f"))


def _mean(parts: list[str]) -> str:
    return "(" + " + ".join(parts) + f") / {len(parts)}"


@query(
    "h6_roc_auc_ovr",
    f"with {PREDICTIONS_SQL} select round({_mean([_auc_sql(f'label = {chr(39)}{k}{chr(39)}', s) for k, s in CLASS_SCORES.items()])}, 6)::double as roc_auc_ovr",
)
def h6_ovr(t):
    return rounded(M.roc_auc_ovr(predictions(t), "label", CLASS_SCORES))


_PAIRS = [(a, b) for a in CLASS_SCORES for b in CLASS_SCORES if a != b]


@query(
    "h6_roc_auc_ovo",
    f"with {PREDICTIONS_SQL} select round("
    + _mean([_auc_sql(f"label = '{a}'", CLASS_SCORES[a], f"label in ('{a}', '{b}')") for a, b in _PAIRS])
    + ", 6)::double as roc_auc_ovo",
)
def h6_ovo(t):
    return rounded(M.roc_auc_ovo(predictions(t), "label", CLASS_SCORES))


@query(
    "h7_log_loss",
    f"""with {PREDICTIONS_SQL} select round(avg(-ln(least(greatest(case label when 'F' then p_f when 'O' then p_o else p_p end, 1e-15::double),
    (1 - 1e-15::double)))), 6) as log_loss from predictions""",
)
def h7(t):
    return rounded(M.log_loss(predictions(t), "label", CLASS_SCORES))


def price_guess(t):
    return t.lineitem.select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500 + F.col("l_tax") * 10000).alias("prediction")
    )


@query(
    "h8_regression_scores",
    """with g as (select l_extendedprice as y, l_extendedprice - (l_quantity * 1500 + l_tax * 10000) as e from lineitem)
    select round(avg(e * e), 2) as mse, round(sqrt(avg(e * e)), 4) as rmse, round(avg(abs(e)), 4) as mae,
    round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) as r2, round(avg(abs(e) / abs(y)), 6) as mape, round(1 - var_pop(e) / var_pop(y), 6) as explained_variance from g""",
)
def h8(t):
    s = M.regression_scores(price_guess(t))
    digits = {"mse": 2, "rmse": 4, "mae": 4}
    return s.select(*[F.round(c, digits.get(c, 6)).alias(c) for c in s.columns])


@query(
    "h9_mase",
    f"""with {DAILY_SQL}, g as (select *, day >= date '2024-01-24' as test, 60.0 as p from daily),
    l as (select *, abs(y - lag(y, 7) over (partition by series, test order by day)) as d from g)
    select series, round(avg(abs(y - p)) filter (test) / avg(d) filter (not test), 6)::double as mase from l group by 1""",
)
def h9(t):
    guess = daily(t).withColumn("p", F.lit(60.0))
    is_test = F.col("day") >= F.lit("2024-01-24").cast("date")
    return rounded(M.mase(guess, "day", "y", "p", is_test, 7, "series"))


_RANK_SQL = """e as (select user_id, event_id, case event_type when 'purchase' then 3.0 when 'click' then 2.0 when 'view' then 1.0 else 0.0 end as rel, value as score from events),
  d as (select user_id, sum(rel / log2(r + 1)) as dcg from (select *, row_number() over (partition by user_id order by score desc, event_id) as r from e) where r <= 10 group by 1),
  i as (select user_id, sum(rel / log2(r + 1)) as ideal from (select *, row_number() over (partition by user_id order by rel desc, event_id) as r from e) where r <= 10 group by 1),
  n as (select user_id, case when ideal <> 0 then dcg / ideal else 0 end as ndcg from d join i using (user_id))"""


def ranked_events(t):
    kind = F.col("event_type")
    rel = F.when(kind == "purchase", 3.0).when(kind == "click", 2.0).when(kind == "view", 1.0).otherwise(0.0)
    return t.events.select("user_id", "event_id", rel.alias("rel"), F.col("value").alias("score"))


@query("h10_ndcg_at_k", f"with {_RANK_SQL} select user_id, round(ndcg, 6)::double as ndcg from n")
def h10(t):
    return rounded(M.ndcg_at_k(ranked_events(t), "user_id", "rel", "score", "event_id", 10))


@query("h10_mean_ndcg", f"with {_RANK_SQL} select round(avg(ndcg), 6)::double as mean_ndcg, count(*) as n_groups from n")
def h10_mean(t):
    return rounded(M.mean_ndcg(M.ndcg_at_k(ranked_events(t), "user_id", "rel", "score", "event_id", 10)))


@query("h11_anomaly_ratio", "select round(avg((value > 30)::int), 6) as anomaly_ratio from events")
def h11(t):
    return rounded(M.anomaly_ratio(t.events.select((F.col("value") > 30).cast("int").alias("Anomaly"))))


@query("h12_n_clusters", "select count(distinct label) as n_clusters from embeddings")
def h12(t):
    return M.n_clusters(t.embeddings, "label")


@query(
    "h13_mean_label_score",
    """with s as (select o_orderpriority as target, max(round(o_totalprice % 100) / 100) as v from orders group by 1)
    select 'best_model_score_' || replace(replace(lower(target), ' ', '_'), '-', '_') as metric, round(v, 6) as value from s
    union all select 'best_model_score_avg', round(avg(v), 6) from s""",
)
def h13(t):
    scores = t.orders.select(
        F.col("o_orderpriority").alias("target"), (F.round(F.col("o_totalprice") % 100) / 100).alias("best_score")
    )
    return rounded(M.mean_label_score(scores))
