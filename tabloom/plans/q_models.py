"""Model search, ensembles, clustering, anomaly detection, forecasting, scoring and explanation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.columns import row_key
from tabloom.operators import explain, forecast, listwise, models, scoring, search
from tabloom.operators.clean import text_features
from tabloom.operators.encode import FeatureAssembly, vector_from_array
from tabloom.operators.ensembles import fit_ensemble
from tabloom.operators.isolation import IsolationForest
from tabloom.operators.pipelines import AssemblyStage
from tabloom.operators.tree_explain import explain_trees
from tabloom.plans import workflow
from tabloom.plans.derived import CLASS_SCORES, DAILY_SQL, PREDICTIONS_SQL, daily, predictions
from tabloom.plans.q_metrics import rounded
from tabloom.plans.q_split import LINE_KEY
from tabloom.plans.registry import query
from tabloom.session import scratch_path


def labelled_documents(t):
    """Labelled documents with lengths and word counts instead of text."""
    docs = t.documents.join(t.labels, "doc_id").drop("toxic")
    # Quality is read as a class name, so that labels are numbered and decoded.
    named = docs.withColumn("quality", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    slim = text_features(named.select("doc_id", "text", "n_chars", "quality"), "quality")
    return slim.join(docs.select("doc_id", "lang", "source"), "doc_id")


def priced_lines(t):
    names = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"]
    return t.lineitem.select(row_key(*LINE_KEY).alias("id"), *names)


def prepared_lines(t):
    return models.prepare(priced_lines(t), "l_extendedprice", "regression", "id")


@query("g1_fit_classifiers")
def g1(t):
    return rounded(workflow.holdout_scores(labelled_documents(t), "quality", "doc_id", "classification"), 4)


def three_speeds(t):
    """Orders with one of three classes that follow from their priority."""
    p = F.col("o_orderpriority")
    kind = F.when(p < "2", "rush").when(p < "4", "usual").otherwise("calm")
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", kind.alias("kind"))


_SPEEDS_SQL = """select o_orderkey, case when o_orderpriority < '2' then 'rush' when o_orderpriority < '4' then 'usual' else 'calm' end
    as "Predictions" from orders"""


@query("g1_softmax_boosting", _SPEEDS_SQL)
def g1_softmax(t):
    table = three_speeds(t)
    return models.train(table, "kind", "o_orderkey", "softmax").predict(table).select("o_orderkey", "Predictions")


@query("g1_extra_trees", _SPEEDS_SQL)
def g1_extra(t):
    table = three_speeds(t)
    return models.train(table, "kind", "o_orderkey", "et").predict(table).select("o_orderkey", "Predictions")


@query("g2_fit_regressors")
def g2(t):
    return rounded(workflow.holdout_scores(priced_lines(t), "l_extendedprice", "id", "regression"), 4)


@query("g3_cross_validate")
def g3(t):
    task, _, labels, encoded = models.prepare(labelled_documents(t), "quality", "classification", "doc_id")
    oof = models.cross_validate(encoded, "doc_id", models.candidates_for(task, labels), task)
    return rounded(models.group_scores(oof, ["model", "fold"], task), 4)


@query("g4_compare_models")
def g4(t):
    return rounded(workflow.rank_candidates(priced_lines(t), "l_extendedprice", "id", "regression"), 4)


@query("g5_random_search")
def g5(t):
    _, _, _, encoded = prepared_lines(t)
    maker = models.regressors(["lr"])["lr"]
    board, _, _ = models.random_search(encoded.cache(), "id", "lr", maker, "regression")
    return rounded(board, 4)


@query("g5_adaptive_search")
def g5_adaptive(t):
    _, _, _, encoded = prepared_lines(t)
    maker = models.regressors(["lr"])["lr"]
    board, _, _ = search.adaptive_search(encoded.cache(), "id", "lr", maker, "regression", "rmse", width=9)
    return rounded(board, 4)


@query("g6_topology_search")
def g6(t):
    _, _, _, encoded = prepared_lines(t)
    return rounded(models.topology_search(encoded.cache(), "id", "regression"), 4)


_VOTES_SQL = f"""{PREDICTIONS_SQL}, votes as (select o_orderkey, p_f, p_o, p_p from predictions union all select o_orderkey, p_o, p_p, p_f from predictions),
    m as (select o_orderkey, avg(p_f) as a, avg(p_o) as b, avg(p_p) as c from votes group by 1)"""


@query(
    "g7_blend",
    f"with {_VOTES_SQL} select o_orderkey, case when a = greatest(a, b, c) then 0.0 when b = greatest(a, b, c) then 1.0 else 2.0 end::double as prediction, round(greatest(a, b, c), 6) as top from m",
)
def g7(t):
    p = predictions(t)
    one = p.select("o_orderkey", F.array("p_f", "p_o", "p_p").alias("proba"))
    two = p.select("o_orderkey", F.array("p_o", "p_p", "p_f").alias("proba"))
    votes = models.blend(one.unionByName(two), "o_orderkey", 3)
    return votes.select("o_orderkey", "prediction", F.round(F.array_max("proba"), 6).alias("top"))


@query("g7_tune_and_blend")
def g7_tuned(t):
    return rounded(workflow.tune_and_blend(labelled_documents(t), "quality", "doc_id", "classification"), 4)


@query("g8_weighted_ensemble")
def g8(t):
    task, _, labels, encoded = models.prepare(labelled_documents(t), "quality", "classification", "doc_id")
    oof = models.cross_validate(encoded, "doc_id", models.candidates_for(task, labels), task)
    return rounded(models.weighted_ensemble(oof.cache(), "doc_id", task), 4)


def planted_parts(t):
    """Parts with a value that is a linear function of two columns."""
    y = 3 * F.col("p_size") + 0.5 * F.col("p_retailprice")
    return t.part.select("p_partkey", "p_brand", "p_size", "p_retailprice", y.alias("y"))


@query(
    "g8_ensemble_predict",
    "select p_partkey, p_brand, p_size, p_retailprice, round(3 * p_size + 0.5 * p_retailprice, 3) as predicted from part",
)
def g8_predict(t):
    table = planted_parts(t)
    ensemble = fit_ensemble(table, "y", "p_partkey", "regression", layers=2, include=["lr", "rf"])
    return ensemble.predict(table).withColumn("predicted", F.round("Predictions", 3)).drop("Predictions")


def urgent_orders(t):
    """Orders with a class that follows from their priority."""
    rush = F.when(F.col("o_orderpriority") < "3", "rush").otherwise("calm")
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus", rush.alias("kind"))


_URGENT_SQL = """select o_orderkey, case when o_orderpriority < '3' then 'rush' else 'calm' end as "Predictions" from orders"""


@query("g7_blend_predict", _URGENT_SQL)
def g7_predict(t):
    table = urgent_orders(t)
    blend = fit_ensemble(table, "kind", "o_orderkey", "classification", weights="equal", include=["lr", "rf", "gbt"])
    return blend.predict(table).select("o_orderkey", "Predictions")


# Rule-made out-of-fold scores of three models that rotate the class scores.
_OOF_SQL = f"""{PREDICTIONS_SQL}, oof as (select o_orderkey, o_orderkey % 3 as fold, case label when 'F' then 0 when 'O' then 1 else 2 end as label,
    (p_f + 0.01) / (p_f + p_o + p_p + 0.03) as f, (p_o + 0.01) / (p_f + p_o + p_p + 0.03) as o, (p_p + 0.01) / (p_f + p_o + p_p + 0.03) as p
    from predictions)"""


def rule_made_scores(t):
    """Out-of-fold table (model, fold, o_orderkey, label, prediction, proba) without any model."""
    total = F.col("p_f") + F.col("p_o") + F.col("p_p") + 0.03
    base = predictions(t).select(
        "o_orderkey",
        (F.col("o_orderkey") % 3).cast("int").alias("fold"),
        F.when(F.col("label") == "F", 0.0).when(F.col("label") == "O", 1.0).otherwise(2.0).alias("label"),
        *[((F.col(c) + 0.01) / total).alias(c) for c in CLASS_SCORES.values()],
    )
    turns = {"a": ("p_f", "p_o", "p_p"), "b": ("p_o", "p_p", "p_f"), "c": ("p_p", "p_f", "p_o")}
    rows = [F.struct(F.lit(m).alias("model"), F.array(*columns).alias("proba")) for m, columns in turns.items()]
    oof = base.select("fold", "o_orderkey", "label", F.inline(F.array(*rows)))
    best = F.array_position("proba", F.array_max("proba")) - 1
    return oof.withColumn("prediction", best.cast("double"))


def _greedy_sql(rounds: int) -> str:
    """The greedy selection written out round by round."""
    own = """own as materialized (select case label when 0 then f when 1 then o else p end as a, case label when 0 then o when 1 then p else f end as b,
    case label when 0 then p when 1 then f else o end as c from oof), n0 as (select 0 as na, 0 as nb, 0 as nc, 0.0::double as loss)"""
    step = """l{r} as materialized (select na, nb, nc, avg(-ln(greatest(((na + 1) * a + nb * b + nc * c) / {r}, 1e-15))) as la,
    avg(-ln(greatest((na * a + (nb + 1) * b + nc * c) / {r}, 1e-15))) as lb, avg(-ln(greatest((na * a + nb * b + (nc + 1) * c) / {r}, 1e-15))) as lc
    from own, n{q} group by 1, 2, 3),
    n{r} as materialized (select na + (la <= lb and la <= lc)::int as na, nb + (lb < la and lb <= lc)::int as nb, nc + (lc < la and lc < lb)::int as nc,
    least(la, lb, lc) as loss from l{r})"""
    steps = ", ".join(step.format(r=r, q=r - 1) for r in range(1, rounds + 1))
    return f"""with {_OOF_SQL}, {own}, {steps}
    select m as model, round(case m when 'a' then na when 'b' then nb else nc end / {rounds}.0, 4)::double as weight, round(loss, 4) as ensemble_loss
    from n{rounds}, (values ('a'), ('b'), ('c')) v(m)"""


@query("g8_greedy_weights", _greedy_sql(6))
def g8_weights(t):
    return rounded(models.weighted_ensemble(rule_made_scores(t), "o_orderkey", "classification", rounds=6), 4)


_LONG_SQL = f"""{_OOF_SQL}, long as (
    select fold, label, 'a' as model, f as p0, o as p1, p as p2 from oof union all select fold, label, 'b', o, p, f from oof
    union all select fold, label, 'c', p, f, o from oof)"""


@query(
    "g4_board_by_log_loss",
    f"""with {_LONG_SQL}, folds as (select model, fold, avg(-ln(greatest(case label when 0 then p0 when 1 then p1 else p2 end, 1e-15))) as x from long group by 1, 2),
    board as (select model, avg(x) as x, stddev_pop(x) as s from folds group by 1)
    select row_number() over (order by x, model) as rank, model, round(x, 6) as log_loss, round(s, 6) as std from board""",
)
def g4_log_loss(t):
    return rounded(models.cv_leaderboard(rule_made_scores(t), "classification", "log_loss"), 6).select("rank", "model", "log_loss", "std")


@query(
    "g4_board_by_auc",
    f"""with {_LONG_SQL}, each as (select model, fold, label, c, case c when 0 then p0 when 1 then p1 else p2 end as s from long, range(0, 3) r(c)),
    ranked as (select model, fold, c, label = c as pos, rank() over w + (count(*) over (partition by model, fold, c, s) - 1) / 2.0 as place
               from each window w as (partition by model, fold, c order by s)),
    areas as (select model, fold, c, (sum(place) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0)
              / (count(*) filter (pos) * (count(*) filter (not pos))::double) as area from ranked group by 1, 2, 3),
    folds as (select model, fold, avg(area) as x from areas group by 1, 2),
    board as (select model, avg(x) as x, stddev_pop(x) as s from folds group by 1)
    select row_number() over (order by x desc, model) as rank, model, round(x, 6) as roc_auc, round(s, 6) as std from board""",
)
def g4_auc(t):
    return rounded(models.cv_leaderboard(rule_made_scores(t), "classification", "roc_auc"), 6).select("rank", "model", "roc_auc", "std")


def two_labels(t):
    docs = t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")
    return docs.withColumns({c: F.col(c).cast("string") for c in ("quality", "toxic")})


@query("g9_fit_multilabel")
def g9(t):
    _, scores = models.fit_multilabel(two_labels(t), ["quality", "toxic"], "doc_id", "rf")
    return rounded(scores, 4)


@query("g10_cluster")
def g10(t):
    vectors = vector_from_array(t.embeddings, "embedding")
    clusters = models.Clusters.fit(vectors, 4)
    return clusters.assign(vectors).select("vec_id", "Cluster")


@query("g11_isolation_forest")
def g11(t):
    x, key = F.array(F.col("value"), F.hour("ts").cast("double")), F.col("event_id")
    forest = IsolationForest.fit(t.events, x, key)
    return rounded(forest.assign(t.events, x).select("event_id", "value", "Anomaly_Score", "Anomaly"))


@query("g11_isolation_forest_embeddings")
def g11_embeddings(t):
    x = F.col("embedding").cast("array<double>")
    forest = IsolationForest.fit(t.embeddings, x, F.col("vec_id"))
    return rounded(forest.assign(t.embeddings, x).select("vec_id", "Anomaly_Score", "Anomaly"))


def _history(t):
    return daily(t).withColumnRenamed("day", "t")


@query(
    "g12_forecast_naive",
    f"""with {DAILY_SQL}, l as (select series, max(day) as d, arg_max(y, day) as y from daily group by 1)
    select series, s::int as step, y as yhat, (d + s::int)::date as t from l, range(1, 13) r(s)""",
)
def g12_naive(t):
    h = _history(t)
    return forecast.with_date(forecast.naive(h).drop("last_t"), h)


@query(
    "g12_forecast_seasonal_naive",
    f"""with {DAILY_SQL}, l as (select series, max(day) as d from daily group by 1),
    p as (select series, d, (d - day) % 7 as place, arg_max(y, day) as y from daily join l using (series) group by 1, 2, 3)
    select series, s::int as step, y as yhat, (d + s::int)::date as t from p join range(1, 13) r(s) on (7 - s % 7) % 7 = place""",
)
def g12_seasonal(t):
    h = _history(t)
    return forecast.with_date(forecast.seasonal_naive(h, 12, 7), h)


@query("g12_forecast")
def g12(t):
    return rounded(forecast.forecast(_history(t), 12, 7), 4)


def relevant_events(t):
    """Events with a relevance by their type, to be ranked for each user."""
    kind = F.col("event_type")
    rel = F.when(kind == "purchase", 3.0).when(kind == "click", 2.0).when(kind == "view", 1.0).otherwise(0.0)
    return t.events.select(
        "event_id", "user_id", "value", F.hour("ts").alias("hour"), F.get_json_object("props", "$.k").cast("double").alias("k"), rel.alias("rel")
    )


@query("g13_rank_model")
def g13(t):
    _, ranked = models.rank_model(relevant_events(t), "event_id", "user_id", "rel")
    return rounded(ranked)


@query("g13_rank_listwise")
def g13_listwise(t):
    table = relevant_events(t)
    model = listwise.fit_listwise(table, "event_id", "user_id", "rel", rounds=5)
    return rounded(model.score(table).select("event_id", "user_id", "rel", "score"))


@query("g16_fit_multimodal_table")
def g16(t):
    table = t.documents.join(t.labels, "doc_id").drop("toxic")
    named = table.withColumn("quality", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    model = models.fit_multimodal_table(named, "quality", "doc_id", "lr")
    return model.predict(named).select("doc_id", "Predictions")


def status_table(t):
    return t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey", "o_orderstatus")


@query("i1_predict_batch")
def i1(t):
    table = status_table(t)
    model = models.train(table, "o_orderstatus", "o_orderkey", "rf", "classification")
    return scoring.predict_batch(model, table).select("o_orderkey", "Predictions")


@query("i1_saved_model", _URGENT_SQL)
def i1_saved(t):
    """The model is written to the shared folder and the copy that is read again scores."""
    table, path = urgent_orders(t), scratch_path(t.spark, "model")
    models.train(table, "kind", "o_orderkey", "gbt", "classification").save(path)
    return models.TrainedModel.load(t.spark, path).predict(table).select("o_orderkey", "Predictions")


@query(
    "f7_saved_pipeline",
    """with x as (select *, (o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over () as price,
    dense_rank() over (order by o_orderpriority) - 1 as priority, dense_rank() over (order by o_orderstatus) - 1 as status from orders)
    select o_orderkey, round(price, 6) as price, priority::double as priority, status::double as status from x""",
)
def f7_saved(t):
    table, path = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), scratch_path(t.spark, "assembly")
    assembly = FeatureAssembly.fit(table, exclude=["o_orderkey"])
    PipelineModel([AssemblyStage(assembly)]).write().save(path)
    values = vector_to_array("features")
    names = [*assembly.numeric, *assembly.categorical]
    place = {c: F.get(values, F.lit(i)) for i, c in enumerate(names)}
    return PipelineModel.load(path).transform(table).select(
        "o_orderkey", F.round(place["o_totalprice"], 6).alias("price"), place["o_orderpriority"].alias("priority"), place["o_orderstatus"].alias("status")
    )


@query(
    "i2_decode_predictions",
    """with d as (select o_orderstatus as label, row_number() over (order by o_orderstatus) - 1 as idx from (select distinct o_orderstatus from orders))
    select o_orderkey, coalesce(label, (o_custkey % 7 - 1)::varchar) as "Predictions" from orders left join d on idx = o_custkey % 7 - 1""",
)
def i2(t):
    scored = t.orders.select("o_orderkey", (F.col("o_custkey") % 7 - 1).alias("Predictions"))
    return scoring.decode_predictions(scored, t.orders, "o_orderstatus")


@query("i3_predict_multi")
def i3(t):
    fitted, _ = models.fit_multilabel(two_labels(t), ["quality", "toxic"], "doc_id", "lr")
    docs = t.documents.select("doc_id", "lang", "source", "n_chars")
    return models.predict_multi(fitted, docs).select("doc_id", "Prediction_quality", "Prediction_toxic")


@query("i4_assign")
def i4(t):
    vectors = vector_from_array(t.embeddings, "embedding")
    clustered = models.Clusters.fit(vectors, 10).assign(vectors).select("vec_id", "Cluster")
    column = scoring.assigned_column("Clustering", clustered.columns)
    return clustered.groupBy(F.col(column).alias("Predictions")).agg(F.count("*").alias("n"))


_PAYLOAD_SCHEMA = "o_totalprice double, o_orderpriority string"
_PAYLOADS_SQL = """select o_orderkey, 0 as item, null::varchar as error, o_totalprice, o_orderpriority from orders where o_orderstatus <> 'F'
    union all select o_orderkey, 1, null, o_totalprice * 2, 'x' from orders where o_orderstatus = 'O'
    union all select o_orderkey, 0, 'invalid payload', null, null from orders where o_orderstatus = 'F'"""


def _payloads(orders):
    row = F.struct("o_totalprice", "o_orderpriority")
    double = F.struct((F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("x").alias("o_orderpriority"))
    status = F.col("o_orderstatus")
    payload = (
        F.when(status == "P", F.to_json(row)).when(status == "O", F.to_json(F.struct(F.array(row, double).alias("data")))).otherwise("not json {")
    )
    return orders.select("o_orderkey", payload.alias("payload"))


@query("i5_parse_payloads", _PAYLOADS_SQL)
def i5(t):
    return scoring.parse_payloads(_payloads(t.orders), _PAYLOAD_SCHEMA)


@query("i5_parse_payloads_stream", _PAYLOADS_SQL)
def i5_stream(t):
    from tabloom.streaming.sinks import run_append

    stream = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.folder}/orders.parque[t]")
    return run_append(scoring.parse_payloads(_payloads(stream), _PAYLOAD_SCHEMA), "payloads")


def _payload_model(t):
    table = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return models.train(table, "o_orderstatus", "o_orderkey", "rf", "classification")


@query("i5_score_payloads")
def i5_score(t):
    return scoring.score_payloads(_payload_model(t), _payloads(t.orders), _PAYLOAD_SCHEMA)


@query("i5_score_payloads_stream")
def i5_score_stream(t):
    from tabloom.streaming.sinks import run_append

    stream = t.spark.readStream.schema(t.orders.schema).parquet(f"{t.folder}/orders.parque[t]")
    return run_append(scoring.score_payloads(_payload_model(t), _payloads(stream), _PAYLOAD_SCHEMA), "scores")


def _explained(t):
    table = priced_lines(t).drop("l_linestatus")
    features = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    model = models.train(table, "l_extendedprice", "id", "lr", "regression")
    return explain.explain_rows(model, table, table, "id", features)


@query("i6_explain_rows")
def i6(t):
    return rounded(_explained(t), 2)


@query("i6_explain_global")
def i6_global(t):
    return rounded(explain.explain_global(_explained(t)), 2)


@query(
    "i6_explain_trees",
    """with x as (select l_orderkey || '|' || l_partkey || '|' || l_suppkey || '|' || l_linenumber as id,
        case when l_linenumber <= 3 then 10.0 else 20.0 end - avg(case when l_linenumber <= 3 then 10.0 else 20.0 end) over () as d from lineitem)
    select id, feature, round(case feature when 'l_linenumber' then d else 0.0 end, 6)::double as attribution
    from x, (values ('l_linenumber'), ('l_discount'), ('l_tax')) f(feature)""",
)
def i6_trees(t):
    """A step of one column, which boosting finds exactly: the other columns get nothing."""
    step = F.when(F.col("l_linenumber") <= 3, 10.0).otherwise(20.0)
    table = t.lineitem.select(row_key(*LINE_KEY).alias("id"), "l_linenumber", "l_discount", "l_tax", step.alias("y"))
    model = models.train(table, "y", "id", "gbt", "regression")
    found = explain_trees(model, table, "id").withColumn("attribution", F.round("attribution", 6) + 0.0)
    return found.drop("expected")


@query(
    "i7_top_class",
    f"""with {PREDICTIONS_SQL} select o_orderkey, case greatest(p_f, p_o, p_p) when p_f then 'F' when p_o then 'O' else 'P' end as top_label,
    greatest(p_f, p_o, p_p) as top_score from predictions""",
)
def i7(t):
    return scoring.top_class(predictions(t), CLASS_SCORES).select("o_orderkey", "top_label", "top_score")
