"""Ensembles, saved pipelines, time limits, class weights and validation tables."""

import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import budget, models
from tabloom.operators.ensembles import Ensemble, fit_ensemble
from tabloom.plans import workflow

FAST = {"trees": 8, "boosts": 4, "depth": 4, "max_iter": 20}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    data = [
        (i, float(a), float(b), "ABC"[i % 3], float(3 * a - 2 * b + (i % 3)), "xyz"[int(a > 0.3) + int(a > -0.4)])
        for i, (a, b) in enumerate(rng.normal(size=(300, 2)))
    ]
    return spark.createDataFrame(data, "id bigint, a double, b double, c string, y double, label string").cache()


def rows_of(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("layers", [1, 2])
def test_vote_of_classes_is_the_weighted_mean(mixed, layers):
    table = mixed.drop("y")
    include = ["lr", "nb", "rf", "gbt"] if layers == 1 else ["lr", "rf"]
    ensemble = fit_ensemble(table, "label", "id", layers=layers, include=include, **FAST)
    scored = ensemble.member_scores(table.drop("label")).collect()
    total = sum(ensemble.weights.values())
    for r in scored:
        mean = sum(np.array(r[n]) * w / total for n, w in ensemble.weights.items())
        assert np.allclose(mean, r["proba"]) and r["prediction"] == int(np.argmax(r["proba"]))
    names = sorted(r["label"] for r in table.select("label").distinct().collect())
    got = rows_of(ensemble.predict(table), "Predictions")
    assert got == {r["id"]: (names[int(r["prediction"])],) for r in scored}
    truth = rows_of(table, "label")
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.95
    assert ensemble.board.count() == len(include)


def test_vote_of_regressors_and_its_plan(mixed):
    table = mixed.drop("label")
    ensemble = fit_ensemble(table, "y", "id", **FAST)
    assert set(ensemble.weights) == {"lr"}  # exact for a linear target
    blend = fit_ensemble(table, "y", "id", weights="equal", n_select=3, **FAST)
    assert set(blend.weights.values()) == {1 / 3}
    scored = blend.member_scores(table)
    for r in scored.collect():
        assert r["prediction"] == pytest.approx(np.mean([r[n][0] for n in blend.weights]))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_saved_ensemble_predicts_the_same(spark, mixed, tmp_path):
    table = mixed.drop("y")
    ensemble = fit_ensemble(table, "label", "id", layers=2, include=["nb", "rf"], **FAST)
    ensemble.save(str(tmp_path / "e"))
    again = Ensemble.load(spark, str(tmp_path / "e"))
    assert rows_of(again.predict(table), "Predictions") == rows_of(ensemble.predict(table), "Predictions")
    assert list(again.weights.values()) == list(ensemble.weights.values())


@pytest.mark.parametrize("family,target", [("lr", "y"), ("gbt", "label"), ("nb", "label")])
def test_saved_model_predicts_the_same(spark, mixed, tmp_path, family, target):
    table = mixed.drop("y" if target == "label" else "label")
    model = models.train(table, target, "id", family, **FAST)
    for _ in range(2):  # the second time in place of the first
        model.save(str(tmp_path / "m"))
    again = models.TrainedModel.load(spark, str(tmp_path / "m"))
    assert rows_of(again.predict(table), "Predictions") == rows_of(model.predict(table), "Predictions")
    assert (again.target, again.task) == (model.target, model.task)
    odd = spark.createDataFrame([(1, None, 2.0, "never seen"), (2, 0.5, None, None)], "id bigint, a double, b double, c string")
    assert rows_of(again.predict(odd), "Predictions") == rows_of(model.predict(odd), "Predictions")


def test_model_is_loaded_by_another_process(spark, mixed, tmp_path):
    table = mixed.drop("y").coalesce(1)
    model = models.train(table, "label", "id", "rf", **FAST)
    model.save(str(tmp_path / "m"))
    table.write.parquet(str(tmp_path / "t"))
    code = f"""
from tabloom.session import local_session
from tabloom.operators.models import TrainedModel
spark = local_session(2, 2, "1g")
out = TrainedModel.load(spark, {str(tmp_path / "m")!r}).predict(spark.read.parquet({str(tmp_path / "t")!r}))
print("FOUND", sorted((r.id, r.Predictions) for r in out.collect()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, check=True)
    want = sorted((k, p) for k, (p,) in rows_of(model.predict(table), "Predictions").items())
    assert f"FOUND {want}" in done.stdout


# ---- time limits ------------------------------------------------------------------------------------------------


def _slow(spark, seconds):
    def wait(batches):
        time.sleep(seconds)
        yield from batches

    return lambda: spark.range(0, 1, 1, 1).mapInPandas(wait, "id long").count()


def test_limit_cancels_and_keeps_what_is_done(spark):
    jobs = {"quick": lambda: spark.range(10).count(), "slow": _slow(spark, 60), "later": _slow(spark, 60)}
    start = time.monotonic()
    assert budget.run_within(spark, jobs, 6) == {"quick": 10}
    assert time.monotonic() - start < 15
    with pytest.raises(budget.OutOfTime):
        budget.run_within(spark, {"slow": _slow(spark, 60)}, 1)
    assert spark.range(5).count() == 5  # later jobs run as ever


def test_errors_and_order_without_a_limit(spark):
    jobs = {n: (lambda n=n: n) for n in "cab"}
    assert list(budget.run_within(spark, jobs)) == ["c", "a", "b"] and budget.run_within(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        budget.run_within(spark, {"bad": lambda: 1 / 0, "good": lambda: 1})


def test_search_within_a_limit(mixed):
    _, _, _, encoded = models.prepare(mixed.drop("label"), "y", "regression", "id")

    class Stuck:
        def fit(self, df):
            return _slow(df.sparkSession, 90)()

    makers = {"lr": models.regressors(["lr"])["lr"], "stuck": lambda seed: Stuck()}
    start = time.monotonic()
    oof = models.cross_validate(encoded, "id", makers, "regression", time_limit=15)
    assert {r["model"] for r in oof.select("model").distinct().collect()} == {"lr"}
    assert time.monotonic() - start < 40
    with pytest.raises(budget.OutOfTime):
        models.cross_validate(encoded, "id", {"stuck": makers["stuck"]}, "regression", time_limit=1)


def test_label_shares_are_used(mixed, monkeypatch):
    seen = []
    real = models.cross_validate
    monkeypatch.setattr(models, "cross_validate", lambda *a, **o: seen.append(o["time_limit"]) or real(*a, **o))
    table = mixed.select("id", "a", "b", "label", F.when(F.col("b") > 0, "p").otherwise("q").alias("other"))
    models.fit_multilabel(table, ["label", "other"], "id", time_limit=200)
    assert seen == [100, 100]


# ---- tuning, metrics, weights, validation -----------------------------------------------------------------------


def test_tuned_blend_of_three_classes(mixed):
    table = mixed.drop("y")
    scores = workflow.tune_and_blend(table, "label", "id", n_iter=2, include=["gbt"], **FAST).collect()
    assert {r["model"] for r in scores} >= {"blend"} and all(r["accuracy"] > 0.8 for r in scores)
    blend = workflow.tuned_blend(table, "label", "id", n_iter=1, include=["gbt", "nb"], **FAST)
    truth, got = rows_of(table, "label"), rows_of(blend.predict(table), "Predictions")
    assert len(blend.weights) == 2 and np.mean([got[k] == truth[k] for k in truth]) > 0.85


def test_settings_reach_the_inner_estimator():
    maker = models.tuned(models.classifiers(3, ["gbt"])["gbt"], {"maxIter": 7, "maxDepth": 2})
    inner = maker(1).getClassifier()
    assert (inner.getMaxIter(), inner.getMaxDepth()) == (7, 2)
    assert models.draw_settings("nb", 5) == [] and len(models.draw_settings("gbt", 5)) == 5


@pytest.mark.parametrize("classes", [2, 3])
def test_boards_by_other_metrics(spark, classes):
    rng = np.random.default_rng(classes)
    rows = []
    for model in "ab":
        for i in range(200):
            p = rng.dirichlet(np.ones(classes)).round(2)
            label = int(np.argmax(p)) if model == "a" and i % 4 else int(rng.integers(classes))
            rows.append((model, i % 2, i, float(label), float(np.argmax(p)), p.tolist()))
    oof = spark.createDataFrame(rows, "model string, fold int, id long, label double, prediction double, proba array<double>")

    def plain(metric, part):
        y, pred = np.array([r[3] for r in part]), np.array([r[4] for r in part])
        p = np.array([r[5] for r in part])
        if metric == "balanced_accuracy":
            return np.mean([(pred[y == c] == c).mean() for c in set(y)])
        if metric == "log_loss":
            return np.mean([-np.log(max(q[int(c)], 1e-15)) for q, c in zip(p, y)])
        areas = []
        for c in [1] if classes == 2 else range(classes):
            pos, neg = p[y == c, c], p[y != c, c]
            areas.append(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
        return np.mean(areas)

    for metric in models.MORE_METRICS["classification"]:
        board = {r["model"]: r for r in models.cv_leaderboard(oof, "classification", metric).collect()}
        for m in "ab":
            folds = [plain(metric, [r for r in rows if r[:2] == (m, f)]) for f in (0, 1)]
            assert board[m][metric] == pytest.approx(np.mean(folds)) and board[m]["std"] == pytest.approx(np.std(folds))
        assert board["a"]["rank"] == 1
    with pytest.raises(ValueError):
        models.cv_leaderboard(oof, "classification", "mape")


def test_balanced_weights_find_the_rare_class(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(rng.normal(1.2 if i % 20 == 0 else 0, 1)), "rare" if i % 20 == 0 else "usual") for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, x double, t string")

    def recall(class_weight):
        got = rows_of(models.train(table, "t", "id", "lr", class_weight=class_weight).predict(table), "Predictions")
        return np.mean([got[i] == ("rare",) for i, _, t in rows if t == "rare"])

    assert recall(None) < 0.3 < 0.6 < recall("balanced")
    for family in ("nb", "rf", "gbt"):
        assert models.train(table, "t", "id", family, class_weight="balanced", **FAST).predict(table).count() == 2000
    with pytest.raises(ValueError):
        models.train(table, "t", "id", "lr", class_weight="heavy")


def test_choice_by_a_validation_table(spark):
    # Linear in the training table, a step function in the validation table.
    train = spark.range(300).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("double").alias("y"))
    valid = spark.range(300, 360).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("double").alias("y"))
    model, board = workflow.train_validated(train, valid, "y", "id", "regression", metric="rmse", **FAST)
    rows = board.collect()
    assert [r["model"] for r in rows][-1] == "lr" and rows[0]["rmse"] < 0.05
    got = rows_of(model.predict(valid), "Predictions")
    assert all((got[i][0] > 0.5) == (i % 20 > 9) for i in got), board.collect()
    late = train.withColumn("t", F.timestamp_seconds("id"))
    _, board = workflow.train_chronological(late, "t", "y", "id", task="regression", include=["lr"], refit=False)
    assert board.count() == 1


def test_unseen_class_of_the_validation_table_is_wrong(mixed):
    table = mixed.drop("y")
    valid = table.limit(30).withColumn("label", F.when(F.col("id") < 5, "unseen").otherwise(F.col("label")))
    _, board = workflow.train_validated(table, valid, "label", "id", include=["rf"], refit=False, **FAST)
    assert board.first()["accuracy"] <= 25 / 30
