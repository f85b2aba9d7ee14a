"""Planted structure is found again."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import explain, forecast, models, scoring
from tabloom.operators.encode import vector_from_array
from tabloom.operators.isolation import IsolationForest
from tabloom.plans import catalog


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    data = [
        (i, float(a), float(b), "ABC"[i % 3], float(3 * a - 2 * b + (i % 3)), "yes" if a + b > 0 else "no")
        for i, (a, b) in enumerate(rng.normal(size=(240, 2)))
    ]
    return spark.createDataFrame(data, "id bigint, a double, b double, c string, y double, label string").cache()


def test_classifier_learns_and_decodes(mixed):
    model = models.train(mixed.drop("y"), "label", "id", "lr", "classification")
    scored = model.predict(mixed.drop("y"))
    assert scored.columns == ["id", "a", "b", "c", "Predictions"]
    hits = scored.join(mixed.select("id", "label"), "id").where("Predictions = label").count()
    assert hits >= 230
    assert model.predict(mixed.drop("y", "label").limit(3)).count() == 3


def test_multiclass_boosting(mixed):
    table = mixed.select("id", "a", F.when(F.col("a") > 0.5, "x").when(F.col("a") > -0.5, "y").otherwise("z").alias("t"))
    task, _, labels, encoded = models.prepare(table, "t", None, "id")
    oof = models.cross_validate(encoded, "id", models.candidates_for(task, labels, ["gbt"], boosts=3), task)
    assert oof.select("id").distinct().count() == oof.count() == 240
    assert oof.where(F.size("proba") != 3).isEmpty()
    assert models.cv_leaderboard(oof, task).first()["accuracy"] > 0.9


def test_search_keeps_or_beats_the_base(mixed):
    task, _, labels, encoded = models.prepare(mixed.drop("label"), "y", "regression", "id")
    maker = models.regressors(["lr"])["lr"]
    board, winner, settings = models.random_search(encoded.cache(), "id", "lr", maker, task, n_iter=3)
    scores = {r["model"]: r["r2"] for r in board.collect()}
    assert len(scores) == 4 and scores[winner] == max(scores.values()) and (winner == "lr#0") == (settings == {})
    assert models.search_size(None) == models.search_size(300) == 10 and models.search_size(299) == 5
    with pytest.raises(ValueError):
        models.regressors(["nope"])


def test_ensemble_prefers_the_good_model(spark):
    good = spark.range(100).select(F.lit("good").alias("model"), "id", (F.col("id") % 2).cast("double").alias("label"))
    proba = F.when(F.col("label") == 1, F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.array(F.lit(0.9), F.lit(0.1)))
    good = good.withColumn("proba", proba)
    bad = good.withColumns({"model": F.lit("bad"), "proba": F.array(F.lit(0.5), F.lit(0.5))})
    got = {r["model"]: r["weight"] for r in models.weighted_ensemble(good.unionByName(bad), "id", "classification").collect()}
    assert got == {"good": 1.0, "bad": 0.0}


def test_planted_clusters(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal((i % 4) * 20, 1, 3)]) for i in range(200)]
    vectors = vector_from_array(spark.createDataFrame(data, "id bigint, e array<float>"), "e")
    clusters = models.Clusters.fit(vectors, 4)
    assigned = clusters.assign(vectors).select((F.col("id") % 4).alias("g"), "Cluster").distinct()
    assert assigned.count() == 4 and clusters.silhouette > 0.9


def test_planted_outliers(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(600, 2)))] + [(900 + i, 30.0 + i, -30.0 - i) for i in range(10)]
    df = spark.createDataFrame(data, "id bigint, x double, y double")
    features = F.array("x", "y")
    flagged = IsolationForest.fit(df, features, F.col("id")).assign(df, features, 0.05).where("Anomaly = 1").select("id").collect()
    ids = {r["id"] for r in flagged}
    assert set(range(900, 910)) <= ids and len(ids) == 31
    again = IsolationForest.fit(df.repartition(5), features, F.col("id")).assign(df, features, 0.05).where("Anomaly = 1")
    assert {r["id"] for r in again.select("id").collect()} == ids


def test_forecast_recovers_season(spark):
    start = datetime.date(2024, 1, 1)
    season = [10.0, 12, 14, 20, 9, 3, 1]
    data = [("s", start + datetime.timedelta(days=i), season[i % 7] + 0.5 * i) for i in range(70)]
    data += [("flat", start, 5.0), ("flat", start + datetime.timedelta(days=1), 5.0)]
    df = spark.createDataFrame(data, "series string, t date, y double")
    got = forecast.forecast(df, 7, 7).toPandas()
    s = got[got["series"] == "s"].sort_values("step")["yhat"].to_numpy()
    assert np.abs(s - [season[i % 7] + 0.5 * i for i in range(70, 77)]).max() < 1.0
    assert (got[got["series"] == "flat"]["yhat"] == 5.0).all()


def test_shapley_of_a_linear_model(mixed):
    table = mixed.select("id", "a", "b", "y")
    model = models.train(table, "y", "id", "lr", "regression")
    got = explain.explain_rows(model, table, table, "id", ["a", "b"], background_rows=240, rounds=240, max_rows=None)
    values = {(r["id"], r["feature"]): r["attribution"] for r in got.collect()}
    assert len(values) == 480
    pdf = table.toPandas().set_index("id")
    beta = dict(zip("ab", model.model.coefficients))
    scale = model.assembly.scaler.scale
    for i in (0, 17, 239):
        for f in "ab":
            want = beta[f] / scale[f] * (pdf.loc[i, f] - pdf[f].mean())
            assert values[i, f] == pytest.approx(want, abs=1e-6)


def test_linear_background_is_all_training_rows(mixed):
    table = mixed.select("id", "a", "b", "y")
    model = models.train(table, "y", "id", "lr", "regression")
    got = explain.explain_rows(model, table, table, "id", ["a", "b"])
    whole = explain.explain_rows(model, table, table, "id", ["a", "b"], background_rows=240)
    want = {(r["id"], r["feature"]): r["attribution"] for r in whole.collect()}
    found = {(r["id"], r["feature"]): r["attribution"] for r in got.collect()}
    assert len(found) == 480 and found == pytest.approx(want, abs=1e-6)


def test_registered_explanations_center_on_all_rows(spark, folder):
    table = catalog.QUERIES["i6_explain_rows"](spark, folder)
    means = {r["feature"]: (r["m"], r["n"]) for r in table.groupBy("feature").agg(F.avg("attribution").alias("m"), F.count("*").alias("n")).collect()}
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert len(means) == 4
    assert all(n == lines and abs(m) < 0.01 for m, n in means.values()), means


def test_rank_positions(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("q"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("rel"))
    _, ranked = models.rank_model(df, "id", "q", "rel", boosts=5, depth=4)
    top = ranked.where("position = 1").collect()
    assert len(top) == 3 and all(r["rel"] >= 8 for r in top)


def test_payloads(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 1, "b": 2}'), (2, '{"data": [{"a": 3}, {"a": 4}]}'), (3, "[1]"), (4, "oops"), (5, None), (6, '{"data": 7}'), (7, '{"data": []}')],
        "k int, payload string",
    )
    got = [tuple(r) for r in scoring.parse_payloads(df, "a double, b double").orderBy("k", "item").collect()]
    bad = "invalid payload"
    assert got == [
        (1, 0, None, 1.0, 2.0), (2, 0, None, 3.0, None), (2, 1, None, 4.0, None), (3, 0, bad, None, None),
        (4, 0, bad, None, None), (5, 0, bad, None, None), (6, 0, bad, None, None),
    ]


def test_forest_skips_missing_vectors(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=2)]) for i in range(200)]
    data += [(900, None), (901, [1.0, None]), (902, [float("nan"), 0.0]), (903, [])]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(3)
    got = {r["id"]: (r["Anomaly_Score"], r["Anomaly"]) for r in IsolationForest.fit(df, F.col("v"), F.col("id")).assign(df, F.col("v")).collect()}
    assert len(got) == 204 and {k for k, v in got.items() if v == (None, None)} == {900, 901, 902, 903}
    assert sum(v[1] or 0 for v in got.values()) == 10


def test_gaps_shift_no_season(spark):
    start = datetime.date(2024, 1, 1)
    days = [i for i in range(28) if i != 22]  # one day of the last season is missing
    rows = [("s", start + datetime.timedelta(days=i), float(i % 7)) for i in days] + [("s", start + datetime.timedelta(days=28), None)]
    df = spark.createDataFrame(rows, "series string, t date, y double").where("y is not null")
    want = [float((28 + k) % 7) for k in range(7)]
    naive = {r["step"]: r["yhat"] for r in forecast.seasonal_naive(df, 7, 7).collect()}
    assert [naive[s] for s in range(1, 8)] == want
    chosen = {r["step"]: r["yhat"] for r in forecast.forecast(df, 7, 7).collect()}
    assert [chosen[s] for s in range(1, 8)] == pytest.approx(want, abs=1e-6)
    with pytest.raises(Exception, match="several rows for one period"):
        forecast.forecast(df.union(df.limit(1)), 7, 7).collect()


def test_oversampling_in_blocks(spark, monkeypatch):
    from tabloom.operators import split

    monkeypatch.setattr(split, "COPIES", 3)
    df = spark.createDataFrame([(i, "a") for i in range(20)] + [(99, "b")], "id long, c string")
    copies = split.balance_classes(df, "c").groupBy("id").agg(F.collect_set("copy").alias("s")).collect()
    assert all(sorted(r["s"]) == (list(range(1, 21)) if r["id"] == 99 else [1]) for r in copies)


def test_small_tables_get_few_fold_partitions(spark):
    cores, usual = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        assert models.fold_partitions(spark.range(10)) == 2 * cores
        assert models.fold_partitions(spark.range(2_000_000)) == max(2 * cores, 400)
        assert models.fold_partitions(spark.range(900_000_000)) == 1800
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_a_fit_keeps_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    """A large table read in one part is dealt over tasks before a fit keeps its rows; a small one is left alone."""
    monkeypatch.setattr(models, "MOST_ROWS_A_TASK", 100)
    table = spark.range(0, 4000, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    _, _, _, encoded = models.prepare(table, "y", "regression", "id")
    dealt = models.fit_rows(encoded, "id", table.count())
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 40 and max(sizes) <= 200
    nameless = models.fit_rows(encoded.withColumn("id", F.lit(None).cast("long")), "id", 4000)
    assert nameless.count() == 4000
    assert models.fit_rows(encoded, "id", 100) is encoded
    asked = []
    deal = models.fit_rows
    monkeypatch.setattr(models, "fit_rows", lambda *a: asked.append(a[2]) or deal(*a))
    models.train(table, "y", "id", "gbt", "regression", boosts=1, depth=2)
    assert asked == [4000]


def test_a_table_with_text_is_kept_while_it_is_fitted(spark, monkeypatch):
    """The fit passes over it many times, and each pass would split the texts into terms again; it is released after."""
    words = ["good fine day out in the warm sun again", "poor cold rain falls on the grey town today"]
    rows = [(i, words[i % 2], float(i), "ab"[i % 2]) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, body string, x double, kind string")
    makers, kept = models.candidates_for, []

    class Watched:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, table):
            kept.append((table, table.is_cached))
            return self.estimator.fit(table)

    def watched(*args, **params):
        return {n: (lambda seed, m=m: Watched(m(seed))) for n, m in makers(*args, **params).items()}

    monkeypatch.setattr(models, "candidates_for", watched)
    model = models.fit_multimodal_table(df, "kind", "id")
    [(table, cached)] = kept
    assert cached and not table.storageLevel.useMemory
    assert model.assembly.text == ["body"]
    assert {r["id"]: r["Predictions"] for r in model.predict(df).collect()} == {r[0]: r[3] for r in rows}


def test_large_tables_are_fitted_one_at_a_time(spark, monkeypatch):
    assert [models.fits_at_once(n, 12, 8) for n in (0, 3_600_000, 12_000_000, 36_000_000, 216_000_000)] == [8, 8, 4, 1, 1]
    rows = [(i, float(i % 7), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    task, _, labels, encoded = models.prepare(df, "y", "regression", "id")
    sides, run = [], models.run_within

    def watched(spark, jobs, seconds, parallelism):
        sides.append(parallelism)
        return run(spark, jobs, seconds, parallelism)

    monkeypatch.setattr(models, "run_within", watched)
    makers = models.candidates_for(task, labels, ["lr"])
    usual = models.cross_validate(encoded, "id", makers, task)
    monkeypatch.setattr(models, "ROWS_A_CORE", 1)
    alone = models.cross_validate(encoded, "id", makers, task)
    assert sides == [8, 1]
    key = ["id", "fold", "prediction"]
    assert {tuple(r) for r in usual.select(key).collect()} == {tuple(r) for r in alone.select(key).collect()}
