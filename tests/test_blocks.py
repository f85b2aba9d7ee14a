"""Trees grown over blocks against MLlib's and against brute force."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import blocks, models
from tabloom.plans import workflow


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=4000), rng.integers(0, 4, 4000), rng.uniform(size=4000)])
    y = 100 + 5 * (x[:, 0] > 0.3) + x[:, 1] ** 2 + rng.normal(size=4000)
    rows = [(i, float(t), Vectors.dense(r)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "label", "features"]).cache()


def mse(model, table):
    return model.transform(table).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]


def test_boosted_trees_are_those_of_mllib(table):
    estimator = GBTRegressor(maxIter=4, maxDepth=3, stepSize=0.3, seed=42)
    assert blocks.grows(estimator, table)
    ours, theirs = blocks.fit(estimator, table, 4000), estimator.fit(table)
    assert ours.getNumTrees == theirs.getNumTrees and ours.treeWeights == pytest.approx(theirs.treeWeights)
    a, b = (m.transform(table).orderBy("id").toPandas()["prediction"].to_numpy() for m in (ours, theirs))
    assert np.allclose(a, b, rtol=1e-9)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), rel=1e-6)


def test_nodes_try_some_features(table):
    model = blocks.fit(RandomForestRegressor(numTrees=30, maxDepth=1, featureSubsetStrategy="onethird", seed=3), table, 4000)
    tried = [int(t.featureImportances.toArray().argmax()) for t in model.trees]
    assert set(tried) == {0, 1, 2}  # the root of a tree has one feature of three


def test_one_tree_without_bagging_is_that_of_mllib(table):
    estimator = RandomForestRegressor(numTrees=1, bootstrap=False, maxDepth=5, minInstancesPerNode=20, seed=1)
    ours, theirs = blocks.fit(estimator, table, 4000), estimator.fit(table)
    a, b = (m.transform(table).orderBy("id").toPandas()["prediction"].to_numpy() for m in (ours, theirs))
    assert np.allclose(a, b, rtol=1e-9)


def test_forest_learns_as_well_and_is_saved(table, tmp_path):
    estimator = RandomForestRegressor(numTrees=20, maxDepth=5, featureSubsetStrategy="all", seed=42)
    ours, theirs = blocks.fit(estimator, table, 4000), estimator.fit(table)
    assert ours.getNumTrees == 20 and all(t.depth == 5 for t in ours.trees)
    assert mse(ours, table) == pytest.approx(mse(theirs, table), rel=0.02)
    assert len({t.toDebugString.split("\n", 1)[1] for t in ours.trees}) == 20  # bags differ
    ours.save(str(tmp_path / "forest"))
    again = RandomForestRegressionModel.load(str(tmp_path / "forest"))
    assert mse(again, table) == pytest.approx(mse(ours, table))


def test_blocks_and_jobs_of_a_level_do_not_change_the_trees(table, monkeypatch):
    estimator = GBTRegressor(maxIter=2, maxDepth=3, seed=42)
    whole = blocks.fit(estimator, table, 4000)
    monkeypatch.setattr(blocks, "BLOCK", 97)
    monkeypatch.setattr(blocks, "CELLS", 600)
    parted = blocks.fit(estimator, table, 4000)
    a, b = (m.transform(table).orderBy("id").toPandas()["prediction"].to_numpy() for m in (whole, parted))
    assert np.allclose(a, b, rtol=1e-9)


def test_pipelines_are_fitted_stage_by_stage(table):
    heads = RandomForestRegressor(featuresCol="_x", numTrees=1, bootstrap=False, seed=1), LinearRegression(featuresCol="_x")
    for head in heads:
        estimator = Pipeline(stages=[MinMaxScaler(inputCol="features", outputCol="_x"), head])
        assert mse(blocks.fit(estimator, table, 4000), table) == pytest.approx(mse(estimator.fit(table), table), rel=1e-9)


def test_a_constant_target_and_a_constant_feature_make_a_leaf(spark):
    rows = spark.range(50).select("id", F.lit(3.0).alias("label"), F.lit(1.0).alias("a"))
    encoded = models.FeatureAssembly.fit(rows, "label", exclude=["id"]).transform(rows)
    model = blocks.fit(GBTRegressor(maxIter=2, seed=42), encoded, 50)
    assert [r["prediction"] for r in model.transform(encoded).select("prediction").distinct().collect()] == [3.0]


def test_poisson_weights_and_cut_points():
    weights = blocks.poisson_weights(1.0)
    assert weights.mean() == pytest.approx(1, abs=1e-3) and weights.var() == pytest.approx(1, abs=1e-2)
    assert np.array_equal(blocks.cut_points(np.array([1.0, 1, 2, 4]), 32), [1.5, 3])
    assert len(blocks.cut_points(np.arange(1000.0), 32)) == 31


def test_missing_figures_are_an_error(spark):
    rows = spark.createDataFrame([(1.0, Vectors.dense([1.0])), (2.0, Vectors.dense([float("nan")]))], ["label", "features"])
    with pytest.raises(Exception, match="finite"):
        blocks.fit(GBTRegressor(maxIter=1), rows, 2)


def test_unknown_settings_stay_with_mllib(table):
    assert not blocks.grows(GBTRegressor(subsamplingRate=0.5), table)
    assert not blocks.grows(GBTRegressor(lossType="absolute"), table)
    assert not blocks.grows(RandomForestRegressor(featureSubsetStrategy="0.7"), table)
    assert not blocks.grows(LinearRegression(), table)


def kinds(monkeypatch):
    seen, fit = [], blocks.fit
    monkeypatch.setattr(models, "MANY_ROWS", 100)
    monkeypatch.setattr(blocks, "fit", lambda e, t, n, *more: seen.append((type(e).__name__, n)) or fit(e, t, n, *more))
    return seen


def test_large_tables_are_cross_validated_over_blocks(table, monkeypatch):
    makers = models.regressors(trees=5, depth=3, boosts=3)
    small = {r["model"]: r for r in models.cv_leaderboard(models.cross_validate(table, "id", makers, "regression"), "regression").collect()}
    seen = kinds(monkeypatch)
    large = {r["model"]: r for r in models.cv_leaderboard(models.cross_validate(table, "id", makers, "regression"), "regression").collect()}
    assert len(seen) == 9 and {n for _, n in seen} == {2666}
    assert {r["count"] for r in models.fold_table(table, "id", "regression").groupBy("fold").count().collect()} == {1333, 1334}
    for name in makers:
        assert large[name]["r2"] == pytest.approx(small[name]["r2"], abs={"lr": 1e-6, "gbt": 0.01, "rf": 0.05}[name])


def test_large_tables_are_searched_and_held_out_over_blocks(spark, table, monkeypatch):
    seen = kinds(monkeypatch)
    board = {r["model"]: r["r2"] for r in models.topology_search(table, "id", "regression").collect()}
    assert set(board) == {"minmax>linear", "minmax>forest", "pca>linear", "pca>forest"} and board["minmax>forest"] > 0.8
    assert sum(kind == "RandomForestRegressor" for kind, _ in seen) == 6 and sum(kind == "Pipeline" for kind, _ in seen) == 12
    flat = table.select("id", "label", *[F.get(models.vector_to_array("features"), F.lit(i)).alias(f"x{i}") for i in range(3)])
    del seen[:]
    scores = {r["model"]: r["r2"] for r in workflow.holdout_scores(flat, "label", "id", "regression", trees=5, depth=3, boosts=3).collect()}
    assert sorted(k for k, _ in seen) == ["GBTRegressor", "LinearRegression", "RandomForestRegressor"]
    assert scores["gbt"] > 0.7 and scores["rf"] > 0.6
