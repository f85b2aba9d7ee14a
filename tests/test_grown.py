"""Extremely randomised trees and softmax boosting: splits against plain sums, planted rules, saved models."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabloom.operators import grown, models
from tabloom.operators.models import TrainedModel


def vectors(spark, x, y, weight=None):
    frame = pd.DataFrame({"id": range(len(x)), "x": [list(map(float, r)) for r in x], "label": np.asarray(y, dtype=float)})
    if weight is not None:
        frame["w"] = np.asarray(weight, dtype=float)
    df = spark.createDataFrame(frame).repartition(4, "id")
    return df.withColumn("features", array_to_vector(F.col("x").cast("array<double>"))).drop("x")


def plain_tree(rows, sums, mass, depth, ridge, least):
    """Greedy growth on bins, one node after the other; leaf values by row."""
    out = np.zeros(len(rows))

    def worth(at):
        return sums[at].sum() ** 2 / (mass[at].sum() + ridge)

    def split(at, level):
        best = None
        if level < depth and len(at) >= 2 * least:
            for f in range(rows.shape[1]):
                for b in np.unique(rows[at, f])[:-1]:
                    left, right = at[rows[at, f] <= b], at[rows[at, f] > b]
                    if min(len(left), len(right)) >= least:
                        gain = worth(left) + worth(right) - worth(at)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                            best = (gain, left, right)
        if best is None:
            out[at] = sums[at].sum() / (mass[at].sum() + ridge)
        else:
            split(best[1], level + 1)
            split(best[2], level + 1)

    split(np.arange(len(rows)), 0)
    return out


@pytest.mark.parametrize("depth,least", [(1, 1), (3, 5)])
def test_growth_equals_plain_greedy_splits(spark, depth, least):
    rng = np.random.default_rng(depth)
    rows = rng.integers(0, 9, (200, 4)).astype(np.uint8)
    sums, mass = rng.normal(size=200) + rows[:, 1], rng.random(200) + 0.1
    frame = spark.createDataFrame(
        [(r.tobytes(), [float(s)], [float(m)]) for r, s, m in zip(rows, sums, mass)], "bins binary, sums array<double>, masses array<double>"
    ).repartition(5)
    edges = [np.arange(9.0)] * 4
    (tree,) = grown.grow(frame, 1, depth, edges, 9, 1, True, 1.0, least, 4, 1, False)
    got = tree.value[tree.walk(rows, tree.cut), 0]
    assert got == pytest.approx(plain_tree(rows, sums, mass, depth, 1.0, least), abs=1e-9)


def test_one_job_or_many_a_level_give_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    df = vectors(spark, x, (x[:, 0] + x[:, 1] > 0).astype(int))
    whole = grown.ExtraTrees(numTrees=3, maxDepth=3).fit(df)
    monkeypatch.setattr(grown, "CELLS", 1)
    parts = grown.ExtraTrees(numTrees=3, maxDepth=3).fit(df)
    for a, b in zip(whole.trees, parts.trees):
        assert (a.feature == b.feature).all() and a.edge == pytest.approx(b.edge) and a.value == pytest.approx(b.value)


def test_extra_trees_draw_their_cuts_inside_the_node(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.random(400), rng.random(400) * 100], axis=1)
    df = vectors(spark, x, (x[:, 0] > 0.5).astype(int))
    model = grown.ExtraTrees(numTrees=30, maxDepth=1, tries=1).fit(df)
    for f, scale in ((0, 1.0), (1, 100.0)):
        cuts = [t.edge[0] for t in model.trees if t.feature[0] == f]
        assert cuts and all(0 < c < scale for c in cuts) and len(set(cuts)) > len(cuts) // 2


def test_planted_rule_of_three_classes_row_by_row(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 20, (600, 3))
    y = np.where(x[:, 0] < 7, 0, np.where(x[:, 1] < 12, 1, 2))
    df = vectors(spark, x, y)
    fresh = rng.integers(0, 20, (300, 3))
    want = np.where(fresh[:, 0] < 7, 0, np.where(fresh[:, 1] < 12, 1, 2))
    test = vectors(spark, fresh, want)
    for model in (grown.SoftmaxBoosting(maxIter=5, maxDepth=3).fit(df), grown.ExtraTrees(numTrees=30, maxDepth=8, tries=3).fit(df)):
        rows = model.transform(test).collect()
        assert all(sum(r["probability"]) == pytest.approx(1) for r in rows)
        wrong = sum(r["prediction"] != r["label"] for r in rows)
        assert wrong == 0 if model.kind == "softmax" else wrong <= 6


def test_regression_and_weights(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 10, (500, 2))
    df = vectors(spark, x, 1e6 + 5 * x[:, 0], np.ones(500))
    model = grown.ExtraTrees(task="regression", numTrees=30, maxDepth=6, tries=2).fit(df)
    error = model.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert error < 3  # targets run over 45
    # Rows without weight count for nothing.
    mixed = vectors(spark, np.concatenate([x, x]), np.r_[x[:, 0] > 4, x[:, 0] <= 4].astype(int), np.r_[np.ones(500), np.zeros(500)])
    for make in (grown.ExtraTrees(numTrees=5, tries=2), grown.SoftmaxBoosting(maxIter=3, maxDepth=4)):
        rows = make.setWeightCol("w").fit(mixed).transform(mixed.where("w > 0")).collect()
        assert all(r["prediction"] == r["label"] for r in rows)


def test_missing_values_constant_features_and_empty_tables(spark):
    x = [[1.0, 0.0], [float("nan"), 0.0], [3.0, 0.0], [4.0, 0.0]] * 10
    df = vectors(spark, x, [0, 0, 1, 1] * 10)
    nulls = df.unionByName(df.limit(2).withColumn("label", F.lit(None).cast("double")))
    nulls = nulls.unionByName(df.limit(2).withColumn("features", F.lit(None).cast(df.schema["features"].dataType)))
    model = grown.SoftmaxBoosting(maxIter=3, maxDepth=2).fit(nulls)
    assert all(r["prediction"] == r["label"] for r in model.transform(df).collect())
    assert [r["prediction"] for r in model.transform(nulls.where("features is null")).collect()] == [None, None]
    alone = grown.ExtraTrees(numTrees=2).fit(df.where("label = 0"))
    assert {r["prediction"] for r in alone.transform(df).collect()} == {0.0}
    assert model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        grown.ExtraTrees().fit(df.limit(0))


@pytest.mark.parametrize("family", ["et", "softmax"])
def test_families_train_save_and_load(spark, tmp_path, family):
    rows = [(i, float(i % 7), "abc"[(i % 7) // 3]) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, a double, kind string")
    model = models.train(df, "kind", "id", family, trees=15, boosts=3, depth=3)
    model.save(str(tmp_path / "m"))
    again = TrainedModel.load(spark, str(tmp_path / "m"))
    for m in (model, again):
        got = {r["id"]: r["Predictions"] for r in m.predict(df.drop("kind")).collect()}
        assert got == {i: k for i, _, k in rows}


def test_families_join_boards_only_when_named(spark):
    assert not {"et", "softmax"} & set(models.classifiers(3))
    df = spark.createDataFrame([(i, float(i % 7), "abc"[(i % 7) // 3]) for i in range(150)], "id long, a double, kind string")
    task, _, labels, encoded = models.prepare(df, "kind", "classification", "id")
    makers = models.candidates_for(task, labels, ["lr", "et", "softmax"], class_weight=None, boosts=3, trees=5)
    oof = models.cross_validate(encoded, "id", makers, task, 2)
    board = {r["model"]: r for r in models.cv_leaderboard(oof, task, "log_loss").collect()}
    assert set(board) == {"lr", "et", "softmax"} and board["softmax"]["accuracy"] == 1.0


def test_columns_become_matrices_whole():
    """Batches cut out of larger ones keep their rows, and a batch goes to NumPy without objects for its rows."""
    numbers = np.arange(24, dtype=np.uint8).reshape(8, 3)
    assert (grown._matrix(grown._bytes(numbers)[2:7]) == numbers[2:7]).all()
    values = numbers / 7.0
    assert (grown._matrix(grown._lists(values)[3:]) == values[3:]).all()
    assert np.isnan(grown._matrix(pa.array([[1.0, None], [float("nan"), 2.0]], pa.list_(pa.float64())))).sum() == 2


def test_scores_of_rows_without_a_vector_stay_null_in_their_places(spark):
    tree = grown.Tree(1, 1)
    tree.feature[0], tree.edge[0], tree.value[1:] = 0, 0.5, [[-1.0], [1.0]]
    table = spark.range(0, 60, 1, 1).withColumn("features", F.when(F.col("id") % 3 > 0, array_to_vector(F.array((F.col("id") % 3 - 1).cast("double")))))
    got = grown.GrownModel([tree], "mean", [0.0], None).transform(table).select("id", "prediction").collect()
    assert [r["prediction"] for r in sorted(got)] == [None, -1.0, 1.0] * 20
