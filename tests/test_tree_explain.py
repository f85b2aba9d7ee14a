"""Tree attributions equal the enumeration of all feature subsets, and add up to the prediction."""

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models, tree_explain


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 12, size=(300, 4)).astype(float)
    y = x[:, 0] * (x[:, 1] > 5) + 3 * (x[:, 2] > 3) + rng.normal(0, 0.1, 300)
    rows = [(i, *map(float, r), float(t), "yes" if t > 4 else "no") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, t string").cache()


def plain(nodes, weights, row, class_index):
    """Shapley values from the definition: the expectation of every subset of known features, tree by tree."""
    trees = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n

    def expected(tree, node, known):
        if node["leftChild"] < 0:
            return node["prediction"] if class_index is None else node["impurityStats"][class_index] / sum(node["impurityStats"])
        left, right = tree[node["leftChild"]], tree[node["rightChild"]]
        f, cut = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        if f in known:
            return expected(tree, left if row[f] <= cut else right, known)
        return sum(expected(tree, s, known) * s["rawCount"] for s in (left, right)) / node["rawCount"]

    def game(known):
        return sum(weights[k] * expected(t, t[0], known) for k, t in trees.items())

    n, out = len(row), []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(
            factorial(k) * factorial(n - k - 1) / factorial(n) * (game({*s, i}) - game(set(s)))
            for k in range(n) for s in itertools.combinations(rest, k)
        ))
    return out, game(set())


@pytest.mark.parametrize("family,target", [("rf", "y"), ("gbt", "y"), ("rf", "t"), ("gbt", "t")])
def test_equals_enumeration(spark, table, family, target):
    data = table.drop("t" if target == "y" else "y")
    model = models.train(data, target, "id", family, trees=4, boosts=3, depth=4)
    got = {(r["id"], r["feature"]): (r["attribution"], r["expected"]) for r in tree_explain.explain_trees(model, data, "id").collect()}
    assert len(got) == 1200
    nodes = tree_explain.node_rows(spark, model.model)
    weights = tree_explain.tree_weights(model.model)
    names = tree_explain.feature_names(model)
    by_class = 1 if (family, target) == ("rf", "t") else None
    encoded = {r["id"]: r["features"].toArray() for r in model.assembly.transform(data).select("id", "features").collect()}
    for i in (0, 50, 111, 299):
        want, base = plain(nodes, weights, encoded[i], by_class)
        assert [got[i, n][0] for n in names] == pytest.approx(want, abs=1e-9) and got[i, "a"][1] == pytest.approx(base)
    scored = model.score(data)
    if target == "y":
        out = F.col("prediction")
    elif family == "rf":
        out = models.class_probabilities(scored)[1]
    else:
        out = F.element_at(models.vector_to_array("rawPrediction"), 2)
    for r in scored.select("id", out.alias("p")).collect():
        total = sum(got[r["id"], n][0] for n in names) + got[r["id"], "a"][1]
        assert total == pytest.approx(r["p"], abs=1e-9)


def test_nulls_unseen_values_and_text(spark):
    rows = [(i, float(i % 9), "ab"[i % 2], f"{'good' if i % 3 else 'bad'} words number {i}", float(i % 3 > 0)) for i in range(200)]
    data = spark.createDataFrame(rows, "id long, x double, c string, words string, y double")
    model = models.train(data, "y", "id", "rf", trees=3)
    odd = spark.createDataFrame([(1, None, None, None), (2, float("nan"), "zz", "")], "id long, x double, c string, words string")
    got = tree_explain.explain_trees(model, odd, "id").collect()
    assert len(got) == 6 and all(np.isfinite(r["attribution"]) for r in got)
    assert tree_explain.explain_trees(model, odd.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        tree_explain.explain_trees(models.train(data, "y", "id", "lr"), data, "id")


def test_large_models_are_refused(table, monkeypatch):
    model = models.train(table.drop("t"), "y", "id", "rf", trees=2)
    monkeypatch.setattr(tree_explain, "MAX_NODES", 3)
    with pytest.raises(ValueError):
        tree_explain.explain_trees(model, table, "id")
