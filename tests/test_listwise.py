"""The listwise ranker: gradients against the plain sum over pairs, and planted data."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import listwise, metrics, models


def plain_gradients(rows, depth):
    groups = defaultdict(list)
    for key, group, label, score in rows:
        groups[group].append((key, label, score))
    out = {}
    for items in groups.values():
        items.sort(key=lambda r: (-r[2], r[0]))
        gains = [2.0**label - 1 for _, label, _ in items]
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gains, reverse=True)[:depth]))
        if not ideal:
            continue
        cut = [1 / math.log2(i + 2) if i < depth else 0.0 for i in range(len(items))]
        for i, (key, label, score) in enumerate(items):
            pull = bend = 0.0
            for j, (_, other, theirs) in enumerate(items):
                if label != other and (i < depth or j < depth):
                    side = 1 if label > other else -1
                    chance = 1 / (1 + math.exp(side * (score - theirs)))
                    worth = abs(gains[i] - gains[j]) * abs(cut[i] - cut[j]) / ideal
                    pull, bend = pull + side * chance * worth, bend + chance * (1 - chance) * worth
            out[key] = (pull, bend)
    return out


@pytest.mark.parametrize("depth", [1, 5, 100])
def test_gradients_equal_the_sum_over_pairs(spark, depth):
    rng = np.random.default_rng(depth)
    group = np.where(rng.random(300) < 0.4, 0, rng.integers(1, 20, 300))  # one group with a third of the rows
    rows = [(i, f"g{g}", float(rng.integers(0, 4)), float(round(rng.normal(), 1))) for i, g in enumerate(group)]
    rows += [(1000 + i, "flat", 0.0, 0.0) for i in range(5)]
    scored = spark.createDataFrame(rows, "_key long, _group string, label double, score double").repartition(4)
    got = {r["_key"]: (r["_pull"], r["_bend"]) for r in listwise.pair_gradients(scored, listwise.ideal_gains(scored, depth), depth).collect()}
    want = plain_gradients(rows, depth)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_rows_meet_their_list_once_and_in_batches(spark):
    """Text keys, far scores and batches that cut groups; the lists are joined once and no row's list is walked alone."""
    rng = np.random.default_rng(8)
    rows = [(f"k{i:03d}", f"g{rng.integers(0, 9)}", float(rng.integers(0, 3)), float(rng.integers(-300, 300))) for i in range(120)]
    scored = spark.createDataFrame(rows, "_key string, _group string, label double, score double").repartition(3)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pulls = listwise.pair_gradients(scored, listwise.ideal_gains(scored, 4), 4)
        plan = pulls._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("array_position") == 1
        got = {r["_key"]: (r["_pull"], r["_bend"]) for r in pulls.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = plain_gradients(rows, 4)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


@pytest.fixture(scope="module")
def planted(spark):
    """Inside a group relevance follows x; most of its spread is between groups and follows six features of theirs."""
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, size=(60, 6))
    rows = []
    for i in range(1800):
        g, x = i % 60, float(rng.normal())
        rows.append((i, g, x, float(rng.normal()), *map(float, bits[g]), float(2 * bits[g].sum() + (x > 0.5) + (x > 1.2))))
    names = ", ".join(f"b{k} double" for k in range(6))
    return spark.createDataFrame(rows, f"id long, q long, x double, noise double, {names}, rel double").cache()


def test_beats_the_pointwise_model(spark, planted, tmp_path):
    train, test = planted.where("q % 4 <> 0"), planted.where("q % 4 = 0")
    model = listwise.fit_listwise(train, "id", "q", "rel", rounds=2, depth=5, max_depth=3)
    point, _ = models.rank_model(train, "id", "q", "rel", boosts=2, depth=3)

    def ndcg(scored):
        return metrics.ndcg_at_k(scored, "q", "rel", "score", "id", 5).agg(F.avg("ndcg")).first()[0]

    listed = ndcg(model.score(test))
    assert listed > ndcg(point.score(test).withColumn("score", F.col("prediction"))) and listed > 0.95
    model.save(str(tmp_path / "r"))
    again = listwise.ListwiseModel.load(spark, str(tmp_path / "r"))
    assert {tuple(r) for r in again.score(test).collect()} == {tuple(r) for r in model.score(test).collect()}


def test_nothing_to_learn(spark):
    rows = [(i, i % 3, float(i), 1.0) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, q long, x double, rel double")
    scored = listwise.fit_listwise(df, "id", "q", "rel").score(df).collect()
    assert {r["score"] for r in scored} == {0.0}
