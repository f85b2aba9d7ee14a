"""Adaptive search on planted surfaces and on a planted table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import models, search

SPACE = {"a": search.Span(0, 1), "b": search.Span(1e-4, 1e2, log=True), "c": search.Choice(("x", "y", "z"))}


def surface(noise_seed):
    draw = np.random.default_rng(noise_seed)

    def judge(settings, share):
        def loss(s):
            far = (s["a"] - 0.73) ** 2 + ((math.log10(s["b"]) + 1.5) / 6) ** 2 + 0.3 * (s["c"] != "y")
            return far + float(draw.normal(0, 0.01 / math.sqrt(share)))

        return [loss(s) for s in settings]

    return judge


def exact(s):
    return (s["a"] - 0.73) ** 2 + ((math.log10(s["b"]) + 1.5) / 6) ** 2 + 0.3 * (s["c"] != "y")


def test_beats_random_draws_at_equal_cost():
    adaptive, random_draws = [], []
    for seed in range(20):
        judged = search.halving(surface(seed), SPACE, width=27, seed=seed)
        cost = sum(j["share"] for j in judged)
        top = [j for j in judged if j["share"] == 1]
        adaptive.append(exact(min(top, key=lambda j: j["loss"])["settings"]))
        draw = np.random.default_rng(1000 + seed)
        tries = [{n: s.at(draw.random()) for n, s in SPACE.items()} for _ in range(math.ceil(cost))]
        losses = surface(seed)(tries, 1.0)
        random_draws.append(exact(tries[int(np.argmin(losses))]))
    assert np.mean(adaptive) < 0.5 * np.mean(random_draws)


def test_sampler_beats_random_on_the_same_rungs():
    def mean(adaptive):
        out = []
        for seed in range(60):
            judged = search.halving(surface(seed), SPACE, width=40, least=1.0, batch=4, seed=seed, adaptive=adaptive)
            out.append(exact(min(judged, key=lambda j: j["loss"])["settings"]))
        return np.mean(out)

    assert mean(True) < 0.8 * mean(False)


def test_rungs_and_values():
    assert search.shares_of(27, 3, 1 / 9) == [(27, 1 / 9), (9, 1 / 3), (3, 1.0)]
    assert search.shares_of(1, 3, 1.0) == [(1, 1.0)] and search.shares_of(4, 2, 1.0) == [(4, 1.0)]
    assert search.Span(1, 9, whole=True).at(1.0) == 9 and search.Span(1e-2, 1e2, log=True).at(0.5) == pytest.approx(1.0)
    assert [search.Choice(("p", "q")).at(u) for u in (0.0, 0.49, 0.5, 1.0)] == ["p", "p", "q", "q"]


def test_search_ends_when_judgements_stop():
    calls = []

    def judge(settings, share):
        calls.append(len(settings))
        return [1.0] * (len(settings) if len(calls) < 3 else len(settings) - 1)

    judged = search.halving(judge, SPACE, width=27, batch=6)
    assert calls == [6, 6, 6] and len(judged) == 17


def test_finds_the_planted_regularisation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 40))
    y = x[:, 0] + rng.normal(0, 1.0, 120)  # the rest is noise: shrinkage helps
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    table = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{k} double" for k in range(40)) + ", y double")
    task, _, _, encoded = models.prepare(table, "y", "regression", "id")
    maker = models.regressors(["lr"])["lr"]
    board, winner, settings = search.adaptive_search(encoded.cache(), "id", "lr", maker, task, "rmse", width=9, least=1 / 3)
    rows = board.collect()
    assert {r["share"] for r in rows} == {1 / 3, 1.0} and len(rows) in (12, 13)
    top = [r for r in rows if r["share"] == 1.0]
    assert str(settings) == min(top, key=lambda r: r["rmse"])["settings"]
    assert settings and winner(1).getRegParam() == pytest.approx(settings["regParam"])
    scores = models.cv_leaderboard(models.cross_validate(encoded, "id", {"tuned": winner, "plain": maker}, task), task, "rmse").collect()
    assert scores[0]["model"] == "tuned"


def test_rows_of_a_share_are_dealt_once_and_released(spark, monkeypatch):
    """All batches of a rung meet one fold table, and no fold table outlives its rung."""
    table = spark.range(0, 240, 1, 2).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    _, _, _, encoded = models.prepare(table, "y", "regression", "id")
    dealt, deal = [], models.fold_table

    def watched(*args):
        assert not any(f.is_cached for f in dealt)
        dealt.append(deal(*args))
        return dealt[-1]

    monkeypatch.setattr(models, "fold_table", watched)
    maker = models.regressors(["lr"])["lr"]
    board, _, _ = search.adaptive_search(encoded, "id", "lr", maker, "regression", "rmse", width=7, least=1 / 3, k=2)
    assert board.count() >= 10 and len(dealt) == 2
    assert not any(f.is_cached for f in dealt)
