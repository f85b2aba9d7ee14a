"""Adaptive parameter search: a Parzen sampler proposes settings, successive halving pays for them.

Many settings are judged on a small share of the rows, the best part of them on a larger share, and so on up to all
rows. Within a rung the sampler proposes settings in batches: it draws near good settings found so far and keeps those
that are likely among the good and unlikely among the bad ones. The driver holds settings and scores only; every
judgement is a cross-validation on the cluster, and the settings of a batch run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import seeded_hash
from tabloom.operators import models as M
from tabloom.operators.budget import Budget, OutOfTime

#: Range of the seeded hash.
HASHES = 1 << 28


@dataclass(frozen=True)
class Span:
    """Values of a parameter from `low` to `high`: evenly, by magnitude (`log`), whole numbers only (`whole`)."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def at(self, u: float):
        """Value at a place of [0, 1]."""
        if self.log:
            x = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            x = self.low + u * (self.high - self.low)
        return int(min(self.high, max(self.low, round(x)))) if self.whole else x


@dataclass(frozen=True)
class Choice:
    """One of a few values."""

    values: tuple

    def at(self, u: float):
        return self.values[min(len(self.values) - 1, int(u * len(self.values)))]


Space = dict[str, Span | Choice]

SPACES: dict[str, Space] = {
    "lr": {"regParam": Span(1e-5, 10, log=True), "elasticNetParam": Span(0, 1)},
    "nb": {},
    "rf": {"numTrees": Span(5, 60, whole=True), "maxDepth": Span(2, 10, whole=True), "minInstancesPerNode": Span(1, 50, log=True, whole=True)},
    "gbt": {"maxIter": Span(3, 30, whole=True), "maxDepth": Span(2, 7, whole=True), "stepSize": Span(0.02, 0.5, log=True)},
}


class ParzenSampler:
    """Draws places of the unit cube, at first at random, then where good ones lie denser than bad ones."""

    def __init__(self, width: int, seed: int = M.SEED, start: int = 8, share: float = 0.15, tries: int = 16):
        self.width, self.start, self.share, self.tries = width, start, share, tries
        self.draw = np.random.default_rng(seed)
        self.places: list[np.ndarray] = []
        self.losses: list[float] = []

    def tell(self, place: np.ndarray, loss: float) -> None:
        self.places.append(place)
        self.losses.append(loss if math.isfinite(loss) else math.inf)

    def ask(self) -> np.ndarray:
        if len(self.places) < self.start:
            return self.draw.random(self.width)
        order = np.argsort(self.losses, kind="stable")
        known = np.array(self.places)[order]
        cut = max(2, math.ceil(self.share * len(known)))
        good, bad = known[:cut], known[cut:]
        spread = max(0.04, 0.3 * len(known) ** (-1 / (1 + self.width)))
        near = good[self.draw.integers(len(good), size=self.tries)] + self.draw.normal(0, spread, (self.tries, self.width))
        near = np.where((near < 0) | (near > 1), self.draw.random(near.shape), near)
        gain = self._density(near, good, spread) - self._density(near, bad, spread)
        return near[int(np.argmax(gain))]

    def _density(self, at: np.ndarray, points: np.ndarray, spread: float) -> np.ndarray:
        """Logarithm of a product of kernel mixtures, each with a share of the even distribution."""
        if not len(points):
            return np.zeros(len(at))
        kernel = np.exp(-(((at[:, None, :] - points[None, :, :]) / spread) ** 2) / 2) / (spread * math.sqrt(2 * math.pi))
        return np.log(0.1 + 0.9 * kernel.mean(axis=1)).sum(axis=1)


def shares_of(width: int, eta: int, least: float) -> list[tuple[int, float]]:
    """Settings and share of rows of each rung, up to all rows; `eta` times fewer settings each time."""
    rungs = 1
    while width // eta**rungs >= 1 and least * eta**rungs <= 1:
        rungs += 1
    return [(max(1, width // eta**r), 1.0 if r == rungs - 1 else min(1.0, least * eta**r)) for r in range(rungs)]


def halving(
    judge: Callable[[list[dict], float], list[float]], space: Space, width: int = 27, eta: int = 3, least: float = 1 / 9,
    batch: int = 6, seed: int = M.SEED, adaptive: bool = True, first: list[dict] | None = None,
) -> list[dict]:
    """All judgements (rung, share, settings, loss); the last rung's smallest loss is the winner.

    `judge` gives a loss for each setting on a share of the rows; it may give fewer when time is up, which ends the
    search. `first` are settings to judge besides those drawn, and again on all rows.
    """
    names = list(space)
    sampler = ParzenSampler(len(names), seed, start=max(4, width // 3) if adaptive else width + 1)
    out: list[dict] = []

    def judged(settings: list[dict], rung: int, share: float) -> list[float]:
        losses = judge(settings, share)
        out.extend({"rung": rung, "share": share, "settings": s, "loss": x} for s, x in zip(settings, losses))
        return losses

    rungs = shares_of(width, eta, least)
    share = rungs[0][1]
    alive = list(zip(first or [], judged(first or [], 0, share))) if first else []
    while names and len(alive) < width:
        places = [sampler.ask() for _ in range(min(batch, width - len(alive)))]
        settings = [{n: space[n].at(u) for n, u in zip(names, p)} for p in places]
        losses = judged(settings, 0, share)
        for p, x in zip(places, losses):
            sampler.tell(p, x)
        alive += list(zip(settings, losses))
        if len(losses) < len(settings):
            return out
    for rung, (kept, share) in enumerate(rungs[1:], 1):
        best = [s for s, _ in sorted(alive, key=lambda a: a[1])[:kept]]
        if share >= 1:
            best += [s for s in first or [] if s not in best]
        losses = judged(best, rung, share)
        if len(losses) < len(best):
            return out
        alive = list(zip(best, losses))
    return out


def adaptive_search(
    encoded: DataFrame, key: str, family: str, maker: M.Candidate, task: str, metric: str | None = None, width: int = 27, eta: int = 3,
    least: float = 1 / 9, k: int = 3, seed: int = M.SEED, time_limit: float | None = None, space: Space | None = None,
) -> tuple[DataFrame, M.Candidate, dict]:
    """The board of all judgements, and the maker and settings of the winner.

    Rows of a share are those with a small seeded hash of their key, so larger shares hold smaller ones and no rung
    shuffles more than its share. The untuned model (empty settings) takes part from the start
    to the end, so it stays unless a setting beats it. With a limit in
    seconds, the winner is the best setting of the largest share that was judged.
    """
    metric = metric or M.DEFAULT_METRIC[task]
    sign, limit, number = (1 if metric in M.LOSSES else -1), Budget(time_limit), 0

    dealt: dict[float, DataFrame] = {}

    def rows_of(share: float) -> DataFrame:
        """The folds of a share, dealt once for all batches of a rung; those of the rung before are released."""
        if share not in dealt:
            release()
            rows = encoded if share >= 1 else encoded.where(seeded_hash(F.col(key), seed) < int(share * HASHES))
            dealt[share] = M.fold_table(rows, key, task, k, seed)
        return dealt[share]

    def release() -> None:
        for folds in dealt.values():
            folds.unpersist()
        dealt.clear()

    def judge(settings: list[dict], share: float) -> list[float]:
        if not settings:
            return []
        makers = {str(i): M.tuned(maker, s) if s else maker for i, s in enumerate(settings)}
        try:
            oof = M.cross_validate(encoded, key, makers, task, k, seed, time_limit=limit.left(), folds=rows_of(share))
        except OutOfTime:
            return []
        found = {r["model"]: r[metric] for r in M.cv_leaderboard(oof, task, metric).collect()}  # one a setting
        losses = []
        for i in range(len(settings)):
            if str(i) not in found:
                break
            losses.append(math.inf if found[str(i)] is None else sign * found[str(i)])
        return losses

    try:
        judged = halving(judge, space or SPACES[family], width, eta, least, seed=seed, first=[{}])
    finally:
        release()
    if not judged:
        raise OutOfTime(f"nothing was judged within {time_limit} seconds")
    top = max(j["rung"] for j in judged)
    best = min((j for j in judged if j["rung"] == top), key=lambda j: j["loss"])["settings"]
    rows = [(j["rung"], j["share"], str(j["settings"]), sign * j["loss"]) for j in judged]
    board = encoded.sparkSession.createDataFrame(rows, f"rung int, share double, settings string, {metric} double")
    return board, (M.tuned(maker, best) if best else maker), best
