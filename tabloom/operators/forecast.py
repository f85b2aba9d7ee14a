"""Forecasts per series. A series holds at most one row per period, so its length is bounded by the time span.

Periods are `days` apart and count from the last one, not from row to row: a missing period (no row, or a null value)
shifts no season. Several rows of a series for one period are an error.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HORIZON = 12
SEASON = 12
FORECAST_SCHEMA = "series string, model string, step int, yhat double, mase double"


def _last(history: DataFrame) -> DataFrame:
    return history.groupBy("series").agg(F.max("t").alias("last_t"), F.max_by("y", "t").alias("last_y"))


def naive(history: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The last value, for every step; `history` has (series, t, y)."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return _last(history).select("series", "last_t", steps.alias("step"), F.col("last_y").alias("yhat"))


def seasonal_naive(history: DataFrame, horizon: int = HORIZON, season: int = SEASON, days: int = 1) -> DataFrame:
    """The latest value of the same place in the season; one row for each place is kept before the shuffle's sort."""
    present = history.where(F.col("y").isNotNull())
    last = history.groupBy(F.col("series").alias("_of")).agg(F.max("t").alias("_last"))
    dated = present.join(last, F.col("series").eqNullSafe(F.col("_of")))
    back = (F.date_diff("_last", "t") / days).cast("int")
    placed = dated.withColumns({"_back": back, "_place": F.pmod(back, F.lit(season))})
    newest = F.row_number().over(W.partitionBy("series", "_place").orderBy("_back"))
    recent = placed.withColumn("_nth", newest).where(F.col("_nth") == 1)
    first = F.lit(season) - F.col("_place")
    steps = F.when(first <= horizon, F.sequence(first, F.lit(horizon), F.lit(season)))
    return recent.select("series", F.explode(steps).alias("step"), F.col("y").alias("yhat"))


def with_date(forecast: DataFrame, history: DataFrame, days: int = 1) -> DataFrame:
    """Adds the date of every step to a forecast of a daily (or every `days` days) series."""
    last = history.groupBy("series").agg(F.max("t").alias("_last"))
    joined = forecast.join(last, "series")
    return joined.withColumn("t", F.date_add("_last", F.col("step") * days)).drop("_last")


def _smooth(y, h, m, alpha, beta, gamma):
    """Additive exponential smoothing; without beta no trend, without gamma no season."""
    level = y[:m].mean() if gamma is not None else y[0]
    trend = (y[m:2 * m].mean() - y[:m].mean()) / m if gamma is not None and beta is not None else (y[1] - y[0] if beta is not None else 0.0)
    season = list(y[:m] - level) if gamma is not None else [0.0] * m
    for i in range(m if gamma is not None else 1, len(y)):
        s = season[i % m] if gamma is not None else 0.0
        before = level
        level = alpha * (y[i] - s) + (1 - alpha) * (level + trend)
        if beta is not None:
            trend = beta * (level - before) + (1 - beta) * trend
        if gamma is not None:
            season[i % m] = gamma * (y[i] - level) + (1 - gamma) * s
    return np.array([level + trend * k + (season[(len(y) + k - 1) % m] if gamma is not None else 0.0) for k in range(1, h + 1)])


def _autoregress(y, h, p):
    """AR(p) with intercept by least squares, iterated forward."""
    rows = np.column_stack([np.ones(len(y) - p)] + [y[p - k - 1:len(y) - k - 1] for k in range(p)])
    coef = np.linalg.lstsq(rows, y[p:], rcond=None)[0]
    past = list(y)
    for _ in range(h):
        past.append(float(coef[0] + sum(coef[k + 1] * past[-k - 1] for k in range(p))))
    return np.array(past[len(y):])


def _choices(n: int, m: int) -> dict:
    """Candidate forecasters a history of n periods can carry."""
    grid = (0.2, 0.5, 0.8)
    out = {"naive": lambda y, h: np.repeat(y[-1], h)}
    if n >= m:
        out["snaive"] = lambda y, h: np.array([y[len(y) - m + k % m] for k in range(h)])
    for a in grid:
        out[f"ses({a})"] = lambda y, h, a=a: _smooth(y, h, m, a, None, None)
    if n >= 3:
        for a, b in itertools.product(grid, grid):
            out[f"holt({a},{b})"] = lambda y, h, a=a, b=b: _smooth(y, h, m, a, b, None)
    if n >= 2 * m:
        for a, b, g in itertools.product(grid, grid, grid):
            out[f"hw({a},{b},{g})"] = lambda y, h, a=a, b=b, g=g: _smooth(y, h, m, a, b, g)
    for p in (1, 2, 3):
        if n >= 3 * p + 2:
            out[f"ar({p})"] = lambda y, h, p=p: _autoregress(y, h, p)
    return out


def _on_grid(pdf: pd.DataFrame, season: int, days: int) -> np.ndarray:
    """Values of all periods from the first to the last row; a missing one takes the value a season earlier, or the one
    before it."""
    day = pd.to_datetime(pdf["t"])
    place = ((day - day.min()).dt.days // days).to_numpy()
    if len(np.unique(place)) < len(place):
        raise ValueError(f"series {pdf['series'].iloc[0]} has several rows for one period")
    y = np.full(place.max() + 1, np.nan)
    y[place] = pdf["y"].to_numpy(dtype=float)
    y = y[np.flatnonzero(~np.isnan(y))[0]:] if not np.isnan(y).all() else np.zeros(0)
    for i in np.flatnonzero(np.isnan(y)):
        y[i] = y[i - season] if i >= season else y[i - 1]
    return y


def forecast(history: DataFrame, horizon: int = HORIZON, season: int = SEASON, days: int = 1) -> DataFrame:
    """Best of naive, seasonal naive, exponential smoothing and AR per series.

    Each candidate is fitted without the last `horizon` points and judged by MASE on them; the winner is
    refitted on the whole series. A series without any value gives no rows.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = _on_grid(pdf, season, days)
        if not len(y):
            return pd.DataFrame({"series": [], "model": [], "step": [], "yhat": [], "mase": []})
        held = min(horizon, max(0, len(y) - 2))
        past, future = y[:len(y) - held], y[len(y) - held:]
        lag = season if len(past) > season else 1
        scale = np.abs(past[lag:] - past[:-lag]).mean() if len(past) > lag else np.nan
        best, best_error = "naive", np.inf
        for name, fn in _choices(len(past), season).items():
            error = np.abs(fn(past, held) - future).mean() if held else np.inf
            if error < best_error - 1e-12:
                best, best_error = name, error
        yhat = _choices(len(y), season)[best](y, horizon)
        mase = best_error / scale if held and scale and scale > 0 else np.nan
        return pd.DataFrame(
            {"series": pdf["series"].iloc[0], "model": best, "step": np.arange(1, horizon + 1), "yhat": yhat, "mase": mase}
        )

    return history.select("series", "t", "y").groupBy("series").applyInPandas(one, FORECAST_SCHEMA)
