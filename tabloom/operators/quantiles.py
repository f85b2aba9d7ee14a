"""Exact, linearly interpolated percentiles at any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import present
from tabloom.operators.ranks import order_statistics


def exact_percentiles(df: DataFrame, wanted: dict[str, list[float]], **tuning) -> dict[str, list[float | None]]:
    """Percentiles of several numeric columns, all together and at any size by `order_statistics`."""
    clean = df.select(*[present(df, c).cast("double").alias(c) for c in wanted])
    sizes = clean.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in wanted]).first()
    targets = {}
    for c, shares in wanted.items():
        for i, p in enumerate(shares):
            place = (sizes[c] - 1) * p
            if sizes[c]:
                targets[f"{c}#{i}#0"] = (c, math.floor(place) + 1)
                targets[f"{c}#{i}#1"] = (c, math.ceil(place) + 1)
    found = order_statistics(clean, targets, **tuning) if targets else {}
    out: dict[str, list[float | None]] = {}
    for c, shares in wanted.items():
        out[c] = []
        for i, p in enumerate(shares):
            if not sizes[c]:
                out[c].append(None)
                continue
            low, high = found[f"{c}#{i}#0"], found[f"{c}#{i}#1"]
            place = (sizes[c] - 1) * p
            out[c].append(low + (high - low) * (place - math.floor(place)))
    return out
