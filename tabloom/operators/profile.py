"""Dataset profile: sizes, missing values, distributions, correlations, duplicates, alerts.

All per-column figures come from one aggregate row that is unfolded into one row per column, so a
profile of any width is a single scan with map-side partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import is_missing, long_rows, numeric_columns, present, ref, short_form, string_columns
from tabloom.operators.quantiles import exact_percentiles
from tabloom.operators.ranks import dense_index, join_lookup, running_totals

HEALTH_ALERT_PCT = 5.0
#: Columns whose distinct values are counted exactly in one aggregate, which copies each row once a column.
EXACT_BATCH = 4


def _missing_counts(df: DataFrame) -> DataFrame:
    counts = [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    return df.agg(F.count("*").alias("n"), *counts)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row per column: name, type, missing count, plus the table's row and column count."""
    rows = [
        F.struct(
            F.lit(i).cast("long").alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"m{i}").alias("missing"),
            F.col("n").alias("n_rows"),
            F.lit(len(df.columns)).cast("long").alias("n_columns"),
        )
        for i, f in enumerate(df.schema)
    ]
    return long_rows(_missing_counts(df), rows)


def columns_per_type(df: DataFrame) -> DataFrame:
    """Columns and missing cells of each type."""
    return dataset_summary(df).groupBy("dtype").agg(F.count("*").alias("n_columns"), F.sum("missing").alias("missing"))


def missing_pct(df: DataFrame) -> DataFrame:
    """Share of missing values per column in percent, largest first."""
    rows = [
        F.struct(F.lit(c).alias("column"), F.try_divide(100.0 * F.col(f"m{i}"), F.col("n")).alias("missing_pct"))
        for i, c in enumerate(df.columns)
    ]
    return long_rows(_missing_counts(df), rows).orderBy(F.desc("missing_pct"), "column")


def missing_report(df: DataFrame) -> DataFrame:
    """Only the columns with missing values, rounded to two digits."""
    found = missing_pct(df).where(F.col("missing_pct") > 0)
    return found.select("column", F.round("missing_pct", 2).alias("missing_pct"))


def _distinct(df: DataFrame, name: str, rsd: float | None) -> Column:
    value = present(df, name)
    if isinstance(df.schema[name].dataType, T.StringType):
        value = short_form(value)
    return F.count_distinct(value) if rsd is None else F.approx_count_distinct(value, rsd)


def column_summary(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """Column, type, missing and distinct non-missing values; with `rsd` the distinct count is a sketch."""
    aggs = [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]
    aggs += [_distinct(df, c, rsd).alias(f"u{i}") for i, c in enumerate(df.columns)]
    rows = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"m{i}").alias("missing"),
            F.col(f"u{i}").alias("n_unique"),
        )
        for i, f in enumerate(df.schema)
    ]
    return long_rows(df.agg(*aggs), rows)


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of one row: text by its encoded length, other types by their fixed width."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(ref(f.name)), F.lit(0)).cast("long")
        elif isinstance(f.dataType, (T.ByteType, T.BooleanType)):
            total = total + 1
        elif isinstance(f.dataType, T.ShortType):
            total = total + 2
        elif isinstance(f.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            total = total + 4
        elif isinstance(f.dataType, T.ArrayType):
            total = total + F.coalesce(F.size(ref(f.name)), F.lit(0)).cast("long") * 8
        else:
            total = total + 8
    return total


def overview(df: DataFrame) -> DataFrame:
    """One row: size, mean missing share over columns, missing cells and the health alert."""
    names = df.columns
    counts = [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]
    one = df.agg(F.count("*").alias("n_rows"), F.sum(_row_bytes(df)).alias("bytes"), *counts)
    cells = F.lit(0).cast("long")
    for i in range(len(names)):
        cells = cells + F.col(f"m{i}")
    pct = F.try_divide(100.0 * cells, F.col("n_rows") * len(names))
    return one.select(
        "n_rows",
        F.lit(len(names)).cast("long").alias("n_columns"),
        pct.alias("mean_missing_pct"),
        cells.alias("missing_cells"),
        (F.col("bytes") / 1048576.0).alias("size_mb"),
        F.coalesce(pct > HEALTH_ALERT_PCT, F.lit(False)).cast("int").alias("health_alert"),
    )


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(ref(key)).limit(n)


def histogram(df: DataFrame, name: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; missing values are left out."""
    values = df.select(present(df, name).cast("double").alias("v")).where(F.col("v").isNotNull())
    flat = F.col("lo0") == F.col("hi0")
    edges = values.agg(F.min("v").alias("lo0"), F.max("v").alias("hi0")).select(
        F.struct(
            F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
            F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
        ).alias("edge")
    )
    edge = edges.scalar()
    placed = values.select("v", edge.alias("edge")).select(
        F.least(
            F.floor((F.col("v") - F.col("edge.lo")) / ((F.col("edge.hi") - F.col("edge.lo")) / bins)),
            F.lit(bins - 1).cast("long"),
        ).alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count("*").alias("n"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").alias("bin"), edge.alias("edge"))
    width = (F.col("edge.hi") - F.col("edge.lo")) / bins
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.col("edge.lo") + F.col("bin") * width).alias("lower"),
        (F.col("edge.lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def describe(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of the numeric columns."""
    names = names or numeric_columns(df)
    quartiles = exact_percentiles(df, {c: [0.25, 0.5, 0.75] for c in names})
    aggs = []
    for i, c in enumerate(names):
        v = present(df, c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
        aggs += [F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("n"),
            F.col(f"a{i}").alias("mean"),
            F.col(f"s{i}").alias("std"),
            F.col(f"l{i}").alias("min"),
            *[F.lit(q).cast("double").alias(p) for q, p in zip(quartiles[c], ("p25", "p50", "p75"))],
            F.col(f"h{i}").alias("max"),
        )
        for i, c in enumerate(names)
    ]
    return long_rows(df.agg(*aggs), rows)


def gram_sums(df: DataFrame, names: list[str], centres: list[float]) -> DataFrame:
    """Sums over the rows that have both columns of a pair (i <= j): n, x, y, xx, yy, xy around given centres.

    A task multiplies blocks of rows as matrices and hands on one row a pair; the work is that of one scan, whatever
    the number of columns, and no expression is repeated for each pair.
    """
    width = len(names)
    first, second = np.triu_indices(width)
    schema = "i int, j int, n double, x double, y double, xx double, yy double, xy double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - np.array(centres)
            here = ~np.isnan(values)
            values = np.where(here, values, 0.0)
            there = here.astype(np.float64)
            total += [there.T @ there, values.T @ there, (values * values).T @ there, values.T @ values]
        n, x, xx, xy = total
        columns = [n[first, second], x[first, second], x[second, first], xx[first, second], xx[second, first], xy[first, second]]
        indices = [pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*indices, *map(pa.array, columns)], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    numbers = df.select(*[present(df, c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    parts = numbers.mapInArrow(sums, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])


def correlation_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair, over the rows that have both: one scan for the means, around which no
    digits are lost, and one for the sums of all pairs."""
    names = names or numeric_columns(df)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, pearson double")
    means = df.agg(*[F.avg(present(df, c).cast("double")) for c in names]).first()
    sums = gram_sums(df, names, [m if m is not None and math.isfinite(m) else 0.0 for m in means]).where("i < j")
    n = F.col("n")
    spread = F.sqrt((n * F.col("xx") - F.col("x") * F.col("x")) * (n * F.col("yy") - F.col("y") * F.col("y")))
    pearson = F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), spread)
    labels = F.array(*[F.lit(c) for c in names])
    return sums.select(F.get(labels, F.col("i")).alias("column_a"), F.get(labels, F.col("j")).alias("column_b"), pearson.alias("pearson"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns with average ranks for ties.

    Rows are first counted per value pair; ranks come from counts per distinct value, so a value that
    holds a third of the rows is one row from there on.
    """
    pairs = (
        df.select(present(df, a).alias("x"), present(df, b).alias("y"))
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("x", "y")
        .agg(F.count("*").alias("w"))
    )

    def ranks(name: str) -> DataFrame:
        counts = pairs.groupBy(name).agg(F.sum("w").alias("c"))
        before = running_totals(counts, name, {"before": "c"})
        return before.select(name, (F.col("before") + (F.col("c") + 1) / 2.0).alias(f"r{name}"))

    total = pairs.agg(F.sum("w").alias("n")).scalar()
    ranked = join_lookup(join_lookup(pairs, ranks("x"), "x"), ranks("y"), "y").withColumn("n", total)
    dx, dy = (F.col(r) - (F.col("n") + 1) / 2.0 for r in ("rx", "ry"))
    sums = ranked.agg(
        F.sum(F.col("w") * dx * dy).alias("xy"),
        F.sum(F.col("w") * dx * dx).alias("xx"),
        F.sum(F.col("w") * dy * dy).alias("yy"),
    )
    return sums.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"),
    )


def value_frequencies(df: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The k most frequent values with their share of all rows."""
    counts = df.groupBy(ref(name).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)
    return top.select("value", "n", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))


def class_imbalance(df: DataFrame, name: str) -> DataFrame:
    """Number of classes and largest over smallest class."""
    counts = df.where(ref(name).isNotNull()).groupBy(ref(name).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.max("n").alias("largest"),
        F.min("n").alias("smallest"),
        F.try_divide(F.max("n"), F.min("n")).alias("imbalance_ratio"),
    )


def _content_key(df: DataFrame, names: list[str]) -> Column:
    """Digest of a row's content: short to shuffle, whatever the text length; null differs from ''."""
    parts = [F.coalesce(F.sha2(ref(c).cast("string"), 256), F.lit("null")) for c in names]
    return F.sha2(F.concat_ws("|", *parts), 256) if len(parts) > 1 else parts[0]


def duplicate_rows(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Groups of fully equal rows, rows in them, and rows beyond the first of each group."""
    groups = df.groupBy(_content_key(df, names or df.columns).alias("k")).agg(F.count("*").alias("n"))
    return groups.where(F.col("n") > 1).agg(
        F.count("*").alias("n_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"),
    )


def column_alerts(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """Flags per column: constant, unique, high cardinality (string, over half the rows), zeros, missing > 5 %."""
    numbers, strings = set(numeric_columns(df)), set(string_columns(df))
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count_if(is_missing(df, c)).alias(f"m{i}"), _distinct(df, c, rsd).alias(f"u{i}")]
        aggs.append((F.count_if(ref(c) == 0) if c in numbers else F.lit(0).cast("long")).alias(f"z{i}"))
    rows = []
    for i, c in enumerate(df.columns):
        n, m, u, z = F.col("n"), F.col(f"m{i}"), F.col(f"u{i}"), F.col(f"z{i}")
        high = (2 * u > n) if c in strings else F.lit(False)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                (u <= 1).cast("int").alias("is_constant"),
                ((u == n) & (n > 0)).cast("int").alias("is_unique"),
                high.cast("int").alias("high_cardinality"),
                (2 * z > n).cast("int").alias("many_zeros"),
                (100.0 * m > HEALTH_ALERT_PCT * n).cast("int").alias("missing_alert"),
            )
        )
    return long_rows(df.agg(*aggs), rows)


def target_cardinality(df: DataFrame, name: str) -> DataFrame:
    """Distinct non-missing target values; 2 when the column is absent."""
    if name not in df.columns:
        return df.sparkSession.range(1).select(F.lit(name).alias("target"), F.lit(2).cast("long").alias("n_unique"))
    return df.agg(F.count_distinct(present(df, name)).alias("n_unique")).select(F.lit(name).alias("target"), "n_unique")


def entry_defaults(df: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Form defaults: the exact median of numeric features, the sorted distinct values of string features.

    Options are one row each, so a column with a billion values stays distributed.
    """
    skip = exclude or []
    numbers, strings = numeric_columns(df, skip), string_columns(df, skip)
    medians = exact_percentiles(df, {c: [0.5] for c in numbers})
    first = F.lit(1).cast("long").alias("position")
    none = F.lit(None)
    parts = []
    if numbers:
        rows = [
            F.struct(F.lit(c).alias("feature"), first, F.lit(medians[c][0]).cast("double").alias("median"),
                     none.cast("string").alias("option"))
            for c in numbers
        ]
        parts.append(long_rows(df.sparkSession.range(1), rows))
    if strings:
        pairs = df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), ref(c).alias("option")) for c in strings]))
        )
        options = pairs.where(F.col("option").isNotNull()).distinct()
        ranked = dense_index(options, ["feature"], [F.col("option")], "position")
        parts.append(ranked.select("feature", "position", none.cast("double").alias("median"), "option"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_report(df: DataFrame, rsd: float | None = 0.02) -> DataFrame:
    """Missing, distinct, zeros, mean, deviation, range and text length of every column in a single scan.

    Without `rsd` distinct values are counted exactly, in one more scan for each `EXACT_BATCH` columns.
    """
    numbers, strings = set(numeric_columns(df)), set(string_columns(df))
    aggs = [F.count("*").alias("n")]
    distinct = [_distinct(df, c, rsd).alias(f"u{i}") for i, c in enumerate(df.columns)]
    if rsd is not None:
        aggs += distinct
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(is_missing(df, c)).alias(f"m{i}"))
        if c in numbers:
            v = present(df, c).cast("double")
            aggs += [F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"l{i}")]
            aggs += [F.max(v).alias(f"h{i}"), F.count_if(v == 0).alias(f"z{i}")]
        elif c in strings:
            aggs.append(F.avg(F.length(ref(c))).alias(f"a{i}"))
    one = df.agg(*aggs)
    if rsd is None:
        for at in range(0, len(distinct), EXACT_BATCH):
            one = one.crossJoin(df.agg(*distinct[at : at + EXACT_BATCH]))
    empty = F.lit(None).cast("double")
    rows = []
    for i, f in enumerate(df.schema):
        c = f.name
        num = c in numbers
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col("n").alias("n_rows"),
                F.col(f"m{i}").alias("missing"),
                F.col(f"u{i}").alias("n_unique"),
                (F.col(f"a{i}") if num else empty).alias("mean"),
                (F.col(f"s{i}") if num else empty).alias("std"),
                (F.col(f"l{i}") if num else empty).alias("min"),
                (F.col(f"h{i}") if num else empty).alias("max"),
                (F.col(f"z{i}") if num else F.lit(None).cast("long")).alias("zeros"),
                (F.col(f"a{i}") if c in strings else empty).alias("mean_length"),
            )
        )
    return long_rows(one, rows)
