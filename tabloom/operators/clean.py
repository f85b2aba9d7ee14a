"""Row filters, imputation and column projections before training and scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import is_missing, numeric_columns, present, ref, string_columns
from tabloom.functions.text import text_length, word_count
from tabloom.operators.quantiles import exact_percentiles

Targets = str | list[str] | None


def target_list(target: Targets) -> list[str]:
    if target is None:
        return []
    return [target] if isinstance(target, str) else list(target)


def drop_null_target(df: DataFrame, target: Targets) -> DataFrame:
    """Rows with every target present; a target that is not a column is an error."""
    for c in target_list(target):
        if c not in df.columns:
            raise ValueError(f"target column '{c}' not found")
    out = df
    for c in target_list(target):
        out = out.where(~is_missing(df, c))
    return out


class Imputer:
    """Medians of the training table, applied to any table: numbers take the median, strings ''."""

    def __init__(self, medians: dict[str, float | None], strings: list[str]):
        self.medians = medians
        self.strings = strings

    @classmethod
    def fit(cls, train: DataFrame, target: Targets = None, approximate: bool = False) -> "Imputer":
        """Exact medians; `approximate` takes one scan with a quantile sketch instead."""
        skip = target_list(target)
        numbers = numeric_columns(train, skip)
        if not numbers:
            medians = {}
        elif approximate:
            row = train.agg(*[F.percentile_approx(present(train, c).cast("double"), 0.5).alias(c) for c in numbers])
            medians = row.first().asDict()
        else:
            medians = {c: v[0] for c, v in exact_percentiles(train, {c: [0.5] for c in numbers}).items()}
        return cls(medians, string_columns(train, skip))

    def transform(self, df: DataFrame, zero: bool = False) -> DataFrame:
        """Fill missing values; with `zero`, a column without any median falls back to 0."""
        filled: dict[str, Column] = {}
        for c, median in self.medians.items():
            if c in df.columns:
                choices = [present(df, c).cast("double"), F.lit(median).cast("double")]
                filled[c] = F.coalesce(*choices, F.lit(0.0)) if zero else F.coalesce(*choices)
        for c in self.strings:
            if c in df.columns:
                filled[c] = F.coalesce(ref(c), F.lit(""))
        return df.withColumns(filled) if filled else df


def impute_or_zero(df: DataFrame, names: list[str], train: DataFrame | None = None) -> DataFrame:
    """Median for numbers, 0 for columns that are entirely missing or not numeric."""
    source = df if train is None else train
    numbers = [c for c in names if isinstance(source.schema[c].dataType, T.NumericType)]
    imputer = Imputer({c: v[0] for c, v in exact_percentiles(source, {c: [0.5] for c in numbers}).items()}, [])
    out = imputer.transform(df, zero=True)
    rest = {c: F.lit(0.0) for c in names if c not in numbers}
    return out.withColumns(rest) if rest else out


def normalise_text_columns(df: DataFrame, names: list[str], target: Targets = None) -> DataFrame:
    """Chosen columns as strings without nulls, rows without a target removed."""
    clean = drop_null_target(df, target)
    return clean.withColumns({c: F.coalesce(ref(c).cast("string"), F.lit("")) for c in names})


def text_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Length and word count of every string column in place of the text itself."""
    names = string_columns(df, target_list(target))
    added = {}
    for c in names:
        added[f"{c}_length"] = text_length(ref(c))
        added[f"{c}_word_count"] = word_count(ref(c))
    return df.withColumns(added).drop(*names) if names else df


def numeric_coerce(df: DataFrame, names: list[str]) -> DataFrame:
    """Text to double, value by value; what does not parse is 0.0."""
    return df.withColumns({c: F.coalesce(ref(c).try_cast("double"), F.lit(0.0)) for c in names})


def drop_targets(df: DataFrame, target: Targets) -> DataFrame:
    """Without the target columns that are present."""
    return df.drop(*[c for c in target_list(target) if c in df.columns])


def union_train_valid(train: DataFrame, valid: DataFrame) -> DataFrame:
    return train.unionByName(valid, allowMissingColumns=True)


def per_label_subset(df: DataFrame, target: str, targets: list[str]) -> DataFrame:
    """The table for one of several targets: the other targets are dropped."""
    return df.drop(*[c for c in targets if c != target])


def format_epoch_millis(millis: Column) -> Column:
    """Epoch milliseconds as 'yyyy-MM-dd HH:mm:ss' in UTC, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(epoch + F.make_dt_interval(secs=(millis / 1000).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss")
