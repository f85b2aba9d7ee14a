"""Column helpers: types, missing values, seeded pseudo-random order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def ref(name: str) -> Column:
    """Column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating point columns."""
    c = ref(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    c = ref(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def literal(value, data_type) -> Column:
    """Literal of any atomic type, written as text so no zone or precision is lost."""
    if value is None:
        return F.lit(None).cast(data_type)
    return F.lit(repr(value) if isinstance(value, float) else str(value)).cast(data_type)


def seeded_digest(key: Column, seed: int) -> Column:
    """Seven hex digits of md5(key|seed): a reproducible order, uniform over distinct keys."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 7)


def seeded_hash(key: Column, seed: int) -> Column:
    """The same 28 bits as a number."""
    return F.conv(seeded_digest(key, seed), 16, 10).cast("long")


def short_form(c: Column) -> Column:
    """The value itself when short, else its SHA-256: long texts are compared without being shuffled."""
    return F.when(F.length(c) > 64, F.sha2(c, 256)).otherwise(c)


def row_key(*names: str) -> Column:
    return F.concat_ws("|", *[ref(n).cast("string") for n in names])


def long_rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn one aggregate row into one row per struct, without a shuffle."""
    return df.select(F.inline(F.array(*structs)))
