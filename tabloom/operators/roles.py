"""Column roles and the kind of learning task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions.columns import long_rows, numeric_columns, present, ref, short_form, string_columns
from tabloom.functions.fixed import IMAGE_PATTERN

MAX_CLASSES = 20


def column_roles(
    df: DataFrame, target: str | None = None, text_columns: list[str] | None = None, rsd: float | None = None
) -> DataFrame:
    """numeric, categorical or text per feature; a string column is text when over half its rows are distinct.

    Given `text_columns` replace the test. `rsd` uses a distinct-count sketch instead of the exact count.
    """
    skip = [target] if target else []
    numbers, strings = numeric_columns(df, skip), string_columns(df, skip)
    numeric = [F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("role")) for c in numbers]
    if text_columns is not None:
        chosen = [
            F.struct(F.lit(c).alias("column"), F.lit("text" if c in text_columns else "categorical").alias("role"))
            for c in strings
        ]
        return long_rows(df.sparkSession.range(1), numeric + chosen)
    distinct = [
        (F.count_distinct(short_form(ref(c))) if rsd is None else F.approx_count_distinct(ref(c), rsd)).alias(f"u{i}")
        for i, c in enumerate(strings)
    ]
    tested = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(2 * F.col(f"u{i}") > F.col("n"), "text").otherwise("categorical").alias("role"),
        )
        for i, c in enumerate(strings)
    ]
    return long_rows(df.agg(F.count("*").alias("n"), *distinct), numeric + tested)


def infer_multimodal(df: DataFrame, key: str, target: str | None = None, sample_size: int | None = None) -> DataFrame:
    """image, text or other per column, from all non-null values in one aggregate.

    image: at least half of the values end in an image extension. text: a string column whose average length
    is 25 or more, or with more distinct values than max(20, half the rows). With `sample_size` shares and
    lengths come from that many first rows in key order instead; distinct counts still cover all rows.
    """
    names = [c for c in df.columns if c != target]
    strings = set(string_columns(df))
    looked = df if sample_size is None else df.orderBy(ref(key)).limit(sample_size)
    texts = {c: ref(c).cast("string") for c in names}
    looks = [F.avg(F.lower(v).rlike(IMAGE_PATTERN).cast("double")).alias(f"s{i}") for i, v in enumerate(texts.values())]
    looks += [F.avg(F.length(v)).alias(f"l{i}") for i, v in enumerate(texts.values())]
    counts = [F.count("*").alias("n")]
    counts += [F.count_distinct(short_form(ref(c))).alias(f"u{i}") for i, c in enumerate(names) if c in strings]
    if sample_size is None:
        one = df.agg(*counts, *looks)
    else:
        one = df.agg(*counts).withColumn("_look", looked.agg(F.struct(*looks)).scalar()).select("*", "_look.*")
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"s{i}").alias("image_share"),
            F.col(f"l{i}").alias("mean_length"),
            (F.col(f"u{i}") if c in strings else F.lit(0).cast("long")).alias("n_unique"),
            F.greatest(F.lit(20).cast("long"), F.floor(F.col("n") * 0.5)).alias("limit"),
            F.lit(c in strings).alias("is_string"),
        )
        for i, c in enumerate(names)
    ]
    joined = long_rows(one, rows)
    role = (
        F.when(F.col("image_share").isNull(), "other")
        .when(F.col("image_share") >= 0.5, "image")
        .when(F.col("is_string") & ((F.col("mean_length") >= 25) | (F.col("n_unique") > F.col("limit"))), "text")
        .otherwise("other")
    )
    return joined.select("column", role.alias("role"))


def detect_problem_type(df: DataFrame, target: str, rule: str = "integral") -> DataFrame:
    """classification or regression for one target, by one of three rules.

    integral: string, or numeric with at most 20 values that are all whole. few_values: string or at most
    20 values. factor: string or fewer than 20 values (the target is then cast to string).
    """
    is_number = isinstance(df.schema[target].dataType, T.NumericType)
    y = present(df, target)
    whole = F.coalesce(F.bool_and((y.cast("double") % 1) == 0), F.lit(True)) if is_number else F.lit(True)
    stats = df.agg(F.count_distinct(y).alias("n_unique"), whole.alias("whole"))
    if not is_number:
        few = F.lit(True)
    elif rule == "integral":
        few = (F.col("n_unique") <= MAX_CLASSES) & F.col("whole")
    elif rule == "few_values":
        few = F.col("n_unique") <= MAX_CLASSES
    elif rule == "factor":
        few = F.col("n_unique") < MAX_CLASSES
    else:
        raise ValueError(f"unknown rule {rule}")
    return stats.select(
        F.lit(target).alias("target"),
        F.lit(rule).alias("rule"),
        F.when(few, "classification").otherwise("regression").alias("problem_type"),
    )


def ordered_unique(df: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct values in the order of their first appearance."""
    first = df.groupBy(ref(name).alias("value")).agg(F.min(ref(position)).alias("first_position"))
    return first.orderBy("first_position", "value")
