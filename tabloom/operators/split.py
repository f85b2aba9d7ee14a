"""Train, validation and test splits, folds, seeded samples and class weights.

Random splits are exact in size without sorting the table: a seeded hash orders the rows, counts per hash
slice locate the cut, and the split itself is a comparison with the cut row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import ref, seeded_digest, seeded_hash
from tabloom.operators.ranks import (
    at_or_before,
    cut_row,
    hash_cuts,
    hash_position,
    join_lookup,
    with_hash,
)


def _mark(hashed: DataFrame, by: list[str], takes: dict[str, Column]) -> DataFrame:
    """A boolean column per entry of `takes`: true for that many first rows of each group in seeded order."""
    cuts = hash_cuts(hashed, by, takes)

    def first_rows(cut_hash: Column, cut_key: Column) -> Column:
        hit = (F.col("_hash") < cut_hash) | ((F.col("_hash") == cut_hash) & (F.col("_key") <= cut_key))
        return F.coalesce(hit, F.lit(False))

    if not by:
        found = {r["_cut"]: r for r in cuts.collect()}  # at most one row per cut
        marks = {n: first_rows(F.lit(r["_cut_hash"]), F.lit(r["_cut_key"])) for n, r in found.items()}
        return hashed.withColumns({n: marks.get(n, F.lit(False)) for n in takes})
    wide = cuts.groupBy(*[f"_c_{c}" for c in by]).agg(
        *[F.max(F.when(F.col("_cut") == n, F.struct("_cut_hash", "_cut_key"))).alias(f"_at_{n}") for n in takes]
    )
    on = [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by]
    joined = join_lookup(hashed, wide, on, "left")
    marked = joined.withColumns({n: first_rows(F.col(f"_at_{n}._cut_hash"), F.col(f"_at_{n}._cut_key")) for n in takes})
    return marked.drop(*[f"_at_{n}" for n in takes], *[f"_c_{c}" for c in by])


def _percent_ceil(n: Column, numerator: int, denominator: int) -> Column:
    return F.floor((n * numerator + (denominator - 1)) / denominator).cast("long")


def random_split(
    df: DataFrame, key: Column, test_pct: int = 20, val_pct: int = 0, seed: int = 42,
    min_rows: int = 0,
) -> DataFrame:
    """Column `split`: exactly ceil(n * test) test rows, then the validation share of the rest.

    Validation is left out when at most `min_rows` rows remain. The three sets are disjoint. `key` must be
    unique per row.
    """
    hashed = with_hash(df, key, seed)
    n = F.col("_n")
    test_rows = _percent_ceil(n, test_pct, 100)
    rest = n - test_rows
    val_rows = F.when(rest > min_rows, _percent_ceil(rest, val_pct, 100 - test_pct)).otherwise(0)
    # Validation rows follow the test rows in the same order.
    takes = {"_test": test_rows, "_upto": test_rows + val_rows} if val_pct > 0 else {"_test": test_rows}
    marked = _mark(hashed, [], takes)
    if val_pct <= 0:
        marked = marked.withColumn("_upto", F.lit(False))
    split = F.when(F.col("_test"), "test").when(F.col("_upto"), "valid").otherwise("train")
    return marked.withColumn("split", split).drop("_test", "_upto", "_key", "_hash", "_slice")


def approximate_split(df: DataFrame, key: Column, test_pct: int = 20, val_pct: int = 0, seed: int = 42) -> DataFrame:
    """Split by hash threshold alone: map-only, set sizes match in expectation."""
    share = seeded_hash(key, seed) * 100
    split = F.when(share < (test_pct << 28), "test").when(share < ((test_pct + val_pct) << 28), "valid")
    return df.withColumn("split", split.otherwise("train"))


def stratified_split(df: DataFrame, by: str, key: Column, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Column `split`: per class exactly floor(n_c * share + 0.5) test rows."""
    hashed = with_hash(df, key, seed)
    take = F.floor((F.col("_n") * (2 * test_pct) + 100) / 200).cast("long")
    marked = _mark(hashed, [by], {"_test": take})
    split = F.when(F.col("_test"), "test").otherwise("train")
    return marked.withColumn("split", split).drop("_test", "_key", "_hash", "_slice")


def manual_split(df: DataFrame, name: str) -> DataFrame:
    """Column `split` from the text of a split column: val before test, everything else train."""
    text = F.lower(ref(name).cast("string"))
    split = F.when(text.contains("val"), "valid").when(text.contains("test"), "test").otherwise("train")
    return df.withColumn("split", split)


def chronological_split(
    df: DataFrame, time: str, key: str, test_pct: int = 20, val_pct: int = 0, **tuning
) -> DataFrame:
    """Column `split`: the last rows by (time, key) are test, those before them validation; null times come last.

    The two cut rows are found by rank search, so no rank is computed for any other row and the split is
    a map-only comparison.
    """
    n = df.count()
    test_from = n * (100 - test_pct) // 100
    val_from = n * (100 - test_pct - val_pct) // 100
    order = df.select(time, key)

    def head(rows: int) -> Column:
        if rows <= 0:
            return F.lit(False)
        return at_or_before(df, cut_row(order, [time, key], rows, **tuning))

    train = head(val_from)
    before_test = train if val_from == test_from else head(test_from)
    return df.withColumn("split", F.when(train, "train").when(before_test, "valid").otherwise("test"))


def kfold_assign(
    df: DataFrame, key: Column, k: int = 5, by: str | None = None, seed: int = 42, partitions: int | None = None
) -> DataFrame:
    """Column `fold` 0..k-1 with sizes equal to within one row, per class when `by` is given; with `partitions` the rows
    lie in that many parts of about one size."""
    if not 2 <= k <= 10:
        raise ValueError("k must be between 2 and 10")
    placed = hash_position(df, [by] if by else [], key, seed, "_position", partitions)
    return placed.withColumn("fold", F.pmod(F.col("_position"), F.lit(k)).cast("int")).drop("_position")


def hash_folds(df: DataFrame, key: Column, k: int = 5, seed: int = 42) -> DataFrame:
    """Column `fold` straight from the seeded hash: no shuffle, sizes equal in expectation."""
    return df.withColumn("fold", F.pmod(seeded_hash(key, seed), F.lit(k)).cast("int"))


def bounded_sample(df: DataFrame, key: Column, n: int = 100, seed: int = 42) -> DataFrame:
    """At most n rows, reproducible; a bounded heap per task, no full sort."""
    picked = df.withColumn("_key", key.cast("string")).orderBy(seeded_digest(F.col("_key"), seed), "_key").limit(n)
    return picked.drop("_key")


def class_weights(df: DataFrame, by: str) -> DataFrame:
    """Weight n / (k * n_c) of every class, from map-side combined counts."""
    counts = df.where(ref(by).isNotNull()).groupBy(ref(by).alias(by)).agg(F.count("*").alias("n_class"))
    totals = counts.agg(F.struct(F.sum("n_class").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.select(by, "n_class", totals.alias("t")).select(
        by, "n_class", (F.col("t.n") / (F.col("t.k") * F.col("n_class"))).alias("weight")
    )


def with_class_weight(df: DataFrame, by: str, name: str = "weight") -> DataFrame:
    weights = class_weights(df, by).select(by, F.col("weight").alias(name))
    return join_lookup(df, weights, by)


#: Copies of a row that are listed at once.
COPIES = 1000


def balance_classes(df: DataFrame, by: str) -> DataFrame:
    """Oversample: each row of a class repeated so that it comes closest to the largest class."""
    counts = df.groupBy(ref(by).alias(by)).agg(F.count("*").alias("_n"))
    largest = counts.agg(F.max("_n")).scalar()
    times = counts.select(by, F.floor((2 * largest + F.col("_n")) / (2 * F.col("_n"))).cast("int").alias("_times"))
    # In two steps, so that no row ever holds a list of all its copies.
    block = F.explode(F.sequence(F.lit(0), F.col("_times") - 1, F.lit(COPIES)))
    blocks = join_lookup(df, times, by).withColumn("_block", block)
    last = F.least(F.col("_times"), F.col("_block") + COPIES)
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("_block") + 1, last))).drop("_times", "_block")


def split_summary(df: DataFrame, target: str | None = None) -> DataFrame:
    """Rows per split and the target's name."""
    return df.groupBy("split").agg(F.count("*").alias("n_rows")).withColumn("target", F.lit(target))
