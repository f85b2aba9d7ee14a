"""Exact sizes, disjoint sets, documented edge rules."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.operators import split as S


def sizes(df):
    return {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(1, 400), test=st.integers(0, 50), val=st.integers(0, 40), least=st.sampled_from([0, 100]))
def test_random_split_sizes(spark, n, test, val, least):
    got = sizes(S.random_split(spark.range(n), F.col("id"), test, val, min_rows=least))
    n_test = -(-n * test // 100)
    n_val = -(-(n - n_test) * val // (100 - test)) if n - n_test > least and val else 0
    assert got.get("test", 0) == n_test and got.get("valid", 0) == n_val
    assert sum(got.values()) == n


def test_random_split_is_seeded_and_disjoint(spark):
    a = S.random_split(spark.range(1000), F.col("id"), 20, 10).collect()
    b = S.random_split(spark.range(1000).repartition(7), F.col("id"), 20, 10).collect()
    other = S.random_split(spark.range(1000), F.col("id"), 20, 10, seed=7).collect()
    assert dict(a) == dict(b) != dict(other)
    assert len({r["id"] for r in a}) == 1000


def test_stratified_split_of_a_hot_class(spark):
    df = spark.range(900).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 897, "b").otherwise("c").alias("y"))
    got = Counter((r["y"], r["split"]) for r in S.stratified_split(df, "y", F.col("id"), 20).collect())
    assert (got["hot", "test"], got["b", "test"], got["c", "test"]) == (140, 39, 1)


def test_kfold_sizes(spark):
    df = spark.range(1003).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("y"))
    folds = Counter((r["y"], r["fold"]) for r in S.kfold_assign(df, F.col("id"), 4, "y").collect())
    for y in ("hot", "b"):
        n = [folds[y, f] for f in range(4)]
        assert max(n) - min(n) <= 1
    with pytest.raises(ValueError):
        S.kfold_assign(df, F.col("id"), 11)


def test_chronological_split_by_search_and_by_sort(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 5 > 0, F.floor(F.col("id") / 100)).alias("ts"))
    direct = S.chronological_split(df, "ts", "id", 20, 10).collect()
    searched = S.chronological_split(df, "ts", "id", 20, 10, small=3, accuracy=20).collect()
    assert sorted(direct) == sorted(searched)
    assert Counter(r["split"] for r in direct) == {"train": 350, "valid": 50, "test": 100}
    key = lambda r: (r["ts"] is None, r["ts"] or 0, r["id"])
    order = [r["split"] for r in sorted(direct, key=key)]
    assert order == ["train"] * 350 + ["valid"] * 50 + ["test"] * 100


def test_manual_split_prefers_val(spark):
    df = spark.createDataFrame([("VAL-test",), ("Test",), (None,), ("train",)], "s string")
    assert [r["split"] for r in S.manual_split(df, "s").collect()] == ["valid", "test", "train", "train"]


def test_balance_classes(spark):
    df = spark.range(110).select("id", (F.col("id") < 10).alias("y"))
    got = {r["y"]: r["count"] for r in S.balance_classes(df, "y").groupBy("y").count().collect()}
    assert got == {True: 100, False: 100}


def test_bounded_sample(spark):
    a = S.bounded_sample(spark.range(1000), F.col("id"), 100).collect()
    assert len(set(a)) == 100 and sorted(a) == sorted(S.bounded_sample(spark.range(1000).repartition(5), F.col("id"), 100).collect())
    assert S.bounded_sample(spark.range(7), F.col("id"), 100).count() == 7
