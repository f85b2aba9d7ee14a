"""The distributed paths give what a one-task sort would give, hot keys included."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import quantiles, ranks, split


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows; a third share one value, one group holds half of all rows."""
    rng = np.random.default_rng(42)
    value = np.where(rng.random(4000) < 0.34, 7.5, np.round(rng.normal(0, 50, 4000), 1))
    group = np.where(rng.random(4000) < 0.5, "hot", rng.integers(0, 5, 4000).astype(str))
    rows = [(i, float(value[i]), str(group[i])) for i in range(4000)]
    return spark.createDataFrame(rows, "id bigint, v double, g string").repartition(6).cache()


def test_global_rank(skewed):
    got = ranks.global_rank(skewed, [F.col("v"), F.col("id")]).toPandas()
    want = got.sort_values(["v", "id"])["rank"].tolist()
    assert want == list(range(1, 4001))


def test_group_rank(skewed):
    got = ranks.group_rank(skewed, ["g"], [F.desc("v"), F.col("id")]).toPandas()
    for _, part in got.groupby("g"):
        ordered = part.sort_values(["v", "id"], ascending=[False, True])["rank"].tolist()
        assert ordered == list(range(1, len(part) + 1))


@pytest.mark.parametrize("max_rows", [0, 100_000])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals(skewed, by, max_rows):
    counts = skewed.groupBy(*by, "v").agg(F.count("*").alias("n"))
    got = ranks.running_totals(counts, "v", {"before": "n"}, by, max_rows).toPandas().sort_values("v")
    parts = [p for _, p in got.groupby("g")] if by else [got]
    for p in parts:
        assert (p["before"].to_numpy() == np.concatenate([[0], p["n"].cumsum().to_numpy()[:-1]])).all()


@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_dense_index(skewed, max_rows):
    got = ranks.dense_index(skewed.select("g", "v").distinct(), ["g"], [F.col("v")], "i", max_rows).toPandas()
    for _, part in got.groupby("g"):
        assert part.sort_values("v")["i"].tolist() == list(range(1, len(part) + 1))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("as_name", [True, False])
def test_join_lookup_salted_equals_broadcast(skewed, how, as_name):
    lookup = skewed.where("g <> '3'").groupBy("g").agg(F.max("v").alias("top"))
    if as_name:
        on = "g"
    else:
        lookup, on = lookup.withColumnRenamed("g", "k"), F.col("g") == F.col("k")
    small = ranks.join_lookup(skewed, lookup, on, how)
    large = ranks.join_lookup(skewed, lookup, on, how, max_rows=0, salts=3)
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


@pytest.mark.parametrize("rank", [1, 2, 1300, 2000, 2700, 3999, 4000])
def test_order_statistics(skewed, rank):
    values = np.sort(skewed.toPandas()["v"].to_numpy())
    got = ranks.order_statistics(skewed, {"x": ("v", rank)}, small=20, accuracy=50)["x"]
    assert got == values[rank - 1]


def test_order_statistics_rejects_bad_rank(skewed):
    with pytest.raises(ValueError):
        ranks.order_statistics(skewed, {"x": ("v", 4001)})


@pytest.mark.parametrize("rank", [1, 900, 1700, 2400, 4000])
def test_cut_row_among_ties(skewed, rank):
    rows = skewed.withColumn("v", F.when(F.col("g") != "4", F.col("v")))
    pdf = rows.toPandas().sort_values(["v", "id"], na_position="last")
    cut = ranks.cut_row(rows, ["v", "id"], rank, small=20, accuracy=50)
    assert cut[1] == ("id", pdf["id"].iloc[rank - 1])
    assert rows.where(ranks.at_or_before(rows, cut)).count() == rank


def test_cut_row_on_timestamps(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(microseconds=int(i % 97) * 1_000_003)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp_ntz")
    want = sorted(rows, key=lambda r: (r[1], r[0]))[499]
    cut = ranks.cut_row(df, ["ts", "id"], 500, small=5, accuracy=20)
    assert cut == [("ts", want[1]), ("id", want[0])]


@pytest.mark.parametrize("small", [50, 1_000_000])
def test_exact_percentiles(skewed, small):
    shares = [0.0, 0.1, 0.25, 0.333, 0.5, 0.95, 1.0]
    values = skewed.toPandas()["v"].to_numpy()
    got = quantiles.exact_percentiles(skewed, {"v": shares}, small=small, accuracy=100)["v"]
    assert np.allclose(got, np.quantile(values, shares), atol=1e-9)


def test_percentiles_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "v double")
    for small in (1, 100):
        assert quantiles.exact_percentiles(df, {"v": [0.5]}, small=small)["v"] == [2.0]
    empty = df.where("v > 100 and not isnan(v)")
    assert quantiles.exact_percentiles(empty, {"v": [0.5]})["v"] == [None]


@pytest.mark.parametrize("small,accuracy", [(1, 100), (40, 20), (100_000, 2_000)])
def test_order_statistics_of_many_columns_and_types(spark, small, accuracy):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0  # a third of the rows is one value
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=0 if hot else int(rng.integers(300)))
        number = int(rng.integers(2)) if i % 2 else None
        rows.append((float(rng.normal()), number, "hot" if hot else f"k{int(rng.integers(900)):03d}", day, f"u{i:05d}"))
    df = spark.createDataFrame(rows, "a double, `b c` long, s string, d date, u string").repartition(4)
    ranks_of, targets = {}, {}
    for k, c in enumerate(df.columns):
        ranks_of[c] = sorted(r[k] for r in rows if r[k] is not None)
        n = len(ranks_of[c])
        targets |= {f"{c}{r}": (c, r) for r in (1, 2, n // 3, n // 2, n // 2 + 1, n - 1, n)}
    got = ranks.order_statistics(df, targets, small=small, accuracy=accuracy)
    assert got == {label: ranks_of[c][r - 1] for label, (c, r) in targets.items()}


def test_chronological_split_with_text_keys(spark):
    rows = [(f"key{i:05d}", datetime.datetime(2024, 1, 1 + (i % 4 == 0))) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(3)
    got = {r["k"]: r["split"] for r in split.chronological_split(df, "ts", "k", 20, 10, small=50, accuracy=50).collect()}
    order = [k for k, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert [got[k] for k in order] == ["train"] * 1400 + ["valid"] * 200 + ["test"] * 400


@pytest.mark.parametrize("on", ["g", "column"])
def test_copies_of_a_large_lookup_are_not_broadcast(spark, skewed, on):
    lookup = skewed.groupBy("g").agg(F.count("*").alias("n"))
    if on == "column":
        lookup = lookup.withColumnRenamed("g", "h")
    joined = ranks.join_lookup(skewed, lookup, on if on == "g" else F.col("g") == F.col("h"), "left", max_rows=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == 4000 and joined.where("n is null").count() == 0
