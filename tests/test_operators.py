"""Rules and edge cases of the profile, role, cleaning, encoding, metric, tracking and log operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.functions.fixed import STOP_WORDS
from tabloom.operators import clean as C
from tabloom.operators import encode as E
from tabloom.operators import logs as L
from tabloom.operators import metrics as M
from tabloom.operators import profile as P
from tabloom.operators import roles as R
from tabloom.operators import tracking as T
from tabloom.operators.tfidf import TfIdf
from tabloom.plans import catalog
from tabloom.session import scratch_path


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def holed(spark):
    """Nulls and NaN: feature2 is missing in every tenth row, the strings follow their own pattern."""
    rng = np.random.default_rng(42)
    data = [
        (i, float(rng.normal()), None if i % 20 == 0 else float("nan") if i % 10 == 0 else float(rng.normal()),
         ["A", "B", None][i % 3], "text" if i % 5 == 0 else None, int(rng.integers(0, 2)))
        for i in range(100)
    ]
    return spark.createDataFrame(data, "id bigint, feature1 double, feature2 double, feature3 string, feature4 string, target int")


def test_missing_counts_nan_and_null(spark):
    got = {r["column"]: r["missing"] for r in P.dataset_summary(holed(spark)).collect()}
    assert got == {"id": 0, "feature1": 0, "feature2": 10, "feature3": 33, "feature4": 80, "target": 0}
    report = [(r["column"], r["missing_pct"]) for r in P.missing_report(holed(spark)).collect()]
    assert report == [("feature4", 80.0), ("feature3", 33.0), ("feature2", 10.0)]


def test_empty_table_profile(spark):
    empty = holed(spark).where("id < 0")
    assert P.overview(empty).first()["health_alert"] == 0
    assert P.missing_report(empty).count() == 0
    assert P.class_imbalance(empty, "feature3").first()["imbalance_ratio"] is None


def test_histogram_of_constant_and_alerts(spark):
    flat = spark.range(50).select(F.lit(3.0).alias("v"), F.lit("x").alias("s"), F.col("id"))
    h = P.histogram(flat, "v").toPandas().sort_values("bin")
    assert h["n"].sum() == 50 and h["lower"].iloc[0] == 2.5 and h["upper"].iloc[-1] == 3.5 and (h["n"] > 0).sum() == 1
    alerts = {r["column"]: r for r in P.column_alerts(flat).collect()}
    assert alerts["v"]["is_constant"] == alerts["s"]["is_constant"] == 1 and alerts["id"]["is_unique"] == 1


def test_describe_matches_pandas(spark):
    df = holed(spark)
    want = df.toPandas()["feature2"].describe()
    got = P.describe(df, ["feature2"]).first()
    for mine, theirs in (("n", "count"), ("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
        assert got[mine] == pytest.approx(want[theirs])


def test_spearman_distributed_path(spark, monkeypatch):
    from tabloom.operators import ranks

    df = spark.range(300).select((F.col("id") % 7).alias("a"), (F.col("id") * F.col("id") % 31).alias("b"))
    small = P.spearman(df, "a", "b").first()["spearman"]
    monkeypatch.setattr(ranks, "small_side", lambda d, max_rows=0: (d, False))
    assert P.spearman(df, "a", "b").first()["spearman"] == pytest.approx(small)
    pdf = df.toPandas().rank()
    assert small == pytest.approx(pdf["a"].corr(pdf["b"]))


def test_correlation_of_any_number_of_rows(spark):
    big = spark.range(10_001).select("id", (F.col("id") * 2).alias("x"))
    assert P.correlation_matrix(big).first()["pearson"] == pytest.approx(1.0)


def test_correlations_over_pairs_of_present_values(spark):
    rng = np.random.default_rng(9)
    table = rng.normal(size=(500, 12)) + 1e6
    table[:, 1] = 2 * table[:, 0] + rng.normal(size=500)
    table[:, 2] = 5.0  # constant
    table[rng.random((500, 12)) < 0.2] = np.nan
    names = [f"c{k}" for k in range(12)]
    df = spark.createDataFrame(table.tolist(), ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r["column_a"], r["column_b"]): r["pearson"] for r in P.correlation_matrix(df).collect()}
    assert len(got) == 66
    for (a, b), value in got.items():
        x, y = table[:, names.index(a)], table[:, names.index(b)]
        both = ~np.isnan(x) & ~np.isnan(y)
        if "c2" in (a, b):
            assert value is None
        else:
            assert value == pytest.approx(np.corrcoef(x[both], y[both])[0, 1], abs=1e-6)
    assert P.correlation_matrix(df.select("c0")).count() == 0 and P.correlation_matrix(df.limit(0)).where("pearson is not null").count() == 0



def test_duplicates(spark):
    people = spark.range(100).select((F.col("id") % 10).alias("idade"), (F.col("id") % 10 * 100).alias("salario"))
    assert tuple(P.duplicate_rows(people).first()) == (10, 100, 90)
    tricky = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)], "x string, y string")
    assert P.duplicate_rows(tricky).first()["n_groups"] == 0


def test_roles(spark):
    df = spark.createDataFrame(
        [("one long text here", 1.0, 1, "A", 0), ("another text", 2.0, 2, "B", 1), ("third text", 3.0, 3, "A", 0)],
        "text_col string, num_col1 double, num_col2 int, cat_col string, target int",
    )
    assert dict(rows(R.column_roles(df, "target"))) == {
        "text_col": "text", "num_col1": "numeric", "num_col2": "numeric", "cat_col": "text"
    }
    assert dict(rows(R.column_roles(df, "target", ["text_col"])))["cat_col"] == "categorical"


def test_multimodal_roles(spark):
    df = spark.createDataFrame(
        [(0, "A very long product title with words", "/tmp/a.png", 0), (1, "Yet another long product title here", "/tmp/b.jpg", 1)],
        "id bigint, title string, image_path string, target int",
    )
    assert dict(rows(R.infer_multimodal(df, "id", "target"))) == {"id": "other", "title": "text", "image_path": "image"}


def test_multimodal_roles_look_at_all_rows(spark):
    late = spark.range(100).select("id", F.when(F.col("id") < 30, "n/a").otherwise("/tmp/x.Png").alias("picture"))
    assert dict(rows(R.infer_multimodal(late, "id")))["picture"] == "image"
    assert dict(rows(R.infer_multimodal(late, "id", sample_size=25)))["picture"] == "other"


@pytest.mark.parametrize(
    "values,kind,want",
    [(["A", "B", "A"], "string", "classification"), ([1.2, 2.1, 3.4], "double", "regression"), ([1.0, 2.0, None], "double", "classification"),
     (list(range(21)), "int", "regression"), (list(range(20)), "int", "classification")],
)
def test_problem_type(spark, values, kind, want):
    df = spark.createDataFrame([(v,) for v in values], f"y {kind}")
    assert R.detect_problem_type(df, "y").first()["problem_type"] == want


def test_clean_rules(spark):
    df = holed(spark)
    with pytest.raises(ValueError):
        C.drop_null_target(df, "nope")
    assert C.drop_null_target(df, ["feature2", "feature3"]).count() == 60
    text = spark.createDataFrame([(" a  b ",), (None,), ("",)], "t string")
    assert rows(C.text_features(text)) == sorted([(6, 2), (0, 0), (0, 0)])
    assert [r[0] for r in C.numeric_coerce(text.select(F.lit("3.5").alias("n")).limit(1), ["n"]).collect()] == [3.5]
    train, apply = df.where("id < 50"), df.where("id >= 50")
    filled = C.Imputer.fit(train, "target").transform(apply)
    assert {r["missing"] for r in P.dataset_summary(filled).collect()} == {0}
    median = np.nanmedian(train.toPandas()["feature2"].to_numpy(dtype=float))
    assert filled.where("id = 60").first()["feature2"] == pytest.approx(median)


def test_unseen_category_and_decode(spark):
    index = E.CategoryIndex.fit(spark.createDataFrame([("cat",), ("dog",)], "t string"), ["t"], max_rows=0)
    assert rows(index.transform(spark.createDataFrame([("dog",), ("eel",), (None,)], "t string"))) == [(-1,), (-1,), (1,)]
    numbers = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (-1.0,), (float("nan"),)], "p double")
    assert {r["d"] for r in index.decode(numbers, "t", "p", "d").collect()} == {"cat", "dog", "2.0", "-1.0", "NaN"}


def test_assembly_round_trip(spark):
    df = holed(spark)
    assembly = E.FeatureAssembly.fit(df, "target", text_columns=["feature4"], exclude=["id"])
    out = assembly.transform(df).select("id", vector_to_array("features").alias("v")).toPandas().set_index("id")["v"]
    assert len(out) == 100 and all(np.isfinite(v).all() for v in out)
    path = scratch_path(spark, "assembly")
    assembly.save(spark, path)
    again = E.FeatureAssembly.load(spark, path).transform(df).select("id", vector_to_array("features").alias("v")).toPandas()
    for i, v in again.itertuples(index=False):
        assert np.allclose(v, out[i])
    # Scoring works without the target and with values never seen.
    odd = df.drop("target").withColumn("feature3", F.lit("Z")).limit(1)
    assert assembly.transform(odd).count() == 1


def test_tfidf_brute_force(spark):
    texts = ["Blue sky, blue sea", "the sky and the moon", "", "moon moon moon_1", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    model = TfIdf.fit(df, "t", 5, (1, 2))
    import re

    docs = []
    for t in texts:
        words = [w for w in re.findall(r"\w+", (t or "").lower()) if w not in STOP_WORDS]
        docs.append(words + [" ".join(p) for p in zip(words, words[1:])])
    counts = pd.Series([w for d in docs for w in d]).value_counts()
    vocabulary = sorted(counts.index, key=lambda w: (-counts[w], w))[:5]
    assert model.vocabulary == vocabulary
    want = {}
    for i, d in enumerate(docs):
        raw = {w: d.count(w) * (math.log(6 / (1 + sum(w in x for x in docs))) + 1) for w in vocabulary if w in d}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want.update({(i, w): x / norm for w, x in raw.items()})
    got = {(r["id"], r["term"]): r["weight"] for r in model.long_form(df, "id", "t").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    trigrams = TfIdf.fit(df, "t", 50, (3, 3))
    assert trigrams.vocabulary == ["blue sky blue", "moon moon moon_1", "sky blue sea"]


@pytest.mark.parametrize("max_rows", [0, 100_000])
def test_auc_brute_force(spark, max_rows):
    rng = np.random.default_rng(7)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert M.roc_auc(df, F.col("y") == 1, "s", max_rows=max_rows).first()[0] == pytest.approx(want)
    both = df.select(F.col("y").cast("string").alias("label"), "s", (1 - F.col("s")).alias("r"))
    scores = {"1": "s", "0": "r"}
    assert M.roc_auc_ovr(both, "label", scores, max_rows=max_rows).first()[0] == pytest.approx(want)
    assert M.roc_auc_ovo(both, "label", scores, max_rows=max_rows).first()[0] == pytest.approx(want)


def test_perfect_predictions(spark):
    df = spark.range(10).select((F.col("id") >= 5).cast("int").alias("label")).withColumn("prediction", F.col("label"))
    assert set(M.classification_scores(df).first()) == {1.0}
    assert M.regression_scores(df).first()["r2"] == 1.0
    constant = spark.range(3).select(F.lit(2.0).alias("label"), F.lit(1.0).alias("prediction"))
    assert M.regression_scores(constant).first()["r2"] is None


def test_tracking_edges(spark):
    entries = spark.createDataFrame(
        [("r1", "e", "metric", "auc", "0.5", 1), ("r1", "e", "metric", "auc", "0.75", 2), ("r2", "e", "param", "lr", "x", 1)],
        "run_id string, experiment string, kind string, key string, value string, ts bigint",
    )
    found = {r["run_id"]: r.asDict() for r in T.search_runs(entries, "e").collect()}
    assert found["r1"]["metrics.auc"] == 0.75 and found["r2"]["params.lr"] == "x" and found["r2"]["metrics.auc"] is None
    assert T.search_runs(entries, "unknown").count() == 0
    board = spark.createDataFrame([("e", "m", 1, 0.5)], "experiment string, model string, rank int, rmse double")
    all_ = spark.createDataFrame([("e",), ("empty",)], "experiment string")
    got = {r["experiment"]: tuple(r)[1:] for r in T.best_metric(board, "experiment", "rank", ["rmse"], all_).collect()}
    assert got == {"e": (1, "rmse", 0.5), "empty": (0, "none", 0.0)}


def test_run_steps_edges(spark):
    lines = spark.createDataFrame(
        [(1, 0, "nothing"), (2, 0, "Pipeline exported"), (2, 1, "Thread finished"), (3, 0, "Starting TPOT training")],
        "run_key int, seq int, line string",
    )
    runs = spark.createDataFrame(
        [(1, "tpot", "failed"), (2, "tpot", "running"), (3, "TPOT", "queued"), (4, "tpot", "running")],
        "run_key int, family string, status string",
    )
    got = {}
    for r in L.run_steps(lines, runs).orderBy("run_key", "step").collect():
        got.setdefault(r["run_key"], []).append(r["step_status"])
    assert got == {
        1: ["pending"] * 5, 2: ["done"] * 5, 3: ["done"] + ["pending"] * 4, 4: ["active"] + ["pending"] * 4
    }
    assert L.run_steps(lines, runs.where("run_key = 1").withColumn("family", F.lit("other"))).count() == 0


def test_clean_line(spark):
    df = spark.createDataFrame([("\t 10% █▌▄ <a&b> \n",), (" \n",)], "line string")
    got = L.classify_lines(L.clean_lines(df)).collect()
    assert [(r["line"], r["safe_line"]) for r in got] == [("10% #|- <a&b>", "10% #|- &lt;a&amp;b&gt;")]


def test_whole_report_has_every_column(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    got = {r["column"]: r["n_unique"] for r in catalog.QUERIES["b_profile_report_whole"](spark, folder).collect()}
    assert got == {c: lines.select(c).distinct().count() for c in lines.columns}


def test_run_tables_have_bounded_width(spark, monkeypatch):
    from tabloom.operators import tracking

    rows = [("r", "e", "metric", f"m{i}", "1", None) for i in range(6)]
    entries = spark.createDataFrame(rows, "run_id string, experiment string, kind string, key string, value string, ts timestamp")
    assert len(tracking.search_runs(entries, "e").columns) == 7
    monkeypatch.setattr(tracking, "MAX_NAMES", 5)
    with pytest.raises(ValueError):
        tracking.search_runs(entries, "e")
    assert len(tracking.search_runs(entries, "e", ["metrics.m1"]).columns) == 2
