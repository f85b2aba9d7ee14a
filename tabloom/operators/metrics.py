"""Evaluation metrics as aggregations over tables of labels, predictions and scores.

Classification figures come from one map-side combined confusion count; ranking figures from counts per
distinct score; regression figures from one or two aggregate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.columns import long_rows
from tabloom.operators.ranks import running_totals

CLIP = 1e-15


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where undefined."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def confusion_pivot(df: DataFrame, labels: list[str], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label, one count column per prediction."""
    wide = confusion(df, label, prediction).groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
    return wide.select("label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def _per_class(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class over the union of labels and predictions."""
    hit = F.when(F.col("label").eqNullSafe(F.col("prediction")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")

    def side(name: Column, support: Column, predicted: Column, hits: Column) -> Column:
        return F.struct(
            name.cast("string").alias("label"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits")
        )

    as_label = side(F.col("label"), F.col("n"), zero, hit.cast("long"))
    as_prediction = side(F.col("prediction"), zero, F.col("n"), zero)
    sides = counts.select(F.inline(F.array(as_label, as_prediction)))
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hits")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows: every class, then accuracy, macro avg and weighted avg; class rows and averages share one rollup."""
    classes = _per_class(confusion(df, label, prediction))
    measures = ["precision", "recall", "f1"]
    weighted = [F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in measures]
    rolled = classes.rollup("label").agg(
        F.grouping("label").alias("total"),
        *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        *weighted,
    )
    none = F.lit(None).cast("double")

    def row(name, values):
        return F.struct(name.alias("label"), *[v.alias(m) for m, v in zip(measures, values)], F.col("support").alias("support"))

    per_class = row(F.col("label"), [F.col(m) for m in measures])
    averages = F.array(
        row(F.lit("accuracy"), [none, none, F.col("accuracy")]),
        row(F.lit("macro avg"), [F.col(m) for m in measures]),
        row(F.lit("weighted avg"), [F.col(f"w_{m}") for m in measures]),
    )
    return rolled.select(F.inline(F.when(F.col("total") == 1, averages).otherwise(F.array(per_class))))


def classification_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, F1 (macro, weighted, micro), balanced accuracy, macro precision and recall."""
    classes = _per_class(confusion(df, label, prediction))
    true_classes = F.when(F.col("support") > 0, F.col("recall"))
    return classes.agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        F.try_divide(F.sum("hits"), F.sum("support")).alias("f1_micro"),
        F.avg(true_classes).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows with a label that are predicted right; a null prediction is wrong."""
    right = F.col(label).eqNullSafe(F.col(prediction)).cast("double")
    return df.agg(F.avg(F.when(F.col(label).isNotNull(), right)).alias("accuracy"))


def roc_auc(df: DataFrame, positive: Column, score: str, **tuning) -> DataFrame:
    """Binary area under the ROC curve by average ranks: ties count one half."""
    is_positive = positive.cast("boolean")
    counts = df.groupBy(F.col(score).alias("score")).agg(F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg"))
    ranked = running_totals(counts, "score", {"neg_before": "neg"}, **tuning)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("roc_auc"))


def _class_score_counts(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """Counts per (class, its score, true label)."""
    triples = df.select(
        F.inline(
            F.array(*[F.struct(F.lit(k).alias("class"), F.col(s).alias("score"), F.col(label).alias("label")) for k, s in scores.items()])
        )
    )
    return triples.groupBy("class", "score", "label").agg(F.count("*").alias("n"))


def grouped_auc(counts: DataFrame, by: list[str], **tuning) -> DataFrame:
    """Area per group from counts (by, score, pos, neg)."""
    sums = counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ranked = running_totals(sums, "score", {"neg_before": "neg"}, by, **tuning)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[str, str], **tuning) -> DataFrame:
    """Macro mean of each class against the rest; `scores` maps a class to its score column."""
    own = F.col("label") == F.col("class")
    counts = _class_score_counts(df, label, scores).withColumns(
        {"pos": F.when(own, F.col("n")).otherwise(0), "neg": F.when(own, 0).otherwise(F.col("n"))}
    )
    return grouped_auc(counts, ["class"], **tuning).agg(F.avg("auc").alias("roc_auc_ovr"))


def roc_auc_ovo(df: DataFrame, label: str, scores: dict[str, str], **tuning) -> DataFrame:
    """Macro mean over all ordered class pairs of the area within the two classes."""
    counts = _class_score_counts(df, label, scores)
    others = F.array(*[F.lit(k) for k in scores])
    zero = F.lit(0).cast("long")
    # A row of class a meets every other class b once as positive under a's score and once as negative under b's.
    own = F.col("label") == F.col("class")
    rivals = F.when(own, F.array_remove(others, F.col("class"))).otherwise(F.array(F.col("label")))
    pairs = counts.withColumn("rival", F.explode(rivals)).withColumns(
        {"pos": F.when(own, F.col("n")).otherwise(zero), "neg": F.when(own, zero).otherwise(F.col("n"))}
    )
    return grouped_auc(pairs, ["class", "rival"], **tuning).agg(F.avg("auc").alias("roc_auc_ovo"))


def log_loss(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """Mean of -log p(true class), p clipped away from 0 and 1."""
    p = None
    for k, s in scores.items():
        hit = F.col(label) == F.lit(k)
        p = F.when(hit, F.col(s)) if p is None else p.when(hit, F.col(s))
    clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return df.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae, r2, mape, explained variance; spreads are taken around the mean found first."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pairs = df.select(y.alias("y"), (y - p).alias("e"))
    means = pairs.agg(F.struct(F.avg("y").alias("y"), F.avg("e").alias("e"))).scalar()
    centred = pairs.withColumn("m", means)
    sums = centred.agg(
        F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.avg(F.abs("e")).alias("mae"),
        F.avg(F.abs("e") / F.greatest(F.abs("y"), F.lit(2.220446049250313e-16))).alias("mape"),
        F.sum((F.col("y") - F.col("m.y")) * (F.col("y") - F.col("m.y"))).alias("spread"),
        F.sum(F.col("e") * F.col("e")).alias("residual"),
        F.sum((F.col("e") - F.col("m.e")) * (F.col("e") - F.col("m.e"))).alias("e_spread"),
    )
    return sums.select(
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mae",
        (1 - F.try_divide(F.col("residual"), F.col("spread"))).alias("r2"),
        "mape",
        (1 - F.try_divide(F.col("e_spread"), F.col("spread"))).alias("explained_variance"),
    )


def mase(df: DataFrame, time: str, label: str, prediction: str, is_test: Column, season: int = 1, series: str | None = None) -> DataFrame:
    """Mean absolute error of the test part over the mean seasonal-lag difference of the training part.

    A series holds one row per period, so its length is bounded by the time span.
    """
    keys = [F.col(series)] if series else [F.lit("all").alias("series")]
    marked = df.withColumn("_test", is_test)
    w = W.partitionBy(series if series else F.lit(0), "_test").orderBy(time)
    steps = marked.withColumn("_lag", F.when(~F.col("_test"), F.abs(F.col(label) - F.lag(label, season).over(w))))
    err = F.when(F.col("_test"), F.abs(F.col(label) - F.col(prediction)))
    return steps.groupBy(*keys).agg(F.try_divide(F.avg(err), F.avg("_lag")).alias("mase"))


def ndcg_at_k(df: DataFrame, group: str, relevance: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """Discounted gain of the top k by score over that of the top k by relevance, per group.

    Both tops are limited windows, which Spark cuts to k rows per group before the shuffle.
    """

    def top(order: str, name: str) -> DataFrame:
        w = W.partitionBy(group).orderBy(F.desc(order), tie)
        best = df.select(group, relevance, order, tie) if order != relevance else df.select(group, relevance, tie)
        best = best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        return best.groupBy(group).agg(F.sum(F.col(relevance) / F.log2(F.col("_r") + 1.0)).alias(name))

    both = top(score, "dcg").join(top(relevance, "ideal"), group)
    return both.select(group, _ratio(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def mean_ndcg(per_group: DataFrame) -> DataFrame:
    return per_group.agg(F.avg("ndcg").alias("mean_ndcg"), F.count("*").alias("n_groups"))


def anomaly_ratio(df: DataFrame, flag: str = "Anomaly") -> DataFrame:
    return df.agg(F.avg(F.col(flag).cast("double")).alias("anomaly_ratio"))


def n_clusters(df: DataFrame, cluster: str = "Cluster") -> DataFrame:
    return df.agg(F.count_distinct(cluster).alias("n_clusters"))


def mean_label_score(scores: DataFrame, target: str = "target", score: str = "best_score") -> DataFrame:
    """Mean best score over targets and one row per target, names lower-cased with blanks and '-' as '_'."""
    per = scores.groupBy(target).agg(F.max(score).alias("value"))
    rolled = per.rollup(target).agg(F.grouping(target).alias("total"), F.avg("value").alias("value"))
    key = F.concat(F.lit("best_model_score_"), F.translate(F.lower(target), " -", "__"))
    return rolled.select(F.when(F.col("total") == 1, "best_model_score_avg").otherwise(key).alias("metric"), "value")


def scores_long(df: DataFrame) -> DataFrame:
    """One-row score table as (metric, value) rows."""
    return long_rows(df, [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
