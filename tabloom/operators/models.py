"""Model candidates, cross-validation, search, ensembles and clustering on MLlib.

Tables stay on the executors: the driver holds the candidate list and score rows. The encoded table is
cached once and shared by all fits.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, MinMaxScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.columns import ref, string_columns
from tabloom.operators import blocks
from tabloom.operators.budget import Budget, OutOfTime, run_within
from tabloom.operators.clean import drop_null_target, drop_targets, per_label_subset
from tabloom.operators.encode import CategoryIndex, FeatureAssembly
from tabloom.operators.grown import ExtraTrees, SoftmaxBoosting
from tabloom.operators.metrics import CLIP, grouped_auc
from tabloom.operators.pipelines import AssemblyStage, OutcomeStage, apply_to, probabilities
from tabloom.operators.ranks import group_rank
from tabloom.operators.roles import detect_problem_type, infer_multimodal
from tabloom.operators.split import kfold_assign, with_class_weight

SEED = 42
Candidate = Callable[[int], object]

# Metric by which candidates are ranked, per task.
DEFAULT_METRIC = {"classification": "f1_weighted", "regression": "r2"}
METRICS = {
    "classification": ["accuracy", "f1_macro", "f1_weighted"],
    "regression": ["r2", "mse", "rmse", "mae"],
}
LOSSES = {"mse", "rmse", "mae", "mase", "mape", "log_loss"}
# Metrics that a board is ranked by on request.
MORE_METRICS = {"classification": ["balanced_accuracy", "log_loss", "roc_auc"], "regression": ["mape"]}


#: Families made only when named.
ON_REQUEST = ("et", "softmax")


def classifiers(n_classes: int, include=None, exclude=None, **params) -> dict[str, Candidate]:
    """Estimator makers by family: linear, naive Bayes, random forest, boosted trees (one-vs-rest beyond two classes).

    Extremely randomised trees ("et") and softmax boosting ("softmax") are made when `include` names them.
    """
    iters, trees, depth = params.get("max_iter", 50), params.get("trees", 20), params.get("depth", 5)

    def boosted(seed):
        gbt = GBTClassifier(maxIter=params.get("boosts", 10), maxDepth=depth, seed=seed)
        return gbt if n_classes <= 2 else OneVsRest(classifier=gbt)

    makers = {
        "lr": lambda seed: LogisticRegression(maxIter=iters),
        "nb": lambda seed: NaiveBayes(modelType="gaussian"),
        "rf": lambda seed: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed),
        "gbt": boosted,
        "et": lambda seed: ExtraTrees(numTrees=trees, maxDepth=depth, seed=seed),
        "softmax": lambda seed: SoftmaxBoosting(maxIter=params.get("boosts", 10), maxDepth=depth, seed=seed),
    }
    return _pick(makers, include, exclude)


def regressors(include=None, exclude=None, **params) -> dict[str, Candidate]:
    """Estimator makers by family: linear, random forest, boosted trees; extremely randomised trees ("et") when
    `include` names them."""
    iters, trees, depth = params.get("max_iter", 50), params.get("trees", 20), params.get("depth", 5)
    makers = {
        "lr": lambda seed: LinearRegression(maxIter=iters),
        "rf": lambda seed: RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed),
        "gbt": lambda seed: GBTRegressor(maxIter=params.get("boosts", 10), maxDepth=depth, seed=seed),
        "et": lambda seed: ExtraTrees(task="regression", numTrees=trees, maxDepth=depth, seed=seed),
    }
    return _pick(makers, include, exclude)


def weighted(makers: dict[str, Candidate], column: str = "weight") -> dict[str, Candidate]:
    """The same makers with rows weighted by a column of the encoded table."""
    return {n: (lambda seed, make=make: make(seed).setWeightCol(column)) for n, make in makers.items()}


def _pick(makers, include, exclude):
    for name in [*(include or []), *(exclude or [])]:
        if name not in makers:
            raise ValueError(f"unknown model family {name}")
    wanted = [n for n in makers if n not in ON_REQUEST] if include is None else include
    return {n: m for n, m in makers.items() if n in wanted and n not in (exclude or [])}


def class_probabilities(scored: DataFrame) -> Column:
    """Probability array of a scored table; one-vs-rest margins are turned into shares."""
    return probabilities("probability" if "probability" in scored.columns else None, "rawPrediction")


def group_scores(scored: DataFrame, by: list[str], task: str) -> DataFrame:
    """Metrics per group of (label, prediction) rows from one combined count or sum."""
    if task == "classification":
        counts = scored.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
        hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0).cast("long"))
        zero = F.lit(0).cast("long")

        def side(name, support, predicted, hits):
            return F.struct(name.alias("class"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits"))

        sides = counts.select(
            *by,
            F.inline(F.array(side(F.col("label"), F.col("n"), zero, hit), side(F.col("prediction"), zero, F.col("n"), zero))),
        )
        sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
        f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
        return sums.groupBy(*by).agg(
            F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
            F.avg(f1).alias("f1_macro"),
            F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")).alias("f1_weighted"),
        )
    e = F.col("label") - F.col("prediction")
    mse, spread = F.avg(e * e), F.var_pop("label")
    return scored.groupBy(*by).agg(
        (1 - F.try_divide(mse, spread)).alias("r2"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae")
    )


def more_scores(oof: DataFrame, by: list[str], metric: str) -> DataFrame:
    """One further metric per group: from labels and class probabilities, or from labels and predictions."""
    if metric == "balanced_accuracy":
        hit = (F.col("label") == F.col("prediction")).cast("double")
        recalls = oof.groupBy(*by, "label").agg(F.avg(hit).alias("recall"))
        return recalls.groupBy(*by).agg(F.avg("recall").alias(metric))
    if metric == "log_loss":
        p = F.coalesce(F.get("proba", F.col("label").cast("int")), F.lit(0.0))
        clipped = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
        return oof.groupBy(*by).agg(F.avg(-F.log(clipped)).alias(metric))
    if metric == "roc_auc":
        # Each class against the rest; of two classes the second one alone, as both give the same area.
        each = oof.select(*by, "label", F.size("proba").alias("k"), F.posexplode("proba").alias("class", "score"))
        each = each.where((F.col("k") != 2) | (F.col("class") == 1))
        own = F.col("label") == F.col("class")
        counts = each.groupBy(*by, "class", "score").agg(F.count_if(own).alias("pos"), F.count_if(~own).alias("neg"))
        return grouped_auc(counts, [*by, "class"]).groupBy(*by).agg(F.avg("auc").alias(metric))
    if metric == "mape":
        size = F.greatest(F.abs("label"), F.lit(2.0**-52))
        return oof.groupBy(*by).agg(F.avg(F.abs(F.col("label") - F.col("prediction")) / size).alias(metric))
    raise ValueError(f"unknown metric {metric}")


class TrainedModel:
    """Feature assembly, fitted estimator and label numbering; scores any table with the feature columns."""

    def __init__(self, assembly: FeatureAssembly, model, labels: CategoryIndex | None, target: str, task: str):
        self.assembly, self.model, self.labels, self.target, self.task = assembly, model, labels, target, task

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.assembly.transform(df))

    def pipeline(self, name: str = "Predictions") -> PipelineModel:
        """Assembly, estimator and label names as one fitted pipeline."""
        return PipelineModel([AssemblyStage(self.assembly), self.model, OutcomeStage(self.labels, self.target, self.task, name)])

    def save(self, path: str) -> None:
        """Write the pipeline to a folder, in place of what it held."""
        self.pipeline().write().overwrite().save(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TrainedModel":
        first, model, last = PipelineModel.read().session(spark).load(path).stages
        return cls(first.assembly, model, last.labels, last.target, last.task)

    def value(self, df: DataFrame, class_index: int = 1) -> DataFrame:
        """Adds `value`: the prediction of a regressor, the probability of one class of a classifier."""
        scored = self.score(df)
        value = F.col("prediction") if self.task == "regression" else F.get(class_probabilities(scored), F.lit(class_index))
        return scored.withColumn("value", value).select(*df.columns, "value")

    def predict(self, df: DataFrame, name: str = "Predictions") -> DataFrame:
        """The table without the target, plus the (decoded) prediction; needs no target column."""
        return apply_to(self.pipeline(name), drop_targets(df, self.target))


def encode_target(df: DataFrame, target: str, task: str) -> tuple[CategoryIndex | None, DataFrame]:
    """Adds the numeric `label`; classes are numbered 0..k-1 in sorted order."""
    clean = drop_null_target(df, target)
    if task == "regression":
        return None, clean.withColumn("label", ref(target).cast("double"))
    index = CategoryIndex.fit(clean, [target])
    numbered = index.transform(clean.withColumn("_y", ref(target)), None, "_n")
    return index, numbered.withColumn("label", F.col(f"{target}_n").cast("double")).drop(f"{target}_n", "_y")


def prepare(df: DataFrame, target: str, task: str | None, key: str, exclude=None, class_weight: str | None = None, **assembly):
    """Fitted assembly, label numbering and the encoded table (key, label, features).

    With `class_weight` "balanced" the encoded table also has the weight n / (k * n_c) of each row's class.
    """
    task = task or detect_problem_type(df, target).first()["problem_type"]
    labels, labelled = encode_target(df, target, task)
    features = FeatureAssembly.fit(
        labelled.drop("label"), target, exclude=[key, *(exclude or [])], **assembly
    )
    encoded = features.transform(labelled).select(key, "label", "features")
    if class_weight not in (None, "balanced"):
        raise ValueError("class_weight is None or 'balanced'")
    if class_weight and task == "classification":
        encoded = with_class_weight(encoded, "label")
    return task, features, labels, encoded


def candidates_for(
    task: str, labels: CategoryIndex | None, include=None, exclude=None, class_weight: str | None = None, **params
) -> dict[str, Candidate]:
    if task == "classification":
        makers = classifiers(labels.table.count(), include, exclude, **params)
        return weighted(makers) if class_weight else makers
    return regressors(include, exclude, **params)


#: Rows beyond which forests and boosted trees of regressors are grown over blocks.
MANY_ROWS = 2_000_000
#: Fits over blocks that run side by side on any table: they keep little, and one fills the waits between the levels of another.
BLOCK_FITS = 2


def fitted(estimator, table: DataFrame, rows: int, packed: blocks.Packed | None = None, without: int | None = None):
    """An estimator fitted on a table of about `rows` rows, whose blocks are in `packed` if they are shared."""
    return blocks.fit(estimator, table, rows, packed, without) if rows > MANY_ROWS else estimator.fit(table)


def fit_all(
    encoded: DataFrame, makers: dict[str, Candidate], seed: int = SEED, parallelism: int = 8, time_limit: float | None = None,
    rows: int = 0,
) -> dict[str, object]:
    """Fit every candidate; fits are submitted side by side so that small ones share the cluster. With a limit in
    seconds only the candidates fitted by then come back. `rows` says how many the table has, if they may be many."""
    packed = blocks.Packed(encoded, rows)
    jobs = {name: (lambda make=make: fitted(make(seed), encoded, rows, packed)) for name, make in makers.items()}
    try:
        return run_within(encoded.sparkSession, jobs, time_limit, parallelism)
    finally:
        packed.release()


#: Rows of a fold table that are worth a task of their own, and rows that one task may hold.
ROWS_A_TASK, MOST_ROWS_A_TASK = 5_000, 500_000


def fit_rows(encoded: DataFrame, key: str, rows: int) -> DataFrame:
    """An encoded table of at most `rows` rows for fits that keep their rows: a table beyond `MOST_ROWS_A_TASK` is dealt
    over enough tasks that each keeps no more than those, however large the parts are that it was read in."""
    if rows <= MOST_ROWS_A_TASK:
        return encoded
    tasks = max(2 * encoded.sparkSession.sparkContext.defaultParallelism, -(-rows // MOST_ROWS_A_TASK))
    return encoded.repartition(tasks, F.col(f"`{key}`"), F.col("label"))


#: Rows for each core whose fits run side by side: a tree fit keeps some 200 bytes a row as objects, and what does not
#: fit into memory is read back from disk on every level of every tree.
ROWS_A_CORE = 4_000_000


def fits_at_once(rows: int, cores: int, most: int) -> int:
    """Fits on tables of `rows` rows that run side by side: `most` on small tables, one on large ones."""
    return max(1, min(most, ROWS_A_CORE * cores // max(1, rows)))


def fold_partitions(encoded: DataFrame, rows: int | None = None) -> int:
    """Partitions for fits on a table: the session's shuffle partitions, fewer for a small table (a boosted fit is
    hundreds of jobs, each with a task a partition), though two a core, and more for a large one."""
    usual = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    rows = encoded.count() if rows is None else rows
    return max(min(usual, 2 * cores), min(usual, rows // ROWS_A_TASK), rows // MOST_ROWS_A_TASK)


def fold_table(
    encoded: DataFrame, key: str, task: str, k: int = 3, seed: int = SEED, partitions: int | None = None
) -> DataFrame:
    """The encoded table with a fold for each row, dealt over `partitions` (default: `fold_partitions`) by a hash of the
    key and cached. Many rows of a regression are dealt by the hash that their folds come from, which saves a shuffle."""
    by = "label" if task == "classification" else None
    rows = encoded.count()
    parts = partitions or fold_partitions(encoded, rows)
    if task == "regression" and over_blocks(rows, k):
        return kfold_assign(encoded, F.col(key), k, by, seed, parts).cache()
    return kfold_assign(encoded, F.col(key), k, by, seed).repartition(parts, F.col(key)).cache()


def over_blocks(rows: int, k: int) -> bool:
    """Whether fits on all folds but one of a table are many rows."""
    return rows * (k - 1) // k > MANY_ROWS


def cross_validate(
    encoded: DataFrame, key: str, makers: dict[str, Candidate], task: str, k: int = 3, seed: int = SEED, parallelism: int = 8,
    partitions: int | None = None, time_limit: float | None = None, folds: DataFrame | None = None,
) -> DataFrame:
    """Out-of-fold predictions (model, fold, key, label, prediction, proba) of every candidate.

    Rows are dealt over `partitions` (default: `fold_partitions`) by a hash of the key; tree fits
    depend on that number, as their bagging is drawn per partition. At most `parallelism` fits run side by side, fewer on
    large tables (`fits_at_once`). A caller that judges more candidates on the same
    rows gives their `fold_table` as `folds` and releases it. With a limit in seconds, candidates whose folds
    are not all fitted by then are left out; without any whole candidate `OutOfTime` is raised.
    """
    if folds is None:
        folds = fold_table(encoded, key, task, k, seed, partitions)
    limit = Budget(time_limit)
    rows, packed = folds.count(), None
    most, trained = parallelism, rows * (k - 1) // k
    parallelism = fits_at_once(rows, encoded.sparkSession.sparkContext.defaultParallelism, parallelism)
    if task == "regression" and over_blocks(rows, k):
        packed, parallelism = blocks.Packed(folds, rows), max(parallelism, min(most, BLOCK_FITS))

    def one(name: str, fold: int) -> DataFrame:
        model = fitted(makers[name](seed), folds.where(F.col("fold") != fold), trained, packed, fold)
        scored = model.transform(folds.where(F.col("fold") == fold))
        proba = class_probabilities(scored) if task == "classification" else F.array(F.col("prediction"))
        return scored.select(F.lit(name).alias("model"), "fold", key, "label", "prediction", proba.alias("proba"))

    jobs = {(name, fold): (lambda name=name, fold=fold: one(name, fold)) for name, fold in itertools.product(makers, range(k))}
    try:
        done = run_within(encoded.sparkSession, jobs, limit.left(), parallelism)
    finally:
        if packed is not None:
            packed.release()
    parts = [p for (name, _), p in done.items() if all((name, fold) in done for fold in range(k))]
    if not parts:
        raise OutOfTime(f"no candidate was fitted on all folds within {time_limit} seconds")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_leaderboard(oof: DataFrame, task: str, metric: str | None = None) -> DataFrame:
    """Candidates ranked by the mean fold score: model, mean of every metric, deviation of the ranking one, rank.

    A ranking metric beyond the usual ones (`MORE_METRICS`) becomes a column of its own.
    """
    metric = metric or DEFAULT_METRIC[task]
    if metric not in METRICS[task] + MORE_METRICS[task]:
        raise ValueError(f"unknown metric {metric} for {task}")
    per_fold, shown = group_scores(oof, ["model", "fold"], task), METRICS[task]
    if metric not in shown:
        per_fold = per_fold.join(more_scores(oof, ["model", "fold"], metric), ["model", "fold"], "left")
        shown = [*shown, metric]
    aggs = [F.avg(m).alias(m) for m in shown] + [F.coalesce(F.stddev_pop(metric), F.lit(0.0)).alias("std")]
    board = per_fold.groupBy("model").agg(*aggs)
    return _ranked(board, metric)


def _ranked(board: DataFrame, metric: str) -> DataFrame:
    """One row per candidate, so the whole board is one short list."""
    order = F.col(metric) if metric in LOSSES else -F.col(metric)
    rows = F.array_sort(F.collect_list(F.struct(F.isnull(order).alias("_n"), order.alias("_o"), *[F.col(c) for c in board.columns])))
    one = board.agg(rows.alias("rows")).select(F.posexplode("rows").alias("pos", "r"))
    return one.select((F.col("pos") + 1).cast("long").alias("rank"), "r.*").drop("_n", "_o")


def compare_models(oof: DataFrame, task: str, metric: str | None = None, n_select: int = 3) -> tuple[DataFrame, list[str]]:
    """The leaderboard and the names of the best `n_select` candidates."""
    board = cv_leaderboard(oof, task, metric).cache()
    best = [r["model"] for r in board.where(F.col("rank") <= n_select).orderBy("rank").collect()]
    return board, best


def search_size(time_limit: float | None) -> int:
    return 10 if time_limit is None or time_limit >= 300 else 5


# Values a random search draws from, per model family.
SPACE = {
    "lr": {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "nb": {},  # the Gaussian form has none
    "rf": {"numTrees": [10, 20, 40], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5, 20]},
    "gbt": {"maxIter": [5, 10, 20], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3]},
    "et": {"numTrees": [10, 20, 40], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5, 20]},
    "softmax": {"maxIter": [5, 10, 20], "maxDepth": [2, 3, 5], "stepSize": [0.1, 0.3, 0.5]},
}


def draw_settings(family: str, n_iter: int, seed: int = SEED) -> list[dict]:
    """Distinct parameter settings in seeded order; none for a family without settings."""
    if not SPACE[family]:
        return []
    grid = [dict(zip(SPACE[family], values)) for values in itertools.product(*SPACE[family].values())]
    random.Random(seed).shuffle(grid)
    return grid[:n_iter]


def tuned(maker: Candidate, values: dict) -> Candidate:
    """A maker with other settings; those of one-vs-rest go to its inner estimator."""

    def make(seed: int):
        estimator = maker(seed)
        if isinstance(estimator, OneVsRest):
            return estimator.setClassifier(estimator.getClassifier().copy().setParams(**values))
        return estimator.setParams(**values)

    return make


def search(
    encoded: DataFrame, key: str, family: str, maker: Candidate, task: str, time_limit: float | None = None, k: int = 3,
    n_iter: int | None = None, metric: str | None = None, seed: int = SEED, parallelism: int = 8,
) -> tuple[DataFrame, DataFrame, str, Candidate, dict]:
    """Out-of-fold predictions of the untuned model and of drawn settings, the board, and the winner with its maker and
    settings. Settings that are not fitted when the limit has passed are left out; the untuned model comes first."""
    settings = {f"{family}#{i}": s for i, s in enumerate(draw_settings(family, n_iter or search_size(time_limit), seed), 1)}
    makers = {f"{family}#0": maker, **{n: tuned(maker, s) for n, s in settings.items()}}
    oof = cross_validate(encoded, key, makers, task, k, seed, parallelism, time_limit=time_limit)
    # Ties go to the smaller name, and #0 is the untuned model.
    board, best = compare_models(oof, task, metric, 1)
    return oof, board, best[0], makers[best[0]], settings.get(best[0], {})


def random_search(encoded: DataFrame, key: str, family: str, maker: Candidate, task: str, *args, **options) -> tuple[DataFrame, str, dict]:
    """Cross-validated random search around one family; the untuned model is kept unless a setting beats it.

    Returns the leaderboard, the winner's name and its settings.
    """
    _, board, winner, _, settings = search(encoded, key, family, maker, task, *args, **options)
    return board, winner, settings


def topology_search(encoded: DataFrame, key: str, task: str, k: int = 3, components: int = 4, seed: int = SEED) -> DataFrame:
    """Leaderboard over (min-max | components) followed by (linear | forest)."""
    width = encoded.select(F.size(vector_to_array("features")).alias("n")).first()["n"]
    scalers = {
        "minmax": lambda: MinMaxScaler(inputCol="features", outputCol="_x"),
        "pca": lambda: PCA(k=min(components, width), inputCol="features", outputCol="_x"),
    }
    if task == "classification":
        heads = {"linear": lambda s: LogisticRegression(featuresCol="_x"), "forest": lambda s: RandomForestClassifier(featuresCol="_x", seed=s)}
    else:
        heads = {"linear": lambda s: LinearRegression(featuresCol="_x"), "forest": lambda s: RandomForestRegressor(featuresCol="_x", seed=s)}
    makers = {
        f"{a}>{b}": (lambda s, a=a, b=b: Pipeline(stages=[scalers[a](), heads[b](s)])) for a in scalers for b in heads
    }
    return cv_leaderboard(cross_validate(encoded, key, makers, task, k, seed), task)


def blend(scored: DataFrame, key: str, n_classes: int | None) -> DataFrame:
    """Soft vote: mean probability over models and its best class; for regression (n_classes None) the mean prediction."""
    if n_classes is None:
        return scored.groupBy(key).agg(F.avg("prediction").alias("prediction"))
    means = scored.groupBy(key).agg(F.array(*[F.avg(F.get("proba", F.lit(i))) for i in range(n_classes)]).alias("proba"))
    return means.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))


def weighted_ensemble(oof: DataFrame, key: str, task: str, rounds: int = 10) -> DataFrame:
    """Greedy forward selection of model weights on out-of-fold predictions, with replacement.

    Each round is one aggregation that holds the loss of adding every candidate in turn.
    """
    names = [r["model"] for r in oof.select("model").distinct().orderBy("model").collect()]
    one = oof.groupBy(key).agg(
        F.first("label").alias("label"), *[F.first(F.when(F.col("model") == m, F.col("proba")), True).alias(f"m{i}") for i, m in enumerate(names)]
    ).cache()
    picked = [0] * len(names)

    def loss(counts: list[int]) -> Column:
        total = sum(counts)
        if task == "regression":
            mean = sum((F.col(f"m{i}")[0] * c for i, c in enumerate(counts) if c), F.lit(0.0)) / total
            return F.avg((F.col("label") - mean) * (F.col("label") - mean))
        own = F.col("label").cast("int")
        mean = sum((F.get(F.col(f"m{i}"), own) * c for i, c in enumerate(counts) if c), F.lit(0.0)) / total
        return F.avg(-F.log(F.greatest(mean, F.lit(1e-15))))

    value = None
    for _ in range(rounds):
        trials = [[c + (i == j) for j, c in enumerate(picked)] for i in range(len(names))]
        row = one.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(trials)]).first()
        best = min(range(len(names)), key=lambda i: (row[f"l{i}"], i))
        picked, value = trials[best], row[f"l{best}"]
    one.unpersist()
    rows = [
        F.struct(F.lit(m).alias("model"), F.lit(picked[i] / rounds).alias("weight"), F.lit(value).alias("ensemble_loss"))
        for i, m in enumerate(names)
    ]
    return oof.sparkSession.range(1).select(F.inline(F.array(*rows)))


def label_time_share(time_limit: float, n_targets: int) -> float:
    return max(30, time_limit / n_targets)


def fit_multilabel(
    df: DataFrame, targets: list[str], key: str, family: str = "lr", exclude=None, k: int = 3, time_limit: float | None = None,
    **params,
):
    """One model per target, the other targets dropped; returns the models and (target, best_score) rows.

    With a limit, the cross-validation of each target gets its share of it.
    """
    if len(targets) < 2:
        raise ValueError("multi-label training needs at least two targets")
    models, scores = {}, None
    share = None if time_limit is None else label_time_share(time_limit, len(targets))
    for target in targets:
        own = per_label_subset(df, target, targets)
        task, assembly, labels, encoded = prepare(own, target, None, key, exclude)
        encoded = encoded.cache()
        makers = candidates_for(task, labels, [family], **params)
        board = cv_leaderboard(cross_validate(encoded, key, makers, task, k, time_limit=share), task)
        models[target] = TrainedModel(assembly, makers[family](SEED).fit(fit_rows(encoded, key, encoded.count())), labels, target, task)
        row = board.select(F.lit(target).alias("target"), F.col(DEFAULT_METRIC[task]).alias("best_score"))
        scores = row if scores is None else scores.unionByName(row)
    return models, scores


def predict_multi(models: dict[str, TrainedModel], df: DataFrame) -> DataFrame:
    """One column `Prediction_<target>` per target."""
    out = drop_targets(df, list(models))
    for target, model in models.items():
        out = model.predict(out, f"Prediction_{target}")
    return out


class Clusters:
    """k-means, the cheapest of several starts; assigns `Cluster i`."""

    def __init__(self, model, silhouette: float):
        self.model, self.silhouette = model, silhouette

    @classmethod
    def fit(cls, df: DataFrame, k: int = 4, features: str = "features", seed: int = SEED, starts: int = 4) -> "Clusters":
        points = df.select(features).cache()
        fits = [KMeans(k=k, seed=seed + i, featuresCol=features, predictionCol="_c").fit(points) for i in range(starts)]
        model = min(fits, key=lambda m: m.summary.trainingCost)
        evaluator = ClusteringEvaluator(featuresCol=features, predictionCol="_c")
        silhouette = evaluator.evaluate(model.transform(points)) if k > 1 else 0.0
        points.unpersist()
        return cls(model, silhouette)

    def assign(self, df: DataFrame, name: str = "Cluster") -> DataFrame:
        return self.model.transform(df).withColumn(name, F.concat(F.lit("Cluster "), F.col("_c").cast("string"))).drop("_c")


def rank_model(df: DataFrame, key: str, group: str, relevance: str, **params) -> tuple[TrainedModel, DataFrame]:
    """Pointwise learning to rank: regress the relevance, order inside each group by the score (ties by key)."""
    _, assembly, _, encoded = prepare(df, relevance, "regression", key, [group])
    fitted = regressors(["gbt"], **params)["gbt"](SEED).fit(fit_rows(encoded, key, df.count()))
    model = TrainedModel(assembly, fitted, None, relevance, "regression")
    scored = model.score(df).select(key, group, relevance, F.col("prediction").alias("score"))
    return model, group_rank(scored.withColumn("_down", -F.col("score")), [group], [F.col("_down"), F.col(key)], "position").drop("_down")


def fit_multimodal_table(df: DataFrame, target: str, key: str, family: str = "lr", max_features: int = 500, **params) -> TrainedModel:
    """Tabular and text columns in one vector; image columns are left out."""
    roles = {r["column"]: r["role"] for r in infer_multimodal(df, key, target).collect()}
    images = [c for c, role in roles.items() if role == "image"]
    text = [c for c in string_columns(df, [target]) if roles.get(c) == "text"]
    table = df.drop(*images)
    task, assembly, labels, encoded = prepare(table, target, None, key, text_columns=text, max_features=max_features)
    maker = candidates_for(task, labels, [family], **params)[family]
    # Kept while it is fitted, as every pass over it would split the texts into terms again.
    rows = fit_rows(encoded, key, table.count()).cache()
    try:
        fitted = maker(SEED).fit(rows)
    finally:
        rows.unpersist()
    return TrainedModel(assembly, fitted, labels, target, task)


def train(
    df: DataFrame, target: str, key: str, family: str, task: str | None = None, exclude=None, class_weight: str | None = None,
    **params,
) -> TrainedModel:
    """Prepare the table and fit one family on it, with `class_weight` "balanced" on rows weighted by their class."""
    task, assembly, labels, encoded = prepare(df, target, task, key, exclude, class_weight)
    maker = candidates_for(task, labels, [family], class_weight=class_weight, **params)[family]
    return TrainedModel(assembly, maker(SEED).fit(fit_rows(encoded, key, df.count())), labels, target, task)


def rounded_board(board: DataFrame) -> DataFrame:
    """Leaderboard with scores rounded for reports."""
    return board.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in board.dtypes])
