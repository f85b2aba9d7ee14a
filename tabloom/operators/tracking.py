"""Experiment runs as tables: search, comparison, leaderboards, versions, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tabloom.functions.columns import long_rows, ref
from tabloom.functions.fixed import HIGHER_IS_BETTER, METRIC_PRIORITY
from tabloom.operators.ranks import dense_index, join_lookup


#: Columns that a run table may have.
MAX_NAMES = 5_000


def search_runs(entries: DataFrame, experiment: str, names: list[str] | None = None) -> DataFrame:
    """One row per run of an experiment with columns `params.*` and `metrics.*`, the latest value of each.

    `entries` is the long table (run_id, experiment, kind, key, value, ts). An unknown experiment gives an
    empty table. One shuffle: every column is its own conditional `max_by`.
    """
    own = entries.where(F.col("experiment") == experiment).withColumn(
        "_name", F.concat(F.col("kind"), F.lit("s."), F.col("key"))
    )
    if names is None:
        found = own.select("_name").distinct().limit(MAX_NAMES + 1).collect()
        if len(found) > MAX_NAMES:
            raise ValueError(f"more than {MAX_NAMES} parameters and metrics; say which ones are wanted")
        names = sorted(r["_name"] for r in found)
    values = []
    for n in names:
        mine = F.col("_name") == n
        latest = F.max_by("value", F.when(mine, F.col("ts")))
        values.append((latest.try_cast("double") if n.startswith("metrics.") else latest).alias(n))
    if not values:
        return own.select("run_id").distinct()
    return own.groupBy("run_id").agg(*values)


def compare_runs(runs: DataFrame, selected: DataFrame) -> DataFrame:
    """Metric columns of the selected runs, prefix stripped."""
    metrics = [c for c in runs.columns if c.startswith("metrics.")]
    kept = runs.join(selected.select("run_id"), "run_id", "left_semi")
    return kept.select("run_id", *[ref(c).alias(c.removeprefix("metrics.")) for c in metrics])


def compare_runs_long(runs: DataFrame, selected: DataFrame) -> DataFrame:
    wide = compare_runs(runs, selected)
    metrics = [c for c in wide.columns if c != "run_id"]
    return wide.unpivot("run_id", metrics, "metric", "value")


def better_first(metric: str, column: Column) -> Column:
    """Sort key of a metric: descending for scores, ascending for losses; missing values last."""
    return F.desc_nulls_last(column) if metric in HIGHER_IS_BETTER else F.asc_nulls_last(column)


def leaderboard(runs: DataFrame, metric: str, value: str, by: list[str], tie: str, k: int | None = 5) -> DataFrame:
    """Runs per experiment ranked by a metric, ties by name; the top k, or the whole board with k=None.

    The top k is a limited window (cut to k rows per experiment before the shuffle); a whole board is
    ranked over range partitions, so one large experiment does not land in one task.
    """
    order = [F.isnull(F.col(value)), F.col(value) if metric not in HIGHER_IS_BETTER else -F.col(value), F.col(tie)]
    if k is None:
        keyed = runs.withColumns({"_o0": order[0], "_o1": order[1]})
        return dense_index(keyed, by, [F.col("_o0"), F.col("_o1"), F.col(tie)], "rank").drop("_o0", "_o1")
    w = W.partitionBy(*by).orderBy(better_first(metric, F.col(value)), tie)
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def best_metric(board: DataFrame, by: str, rank: str, metrics: list[str], experiments: DataFrame | None = None) -> DataFrame:
    """Score of each board's best row: the first metric present by priority, else (or at 0.0) the first metric column.

    `metrics` are the board's metric columns in order; an experiment without any model scores 0.0.
    """
    top = board.groupBy(by).agg(
        F.min_by(F.struct(*[ref(m).alias(m) for m in metrics]), rank).alias("top"), F.count("*").alias("n_models")
    )
    lower = {m.lower(): m for m in metrics}
    ranked = [lower[m] for m in METRIC_PRIORITY if m in lower]
    name = F.coalesce(*[F.when(F.col("top")[m].isNotNull(), F.lit(m)) for m in ranked], F.lit("none"))
    score = F.coalesce(*[F.col("top")[m] for m in ranked], F.lit(0.0))
    first = F.col("top")[metrics[0]]
    fallback = (F.col("score") == 0.0) & first.isNotNull()
    found = top.select(by, "n_models", "top", name.alias("name"), score.alias("score")).select(
        by,
        "n_models",
        F.when(fallback, F.lit(metrics[0])).otherwise(F.col("name")).alias("best_metric_name"),
        F.when(fallback, first).otherwise(F.col("score")).alias("best_model_score"),
    )
    if experiments is None:
        return found
    joined = experiments.select(by).distinct().join(found, by, "left")
    return joined.select(
        by,
        F.coalesce("n_models", F.lit(0).cast("long")).alias("n_models"),
        F.coalesce("best_metric_name", F.lit("none")).alias("best_metric_name"),
        F.coalesce("best_model_score", F.lit(0.0)).alias("best_model_score"),
    )


def run_details(entries: DataFrame, run_id: str) -> DataFrame:
    """Latest parameters and metrics of one run; metrics rounded to six digits."""
    own = entries.where(F.col("run_id") == run_id)
    latest = own.groupBy("kind", "key").agg(F.max_by("value", "ts").alias("value"))
    number = F.round(F.col("value").try_cast("double"), 6)
    return latest.select(
        "kind", "key",
        F.when(F.col("kind") == "param", F.col("value")).alias("text"),
        F.when(F.col("kind") == "metric", number).alias("number"),
    )


def status_counts(runs: DataFrame) -> DataFrame:
    names = ["running", "completed", "failed", "cancelled"]
    counted = runs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    return long_rows(counted, [F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in names])


def elapsed_text(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.format_string("%dm %02ds", F.floor(whole / 60).cast("long"), whole % 60)


def list_runs(runs: DataFrame, now: Column | None = None) -> DataFrame:
    """Newest first, with the elapsed time of finished runs (of running ones up to `now`)."""
    end = F.coalesce("finished_at", now if now is not None else F.lit(None).cast("timestamp_ntz"))
    seconds = F.timestamp_diff("SECOND", F.col("started_at"), end)
    return runs.withColumn("elapsed", elapsed_text(seconds)).orderBy(F.desc("started_at"), "run_id")


def drop_malformed(runs: DataFrame, metadata: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a metadata row, rows without one)."""
    keys = metadata.select(key)
    return runs.join(keys, key, "left_semi"), runs.join(keys, key, "left_anti")


def register_versions(new: DataFrame, existing: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Next versions per model name in registration order, after the highest existing version."""
    highest = existing.groupBy(F.col(name).alias("_name")).agg(F.max("version").alias("_highest"))
    numbered = dense_index(new, [name], [F.col(c) for c in order], "_n")
    joined = join_lookup(numbered, highest, F.col(name) == F.col("_name"), "left")
    version = F.coalesce("_highest", F.lit(0).cast("long")) + F.col("_n")
    return joined.withColumn("version", version).drop("_n", "_name", "_highest")


def lineage(runs: DataFrame, manifest: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Short fingerprints of the train, validation and test tables of each run, one row per role.

    The roles are unfolded first, so the manifest is joined once; a table that most runs used is spread over tasks.
    """
    used = runs.select(
        "run_id", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), ref(c).alias("name")) for r, c in roles.items()]))
    ).where(F.col("name").isNotNull())
    prints = manifest.select("name", F.substring("fingerprint", 1, 8).alias("short8"))
    return join_lookup(used, prints, "name", "left").select("run_id", "role", "name", F.coalesce("short8", F.lit("unknown")).alias("short8"))
