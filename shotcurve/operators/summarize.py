"""Scored facts -> trial means -> learning-curve points -> one summary row per key.

Three chained hash aggregates, each with map-side combine, so a key holding a
large share of the facts shrinks to its trial means before anything moves.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.metrics import (
    efficiency_metrics, pass_all_k, pass_at_k, score_column, stable_round)
from shotcurve.schemas import SUMMARY_KEYS
from shotcurve.scratch import stored

USAGE = ["input_tokens", "output_tokens", "latency_ms"]


def with_fact_defaults(facts: DataFrame) -> DataFrame:
    """Add trial_id 1 and selection 'fixed' where the columns are absent, turn
    NaN scores into NULL and drop rows with a NULL group key."""
    return _with_defaults(facts).dropna(subset=SUMMARY_KEYS)


def _with_defaults(facts: DataFrame) -> DataFrame:
    cols = {}
    if "trial_id" not in facts.columns:
        cols["trial_id"] = F.lit(1)
    if "example_selection" not in facts.columns:
        cols["example_selection"] = F.lit(fv.DEFAULT_SELECTION)
    cols["score"] = F.nanvl(F.col("score").cast("double"), F.lit(None))
    return facts.withColumns(cols)


def count_trials(facts: DataFrame) -> DataFrame:
    """Distinct trial ids of each run: run_id, num_trials."""
    trial = F.col("trial_id") if "trial_id" in facts.columns else F.lit(1)
    return facts.groupBy("run_id").agg(F.count_distinct(trial).cast("int").alias("num_trials"))


def trial_means(facts: DataFrame, keys=None, usage: bool = False) -> DataFrame:
    """Mean score per key, shot and trial; test cases weigh the same."""
    keys = keys or SUMMARY_KEYS
    aggs = [F.avg("score").alias("trial_mean")]
    if usage:
        aggs += [F.sum(c).alias(f"total_{c}") for c in USAGE]
    return facts.groupBy(*keys, "shot_count", "trial_id").agg(*aggs)


def _median_share(trials: DataFrame, group: list[str]) -> DataFrame:
    # Rank of every trial mean inside its curve point. A sort that can spill
    # does the work, and the middle one or two ranks carry the median.
    by_value = Window.partitionBy(*group).orderBy(F.col("trial_mean").asc_nulls_last())
    whole = Window.partitionBy(*group)
    rank = F.row_number().over(by_value)
    n = F.count("trial_mean").over(whole)
    middle = (rank == F.floor((n + 1) / 2)) | (rank == F.floor((n + 2) / 2))
    return trials.withColumn("median_share", F.when(middle, F.col("trial_mean")))


def aggregate_trials(trials: DataFrame, keys=None, method: str = "mean",
                     threshold: float = fv.SUCCESS_THRESHOLD, usage: bool = False) -> DataFrame:
    """One row per key and shot: score (mean, or median on request; any other
    name means mean), population variance, number of trials and of successes.

    A trial without any valid score makes its point NULL."""
    keys = keys or SUMMARY_KEYS
    group = [*keys, "shot_count"]
    mean = F.col("trial_mean")
    centre = F.avg("trial_mean")
    if method == "median":
        trials = _median_share(trials, group)
        centre = F.avg("median_share")
    counted = F.col("trial_id").isNotNull()
    n = F.count_if(counted)
    valid = F.count_if(counted & mean.isNotNull()) == n
    aggs = [
        F.when(valid, centre).alias("score"),
        F.when(valid, F.var_pop("trial_mean")).alias("score_variance"),
        n.alias("num_trials"),
        F.count_if(mean >= threshold).alias("num_successes"),
    ]
    if usage:
        aggs += [F.sum(f"total_{c}").alias(f"total_{c}") for c in USAGE]
    return trials.groupBy(*group).agg(*aggs)


def reliability_columns(k_values=None) -> dict[str, Column]:
    cols = {}
    for k in k_values or fv.K_VALUES:
        cols[f"pass_at_{k}"] = pass_at_k("num_trials", "num_successes", k)
        cols[f"pass_all_{k}"] = pass_all_k("num_trials", "num_successes", k)
    return cols


def reliability_metrics(facts: DataFrame, threshold: float = fv.SUCCESS_THRESHOLD,
                        k_values=None, keys=None) -> DataFrame:
    """Per key and shot: trials, mean, variance, pass@k and pass^k."""
    keys = keys or SUMMARY_KEYS
    points = aggregate_trials(trial_means(with_fact_defaults(facts), keys), keys, "mean", threshold)
    return (points.withColumns(reliability_columns(k_values))
            .withColumnRenamed("score", "score_mean"))


def curve_pivot(points: DataFrame, keys=None, extra: list[Column] | None = None) -> DataFrame:
    """Points -> one row per key with a score column per scheduled shot. A shot
    without rows scores 0.0; other shots are ignored."""
    keys = keys or SUMMARY_KEYS
    aggs = []
    for s in fv.SHOTS:
        here = F.col("shot_count") == s
        aggs.append(
            F.when(F.count_if(here) == 0, F.lit(0.0))
            .otherwise(F.max(F.when(here, F.col("score"))))
            .alias(score_column(s)))
    return points.groupBy(*keys).agg(*aggs, *(extra or []))


def usage_totals(facts: DataFrame, keys=None) -> DataFrame:
    """Token and latency sums per key over all rows, scheduled shot or not."""
    keys = keys or SUMMARY_KEYS
    return with_fact_defaults(facts).groupBy(*keys).agg(
        *[F.sum(c).cast("bigint").alias(f"total_{c}") for c in USAGE])


def summarize(facts: DataFrame, aggregation: str = "mean",
              threshold: float = fv.SUCCESS_THRESHOLD, pass_at_k: bool = True,
              k_values=None, num_trials: int | None = None,
              rounding: int | None = None) -> DataFrame:
    """One row per run, task, category, model and selection: the curve, its
    efficiency metrics, usage totals and reliability.

    num_trials is the distinct trial count of each run. Left out, it is counted
    on the stored trial means, because the pass_* columns exist only when some
    run has several (they are NULL for runs with one); the facts are scanned
    once. rounding, off by default, rounds scores before they are compared with
    thresholds.
    """
    k_values = k_values or fv.K_VALUES
    trials = trial_means(_with_defaults(facts), usage=True)
    counts, most = None, num_trials
    if num_trials is None:
        trials = stored(trials, "trial-means")
        counts = stored(count_trials(trials), "run-trials")
        most = counts.agg(F.max("num_trials")).first()[0] or 0
    multi = most > 1 and pass_at_k
    trials = trials.dropna(subset=SUMMARY_KEYS)
    if rounding is not None:
        trials = trials.withColumn("trial_mean", stable_round("trial_mean", rounding))
    points = aggregate_trials(trials, method=aggregation, threshold=threshold, usage=True)
    if rounding is not None:
        points = points.withColumn("score", stable_round("score", rounding))

    extra = [F.sum(f"total_{c}").cast("bigint").alias(f"total_{c}") for c in USAGE]
    scheduled = F.col("shot_count").isin(fv.SHOTS)
    if multi:
        points = points.withColumns(reliability_columns(k_values))
        names = list(reliability_columns(k_values))
        known = F.count_if(scheduled & F.col("score_variance").isNull()) == 0
        extra.append(F.when(known, F.coalesce(
            F.avg(F.when(scheduled, F.col("score_variance"))), F.lit(0.0))).alias("score_variance"))
        extra += [F.coalesce(F.avg(F.when(scheduled, F.col(c))), F.lit(0.0)).alias(c) for c in names]
    else:
        names = []
        extra.append(F.lit(0.0).alias("score_variance"))

    summary = curve_pivot(points, extra=extra).withColumns(efficiency_metrics(threshold))
    if counts is None:
        summary = summary.withColumn("num_trials", F.lit(num_trials))
    else:
        summary = summary.join(counts, "run_id").withColumns(
            {c: F.when(F.col("num_trials") > 1, F.col(c)) for c in names})
    return summary.select(
        *SUMMARY_KEYS, *[score_column(s) for s in fv.SHOTS],
        "improvement_rate", "threshold_shots", "learning_curve_auc", "num_trials",
        *[f"total_{c}" for c in USAGE], "score_variance", *names)


def trial_std(facts: DataFrame, task_id: str, shots=None) -> DataFrame:
    """Sample standard deviation of trial means per model and shot of one task.

    Empty when the whole input has a single trial; NULL for a cell with one
    trial. Selections are not told apart."""
    shots = shots or fv.SHOTS
    if "trial_id" not in facts.columns:
        facts = facts.withColumn("trial_id", F.lit(1))
    several = facts.agg(F.count_distinct("trial_id")).scalar() > 1
    group = ["model_name", "shot_count"]
    score = F.nanvl(F.col("score").cast("double"), F.lit(None))
    return (
        facts.filter((F.col("task_id") == task_id) & F.col("shot_count").isin(shots) & several)
        .filter(F.col("trial_id").isNotNull() & F.col("model_name").isNotNull())
        .groupBy(*group, "trial_id").agg(F.avg(score).alias("trial_mean"))
        .groupBy(*group).agg(F.stddev_samp("trial_mean").alias("std"))
    )
