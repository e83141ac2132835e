"""Report-shaped projections over summaries and facts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.metrics import SCORE_COLUMNS
from shotcurve.functions.names import short_model_name
from shotcurve.operators.collapse import classify_collapse, resilience_score


def has_several_selections(df: DataFrame) -> bool:
    """Whether more than one selection occurs; a one-column job that looks at
    distinct values only until it has two."""
    if "example_selection" not in df.columns:
        return False
    return len(df.select("example_selection").dropna().distinct().take(2)) > 1


def metrics_table(summary: DataFrame, several: bool | None = None) -> DataFrame:
    """The summary's existing metric columns in display order, short model names."""
    if several is None:
        several = has_several_selections(summary)
    names = ["model_name", "task_id", "category"]
    if several:
        names.append("example_selection")
    names += SCORE_COLUMNS
    names += ["improvement_rate", "threshold_shots", "learning_curve_auc",
              "num_trials", "score_variance"]
    names += sorted(c for c in summary.columns if c.startswith("pass_"))
    titles = {"model_name": "Model", "task_id": "Task", "category": "Category"}
    return summary.select(*[
        (short_model_name(c) if c == "model_name" else F.col(c)).alias(titles.get(c, c))
        for c in names if c in summary.columns])


def filter_selection(df: DataFrame, selection: str = "all") -> DataFrame:
    """Rows of one selection, or all; a NULL selection counts as fixed. Frames
    without the column pass through."""
    if "example_selection" not in df.columns:
        return df
    df = df.withColumn("example_selection",
                       F.coalesce("example_selection", F.lit(fv.DEFAULT_SELECTION)))
    return df if selection == "all" else df.filter(F.col("example_selection") == selection)


def run_overview(summary: DataFrame, facts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct tasks and models, trials, selections, number of facts."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    sel = (F.coalesce("example_selection", F.lit(fv.DEFAULT_SELECTION))
           if "example_selection" in summary.columns else F.lit(fv.DEFAULT_SELECTION))
    trials = F.max("num_trials") if "num_trials" in summary.columns else F.lit(None).cast("int")
    left = summary.agg(
        distinct("task_id").alias("num_tasks"),
        distinct("model_name").alias("num_models"),
        trials.alias("num_trials"),
        F.array_sort(F.collect_set(sel)).alias("selections"))
    right = facts.agg(F.count(F.lit(1)).alias("num_results"))
    names = ["num_tasks", "num_models", "num_trials", "selections", "num_results"]
    return left.unionByName(right, allowMissingColumns=True).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in names])


def learning_curve_table(summary: DataFrame, ordered: bool = True) -> DataFrame:
    """Task, model, the five scores and the area under the curve."""
    sel = [c for c in ["example_selection"] if c in summary.columns]
    table = summary.select("task_id", "model_name", *sel, *SCORE_COLUMNS, "learning_curve_auc")
    return table.orderBy("task_id", "model_name", *sel) if ordered else table


def resilience_leaderboard(summary: DataFrame, several: bool | None = None) -> DataFrame:
    """Models by resilience, best first, within each selection if there are several."""
    if several is None:
        several = has_several_selections(summary)
    board = resilience_score(summary, per_selection=several)
    sel = ["example_selection"] if several else []
    return (
        board.select(short_model_name("model_name").alias("model"), *sel, "resilience_score")
        .orderBy(*sel, F.desc("resilience_score"), "model"))


def pattern_table(summary: DataFrame, several: bool | None = None) -> DataFrame:
    """Short model name, task, selection if there are several, and pattern."""
    if several is None:
        several = has_several_selections(summary)
    sel = ["example_selection"] if several else []
    return classify_collapse(summary).select(
        short_model_name("model").alias("model"), "task_id", *sel, "pattern")


def alert_label(model="model", selection="example_selection", several: bool = False) -> Column:
    """Short model name, followed by [selection] if there are several."""
    short = short_model_name(model)
    if not several:
        return short
    sel = F.coalesce(F.col(selection), F.lit(fv.DEFAULT_SELECTION))
    return F.concat(short, F.lit(" ["), sel, F.lit("]"))
