"""The evaluation grid, its keys and what is left of it to do."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.names import (
    api_model_name, input_sha256, provider, resolve_shot_count)
from shotcurve.operators.joins import by_sorting, eval_key

GRID_ORDER = ["selection_pos", "trial_id", "model_pos", "task_pos", "shot_pos", "pos"]


def _ordinals(values: Sequence, value: str, pos: str) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(i).alias(pos), F.lit(v).alias(value)) for i, v in enumerate(values)])
    ).alias(pos, value)


def evaluation_grid(test_cases: DataFrame, models: Sequence[str], shots: Sequence[int] = tuple(fv.SHOTS),
                    trials: int = 1, selections: Sequence[str] = ("tfidf",),
                    ordered: bool = False) -> DataFrame:
    """Every test case for every selection, trial, model and shot.

    The other axes are short configured lists, so each test case expands in
    place, without a join. The cases, few against the grid, are spread over
    all partitions first, so that the grid is built and worked on in parallel
    even when they come from one small file. ordered sorts by selection,
    trial, model, task, shot and test case."""
    test_cases = _checked(test_cases, models, shots, trials, selections)
    spread = [c for c in ("pack_id", "task_id", "pos", "input") if c in test_cases.columns]
    return _expanded(test_cases, spread, None, models, shots, trials, selections, ordered)


def keyed_grid(test_cases: DataFrame, models: Sequence[str], shots: Sequence[int] = tuple(fv.SHOTS),
               trials: int = 1, selections: Sequence[str] = ("tfidf",), ordered: bool = False,
               partitions: int | None = None) -> DataFrame:
    """evaluation_grid with the columns of EVAL_KEY. Each text is hashed once, and the cases are
    dealt out by task and text before they expand: all cells of a text are in one partition,
    so that, within keyed.by_text, grids of as many partitions meet by the whole key as they are."""
    test_cases = _checked(test_cases, models, shots, trials, selections).withColumn("input_sha256", input_sha256("input"))
    return _expanded(test_cases, ["task_id", "input_sha256"], partitions, models, shots, trials, selections, ordered)


def _checked(test_cases: DataFrame, models, shots, trials, selections) -> DataFrame:
    unknown = [s for s in selections if s not in fv.SELECTIONS]
    if unknown:
        raise ValueError(f"unknown example selection: {unknown}")
    if not models or not shots or trials < 1 or not selections:
        raise ValueError("models, shots, trials and selections must not be empty")
    if "task_pos" not in test_cases.columns:
        test_cases = test_cases.withColumn("task_pos", F.lit(0))
    return test_cases


def _expanded(test_cases: DataFrame, by: list[str], partitions: int | None, models, shots, trials, selections,
              ordered: bool) -> DataFrame:
    partitions = partitions or int(test_cases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    test_cases = test_cases.repartition(partitions, *by)
    grid = test_cases.select("*", _ordinals(selections, "example_selection", "selection_pos"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(trials))).alias("trial_id"))
    grid = grid.select("*", _ordinals(models, "model_name", "model_pos"))
    grid = grid.select("*", _ordinals(shots, "shot_count", "shot_pos"))
    return grid.orderBy(*GRID_ORDER) if ordered else grid


def compare_selections() -> list[str]:
    """Selections of a comparison run, in run order."""
    return list(fv.SELECTIONS)


def with_eval_key(df: DataFrame) -> DataFrame:
    """Add input_sha256; with it the columns of EVAL_KEY identify an evaluation
    within a run."""
    cols = {"input_sha256": input_sha256("input")}
    if "trial_id" not in df.columns:
        cols["trial_id"] = F.lit(1)
    cols["example_selection"] = (
        F.coalesce("example_selection", F.lit(fv.DEFAULT_SELECTION))
        if "example_selection" in df.columns else F.lit(fv.DEFAULT_SELECTION))
    return df.withColumns(cols)


def pending_evaluations(grid: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Grid rows whose key is not stored yet. Stored error rows count as done
    unless retry_errors."""
    return without_done(with_eval_key(grid), done, retry_errors)


def without_done(cells: DataFrame, done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """pending_evaluations of a grid that has its keys."""
    if retry_errors:
        done = done.filter(~F.coalesce(F.col("actual_output").startswith(fv.ERROR_PREFIX), F.lit(False)))
    key = eval_key(cells, done)
    keys = with_eval_key(done).select(*key).distinct()
    return cells.join(by_sorting(keys), key, "left_anti")


def restrict_to_available(models: DataFrame, availability: DataFrame, strict: bool = True) -> DataFrame:
    """Models whose check succeeded, in input order if models has pos. Fails
    when none is left, unless not strict."""
    up = availability.filter(F.col("success")).select("model_name").distinct()
    left = models.join(up, "model_name", "left_semi")
    if strict and left.isEmpty():
        raise ValueError("no model is available")
    return left.orderBy("pos") if "pos" in models.columns else left


def shot_composition(df: DataFrame) -> DataFrame:
    """Add n_exemplars and n_distractors of each row's (nearest) shot count."""
    exemplars, distractors = F, F
    for shot, (n_e, n_d) in fv.SHOT_COMPOSITION.items():
        exemplars = exemplars.when(F.col("_shot") == shot, F.lit(n_e))
        distractors = distractors.when(F.col("_shot") == shot, F.lit(n_d))
    return (
        df.withColumn("_shot", resolve_shot_count("shot_count"))
        .withColumns({"n_exemplars": exemplars, "n_distractors": distractors})
        .drop("_shot"))


def assign_provider(models: DataFrame) -> DataFrame:
    """Add provider and api_model_name."""
    return models.withColumns({"provider": provider("model_name"),
                               "api_model_name": api_model_name("model_name")})
