"""Choosing the examples a prompt shows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.names import input_sha256
from shotcurve.operators.grid import shot_composition
from shotcurve.operators.joins import by_count, by_sorting, join_by_task, task_key, task_parts
from shotcurve.operators.similarity import rank_by_similarity
from shotcurve.schemas import TASK_KEY

SELECTED = "array<struct<input:string,output:string,is_distractor:boolean>>"


def _entry(is_distractor: bool) -> Column:
    return F.struct(F.col("rank"), F.col("input"), F.col("output"),
                    F.lit(is_distractor).alias("is_distractor"))


def _without_rank(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda e: F.struct(
        e["input"].alias("input"), e["output"].alias("output"),
        e["is_distractor"].alias("is_distractor")))


def _task_of(df: DataFrame) -> list[str]:
    return [c for c in TASK_KEY if c in df.columns]


def first_examples(examples: DataFrame) -> DataFrame:
    """Per task the first exemplars and distractors in file order, as many as
    the largest shot count can show: columns exemplars and distractors.

    Positions are ranked without their texts; the texts of the few chosen ones
    come back by key."""
    task = _task_of(examples)
    key = [*task, "is_distractor", "pos"]
    order = Window.partitionBy(*task, "is_distractor").orderBy("pos")
    most = F.when(F.col("is_distractor"), fv.MAX_DISTRACTORS).otherwise(fv.MAX_EXEMPLARS)
    chosen = (
        examples.select(*key).withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= max(fv.MAX_EXEMPLARS, fv.MAX_DISTRACTORS))
        .filter(F.col("rank") <= most))
    top = examples.select(*key, "input", "output").join(by_count(chosen, "first-examples"), key)
    return top.groupBy(*task).agg(
        _without_rank(F.collect_list(F.when(~F.col("is_distractor"), _entry(False)))).alias("exemplars"),
        _without_rank(F.collect_list(F.when(F.col("is_distractor"), _entry(True)))).alias("distractors"))


def ranked_examples(cases: DataFrame, examples: DataFrame, k: int = fv.MAX_EXEMPLARS,
                    **options) -> DataFrame:
    """Per distinct task and input the k most similar exemplars, best first:
    the task's key, case_key, ranked."""
    exemplars = examples.filter(~F.col("is_distractor"))
    task = task_key(cases, examples)
    distinct = (
        cases.select(*task, "input").distinct()
        .withColumn("case_key", input_sha256("input")))
    ranks = by_count(rank_by_similarity(distinct, exemplars, k, **options), "ranks")
    chosen = exemplars.select(*task, "pos", "input", "output").join(ranks, [*task, "pos"])
    return chosen.groupBy(*task, "case_key").agg(
        _without_rank(F.collect_list(_entry(False))).alias("ranked"))


def shuffle_examples(df: DataFrame, seed: int = 0, keys: list[str] | None = None,
                     items: str = "selected") -> DataFrame:
    """Reorder each row's examples by a hash of seed, row key and example: the
    same seed gives the same order on any cluster, different rows differ."""
    keys = keys if keys is not None else [
        c for c in ("task_id", "input", "shot_count", "trial_id", "model_name", "example_selection")
        if c in df.columns]
    row = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys])
    marked = F.transform(F.col(items), lambda e, i: F.struct(
        F.md5(F.concat_ws("|", F.col("_row"), i.cast("string"))).alias("mark"), e.alias("e")))
    return (
        df.withColumn("_row", row)
        .withColumn(items, F.transform(F.array_sort(marked), lambda m: m["e"]))
        .drop("_row"))


def _composition(grid: DataFrame) -> DataFrame:
    return grid if "n_exemplars" in grid.columns else shot_composition(grid)


def _fixed_choice() -> Column:
    empty = F.array().cast(SELECTED)
    return F.concat(
        F.coalesce(F.slice("exemplars", F.lit(1), F.col("n_exemplars")), empty),
        F.coalesce(F.slice("distractors", F.lit(1), F.col("n_distractors")), empty))


def _similar_choice() -> Column:
    empty = F.array().cast(SELECTED)
    return F.when(F.size("ranked") > 0, F.concat(
        F.slice("ranked", F.lit(1), F.col("n_exemplars")),
        F.coalesce(F.slice("distractors", F.lit(1), F.col("n_distractors")), empty))).otherwise(empty)


def select_examples_fixed(grid: DataFrame, examples: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Add selected: the first exemplars, then the first distractors."""
    return (
        join_by_task(_composition(grid), first_examples(examples), parts or task_parts(grid))
        .withColumn("selected", _fixed_choice()).drop("exemplars", "distractors"))


def select_examples_tfidf(grid: DataFrame, examples: DataFrame, cases: DataFrame | None = None,
                          **options) -> DataFrame:
    """Add selected: the exemplars most similar to the input, then the first
    distractors. A task without exemplars gets nothing. Similarity is worked
    out once per task and input, not per shot, model or trial; cases (task
    and input), if known, are read in place of the expanded grid."""
    ranked = ranked_examples(grid if cases is None else cases, examples, **options)
    keyed = _composition(grid).withColumn("case_key", input_sha256("input"))
    return (
        join_by_task(keyed.join(by_sorting(ranked), [*task_key(keyed, ranked), "case_key"], "left"),
                     first_examples(examples).drop("exemplars"), task_parts(grid))
        .withColumn("selected", _similar_choice())
        .drop("ranked", "distractors", "case_key"))


def select_examples(grid: DataFrame, examples: DataFrame, selections=tuple(fv.SELECTIONS),
                    cases: DataFrame | None = None, parts: DataFrame | None = None, **options) -> DataFrame:
    """Add selected by each row's example_selection. tfidf rows with an empty
    input fall back to fixed. selections, if known, names those that occur, so
    that a fixed-only grid skips the similarity job; cases as in
    select_examples_tfidf; parts are the grid's task_parts, if known."""
    if cases is None and "tfidf" in selections:
        cases = grid.filter(F.col("example_selection") == "tfidf")
    return chosen_examples(with_choices(grid, examples, selections, cases, parts, **options), selections)


def with_choices(rows: DataFrame, examples: DataFrame, selections=tuple(fv.SELECTIONS),
                 cases: DataFrame | None = None, parts: DataFrame | None = None, **options) -> DataFrame:
    """Add what a task or case can be shown: exemplars, distractors and, for tfidf, ranked.
    rows are cells or, before the grid multiplies them, cases; cases are those to be ranked,
    by default rows."""
    parts = parts or task_parts(rows)
    if "tfidf" not in selections:
        return join_by_task(rows, first_examples(examples), parts)
    asked = (rows if cases is None else cases).filter(F.col("input") != "")
    ranked = ranked_examples(asked, examples, **options)
    keyed = rows.withColumn("case_key", input_sha256("input"))
    return join_by_task(keyed, first_examples(examples), parts).join(
        by_sorting(ranked), [*task_key(keyed, ranked), "case_key"], "left").drop("case_key")


def chosen_examples(cells: DataFrame, selections=tuple(fv.SELECTIONS)) -> DataFrame:
    """Cells with_choices -> cells with selected, by each row's example_selection."""
    cells = _composition(cells)
    if "tfidf" not in selections:
        return cells.withColumn("selected", _fixed_choice()).drop("exemplars", "distractors")
    by_similarity = (F.col("example_selection") == "tfidf") & (F.col("input") != "")
    return cells.withColumn("selected", F.when(by_similarity, _similar_choice()).otherwise(_fixed_choice())).drop(
        "ranked", "exemplars", "distractors")
