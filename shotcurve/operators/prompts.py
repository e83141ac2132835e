"""Prompt tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.operators.joins import join_by_task, one_per_key, task_parts
from shotcurve.operators.selection import chosen_examples, shuffle_examples, with_choices
from shotcurve.schemas import TASK_KEY

UNKNOWN_TASK = "task is not listed"

LABELS = {
    "opening": fv.PROMPT_OPENING, "task": fv.PROMPT_TASK, "examples": fv.PROMPT_EXAMPLES,
    "turn": fv.PROMPT_TURN, "input": fv.PROMPT_INPUT, "output": fv.PROMPT_OUTPUT,
    "cue": fv.PROMPT_CUE,
}


def examples_section(items="selected", labels: dict | None = None) -> Column:
    """Header, then one input and one output line per example, a blank line
    between examples; '' without examples."""
    labels = {**LABELS, **(labels or {})}
    blocks = F.transform(items, lambda e: F.concat(
        F.lit(labels["input"]), e["input"], F.lit("\n" + labels["output"]), e["output"]))
    body = F.concat(F.lit(labels["examples"] + "\n"), F.concat_ws("\n\n", blocks))
    return F.when(F.size(F.col(items)) > 0, body).otherwise(F.lit(""))


def render_examples_section(df: DataFrame, labels: dict | None = None) -> DataFrame:
    return df.withColumn("examples_section", examples_section("selected", labels))


def prompt_text(labels: dict | None = None) -> Column:
    """Prompt from instruction, description, examples_section and input."""
    labels = {**LABELS, **(labels or {})}
    task = F.coalesce(F.nullif("instruction", F.lit("")), F.col("description"))
    section = F.col("examples_section")
    return F.concat(
        F.lit(labels["opening"] + "\n\n" + labels["task"]), task,
        F.when(section != "", F.concat(F.lit("\n\n"), section)).otherwise(F.lit("")),
        F.lit("\n\n" + labels["turn"] + "\n" + labels["input"]), F.col("input"),
        F.lit("\n" + labels["cue"]))


def build_prompts(grid: DataFrame, tasks: DataFrame, examples: DataFrame, shuffle: bool = True,
                  seed: int = 0, labels: dict | None = None, **options) -> DataFrame:
    """Add prompt to every grid row: select, shuffle, render, assemble.

    Tasks of several packs are told apart where grid, tasks and examples have
    pack_id. A row whose task is not listed stays, with prompt_error and a NULL
    prompt; of a task listed several times the smallest texts are used."""
    selections = options.pop("selections", tuple(fv.SELECTIONS))
    if options.get("cases") is None and "tfidf" in selections:
        options["cases"] = grid.filter(F.col("example_selection") == "tfidf")
    return assemble_prompts(with_prompt_parts(grid, tasks, examples, selections, **options), selections, shuffle, seed, labels)


def with_prompt_parts(rows: DataFrame, tasks: DataFrame, examples: DataFrame,
                      selections=tuple(fv.SELECTIONS), **options) -> DataFrame:
    """Add all that prompts take from task and case: with_choices, and the task's texts. rows
    are cells or, few against them, the cases that a grid is then made of."""
    parts = task_parts(rows)
    df = with_choices(rows, examples, selections, parts=parts, **options)
    key = [c for c in TASK_KEY if c in tasks.columns and c in rows.columns]
    texts = one_per_key(tasks.select(*key, "description", "instruction"), key).withColumn("listed", F.lit(True))
    return join_by_task(df, texts, parts)


def assemble_prompts(cells: DataFrame, selections=tuple(fv.SELECTIONS), shuffle: bool = True, seed: int = 0,
                     labels: dict | None = None) -> DataFrame:
    """Cells with_prompt_parts -> cells with prompt, row by row: select, shuffle, render, assemble."""
    df = chosen_examples(cells, selections)
    if shuffle:
        df = shuffle_examples(df, seed)
    return (
        render_examples_section(df, labels)
        .withColumn("prompt_error", F.when(F.col("listed").isNull(), F.lit(UNKNOWN_TASK)))
        .withColumn("prompt", F.when(F.col("prompt_error").isNull(), prompt_text(labels)))
        .drop("listed", "description", "instruction", "examples_section", "selected",
              "n_exemplars", "n_distractors"))
