"""The two ends of an evaluation as whole plans: prompts out, results in."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve.operators.collapse import collapse_alerts, enrich_summary
from shotcurve.operators.grid import keyed_grid, without_done
from shotcurve.operators.joins import eval_key
from shotcurve.operators.judge import judge_prompts
from shotcurve.operators.prompts import assemble_prompts, with_prompt_parts
from shotcurve.operators.responses import attach_responses, clean_responses, to_eval_results
from shotcurve.operators.scoring import attach_grader_replies, score_results
from shotcurve.operators.summarize import summarize
from shotcurve.scratch import cut_lineage
from shotcurve.sources.tasks import TaskTables


def prompts_to_run(tasks: TaskTables, models, done: DataFrame | None = None, seed: int = 0,
                   **grid) -> DataFrame:
    """Prompts of every evaluation that is not stored yet.

    What prompts take from tasks and cases is joined to the cases, before the axes multiply
    them; no cell is moved for it, and with by_text none for the answers either."""
    selections = grid.get("selections", ("tfidf",))
    cases = with_prompt_parts(tasks.test_cases, tasks.tasks, tasks.examples, selections)
    cells = keyed_grid(cases, models, **grid)
    if done is not None:
        cells = without_done(cells, done)
    return assemble_prompts(cells, selections, seed=seed)


def prompts_to_grade(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """What a grader has to be asked: EVAL_KEY, prompt_kind and judge_prompt of every
    answered llm_judge row. Replies to it are the replies of results_of_run."""
    rows = attach_responses(prompts, clean_responses(responses))
    asked = rows.filter((F.col("scoring_method") == "llm_judge") & F.col("response_error").isNull())
    asked = judge_prompts(asked)
    return asked.select(*eval_key(asked, asked), "prompt_kind", "judge_prompt")


def results_of_run(prompts: DataFrame, responses: DataFrame, run_id: str,
                   replies: DataFrame | None = None) -> DataFrame:
    """Fact rows from prompts, responses and grader replies (EVAL_KEY columns
    plus grader_reply). Where prompts and answers have pack_id, it is part of the key."""
    rows = attach_responses(prompts, clean_responses(responses))
    if replies is not None:
        rows = attach_grader_replies(rows, replies, eval_key(rows, replies))
    return to_eval_results(score_results(rows, grader=replies is not None), run_id)


def analyse(facts: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Enriched summary and collapse alerts of scored facts."""
    summary = cut_lineage(summarize(facts, **options))
    return enrich_summary(summary, checkpoint=False), collapse_alerts(summary)
