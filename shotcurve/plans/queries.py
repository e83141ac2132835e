"""Every operator as a query over the given tables: name -> f(spark, sf_dir).

Scores are rounded to 9 digits before they meet a threshold and in the output,
because sums differ in their last bits from engine to engine. The operators
themselves do not round."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions import curves, judge, metrics, names, text
from shotcurve.functions.sql import register_sql_functions
from shotcurve.operators import (
    collapse, costs, grid, judge as judging, prompts, reports, responses, scoring, selection,
    similarity, summarize as agg)
from shotcurve.operators.joins import by_sorting
from shotcurve.plans import evaluation, keyed, tables
from shotcurve.scratch import cut_lineage, shared_folder, shuffles_removed, stored
from shotcurve.schemas import EVAL_KEY, EVAL_RESULTS, SUMMARY_KEYS
from shotcurve.sources import results, tasks
from shotcurve.streaming import ingest

DIGITS = 9
THRESHOLD = 0.5
MODELS = ["vendor/model_a", "claude-b", "lmstudio/c"]
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        metrics.stable_round(F.col(f"`{c}`"), DIGITS).alias(c) if kind == "double" else F.col(f"`{c}`")
        for c, kind in df.dtypes])


def facts_of(spark, sf):
    return tables.event_results(spark, sf)


def summary_of(spark, sf, **options):
    return agg.summarize(facts_of(spark, sf), threshold=THRESHOLD, rounding=DIGITS, **options)


def stored_summary_of(spark, sf):
    """For queries that read the summary more than once: the facts are scanned once."""
    return cut_lineage(summary_of(spark, sf))


# --- sources and sinks -----------------------------------------------------

def _packs(spark, sf):
    return tasks.parse_task_packs(tables.pack_json(spark, sf))


@query
def task_packs(spark, sf):
    p = _packs(spark, sf).packs
    return p.withColumn("categories", F.array_join("categories", "|"))


@query
def task_pack_tasks(spark, sf):
    t = _packs(spark, sf).tasks
    return t.withColumn("measures", F.array_join("measures", "|")).drop("agency_config")


@query
def task_pack_examples(spark, sf):
    return _packs(spark, sf).examples


@query
def task_pack_test_cases(spark, sf):
    c = _packs(spark, sf).test_cases
    return c.withColumn("acceptable_variations", F.array_join("acceptable_variations", "|"))


@query
def task_files(spark, sf):
    raw = tables.pack_json(spark, sf)
    key = F.col("p_partkey").cast("string")
    raw = raw.select(
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("task_pack_"), key)).otherwise(key).alias("file_name"),
        F.when(F.col("p_partkey") % 5 == 1, F.col("json")).otherwise(F.col("task_json")).alias("json"))
    t = tasks.parse_task_files(raw)
    per_task = t.test_cases.groupBy("task_id").agg(F.count(F.lit(1)).alias("num_cases"))
    return t.tasks.join(per_task, "task_id").select(
        "file_name", "task_id", "difficulty", "version", "instruction", "num_cases")


@query
def task_violations(spark, sf):
    p = tables.table(spark, sf, "part")
    return tasks.validate_tasks(p.select(
        F.col("p_partkey").cast("string").alias("task_id"),
        F.when(F.col("p_size") % 5 > 0, F.col("p_brand")).alias("category"),
        F.col("p_name").alias("description"), F.lit("easy").alias("difficulty"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Fidelity"), F.col("p_type")))
        .otherwise(F.array(F.lit("Agency"))).alias("measures")))


@query
def task_pack_catalogue(spark, sf):
    raw = tables.pack_json(spark, sf)
    broken = F.when(F.col("p_partkey") % 7 == 0, F.expr("left(json, length(json) - 3)"))
    nameless = F.when(F.col("p_partkey") % 7 == 1, F.regexp_replace("json", '"pack_name":"[^"]*",', ""))
    return tasks.catalogue_of(raw.select("file_path", F.coalesce(broken, nameless, "json").alias("json")))


@query
def tasks_needing_judge(spark, sf):
    cases = tables.turn_cases(spark, sf)
    return tasks.tasks_needing_judge(cases.withColumn(
        "scoring_method", F.when(F.col("pos") % 3 == 0, "llm_judge").otherwise("f1")))


def _result_rows(spark, sf):
    facts = facts_of(spark, sf).withColumn("run_id", F.concat(F.lit("run_"), "task_id"))
    return facts.withColumns({
        "expected_output": F.concat(F.lit('say "'), "task_id", F.lit('",\nthen stop')),
        "actual_output": F.col("input"), "scoring_method": F.lit("f1"),
        "timestamp": F.lit("2024-01-01T00:00:00")}).select(*EVAL_RESULTS.names)


@query
def results_parquet_round_trip(spark, sf):
    path = shared_folder(spark, "facts")
    results.write_results(_result_rows(spark, sf), path)
    return rounded(results.read_eval_results(spark, path))


@query
def results_csv_round_trip(spark, sf):
    path = shared_folder(spark, "facts-csv")
    results.write_run(_result_rows(spark, sf).drop("trial_id", "example_selection"), path, "all")
    return rounded(results.read_eval_results(spark, f"{path}/raw_results_all.csv", format="csv"))


@query
def summaries_combined(spark, sf):
    folder = shared_folder(spark, "summaries")
    full = stored_summary_of(spark, sf)
    old = full.filter(F.col("example_selection") == "fixed").drop(
        "example_selection", "pass_at_1", "pass_all_1", "pass_at_3", "pass_all_3")
    paths = [results.write_run(full, folder, "new", "summary"),
             results.write_run(old, folder, "old", "summary")]
    return rounded(results.read_summaries(spark, paths))


@query
def run_catalog(spark, sf):
    folder = shared_folder(spark, "runs")
    facts = _result_rows(spark, sf)
    # one run per event type, of which there is a handful
    for run in sorted(r[0] for r in facts.select("task_id").distinct().collect()):
        one = facts.filter(F.col("task_id") == run)
        results.write_run(one, folder if run != "error" else f"{folder}/demo", run)
        if run != "error":
            results.write_run(agg.usage_totals(one), folder, run, "summary")
    found = results.run_catalog(spark, folder)
    return found.select(
        "run_id", F.expr(f"substring(raw_path, {len(folder) + 2})").alias("raw_path"),
        F.expr(f"substring(summary_path, {len(folder) + 2})").alias("summary_path"))


# --- grid, selection, prompts ----------------------------------------------

def _grid(spark, sf, cases=None, **options):
    options = {"models": MODELS, "trials": 2, "selections": grid.compare_selections(), **options}
    return grid.evaluation_grid(cases if cases is not None else tables.turn_cases(spark, sf), **options)


@query
def evaluation_grid(spark, sf):
    return _grid(spark, sf, ordered=True).drop("input")


@query
def eval_key(spark, sf):
    return grid.with_eval_key(facts_of(spark, sf)).groupBy(*EVAL_KEY).agg(F.count(F.lit(1)).alias("num_rows"))


@query
def pending_evaluations(spark, sf):
    cells = _grid(spark, sf)
    done = cells.filter(F.col("pos") % 3 == 0).withColumn("actual_output", F.lit("ERROR: timeout"))
    return grid.pending_evaluations(cells, done).select(*EVAL_KEY, "pos")


@query
def available_models(spark, sf):
    models = facts_of(spark, sf).groupBy("model_name").agg(F.count(F.lit(1)).alias("num_rows"))
    checks = tables.event_results(spark, sf).groupBy("model_name").agg(
        (F.max("latency_ms") % 2 == 0).alias("success"))
    return grid.restrict_to_available(models, checks, strict=False)


@query
def resolved_shot_counts(spark, sf):
    e = tables.table(spark, sf, "events")
    return e.select("event_id", names.resolve_shot_count(
        (F.col("event_id") % 15 - 3).cast("int")).alias("shot_count"))


@query
def shot_composition(spark, sf):
    cells = _grid(spark, sf, shots=[0, 1, 2, 3, 4, 6, 8, 12])
    return grid.shot_composition(cells).groupBy("shot_count", "n_exemplars", "n_distractors").agg(
        F.count(F.lit(1)).alias("num_cells"))


def _shown(df: DataFrame) -> DataFrame:
    items = F.transform("selected", lambda e: F.concat(
        e["output"], F.when(e["is_distractor"], "*").otherwise(""), F.lit(":"), F.md5(e["input"])))
    cell = [c for c in ("task_id", "pos", "shot_count", "model_name", "trial_id") if c in df.columns]
    return df.select(*cell, F.array_join(items, "|").alias("shown"))


@query
def fixed_selection(spark, sf):
    return _shown(_fixed_cells(spark, sf))


@query
def char_ngrams(spark, sf):
    b = tables.table(spark, sf, "benchmark")
    grams = b.select("item_id", F.explode(text.char_ngrams("text")).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count(F.lit(1)).alias("tf"))


@query
def gram_counts(spark, sf):
    d = tables.table(spark, sf, "documents")
    return (similarity.gram_counts(d, ["doc_id"], "text").groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("num_grams"), F.sum("tf").alias("num_occurrences")))


def _ranking_input(spark, sf):
    cases = tables.benchmark_cases(spark, sf).select("task_id", F.col("pos").alias("case_key"), "input")
    pool = tables.example_pool(spark, sf).filter(~F.col("is_distractor"))
    return cases, pool.select("task_id", "pos", "input")


@query
def tfidf_vectors(spark, sf):
    """The weight table by text: number of grams and lengths of the vectors."""
    weights = similarity.Weights(*_ranking_input(spark, sf))
    length = lambda c: F.round(F.sqrt(c), 7).alias(c.removesuffix("_sq"))
    cases = weights.of_cases().groupBy("task_id", F.lit("case").alias("kind"), F.col("case_key").alias("id")).agg(
        F.count(F.lit(1)).alias("num_grams"), F.sum(F.pow(F.col("tf") * F.col("inside"), 2.0)).alias("inside_sq"))
    return cases.select("task_id", "kind", "id", "num_grams", length("inside_sq"), F.lit(None).cast("double").alias("outside")).unionByName(
        weights.example_lengths().filter("num_grams > 0").select(
            "task_id", F.lit("example").alias("kind"), F.col("pos").alias("id"), "num_grams", length("inside_sq"), length("outside_sq")))


@query
def tfidf_similarity(spark, sf):
    """Every case against all examples, over the weight table."""
    weights = similarity.Weights(*_ranking_input(spark, sf))
    return weights.similarities().withColumn("similarity", F.round("similarity", 7))


@query
def tfidf_topk(spark, sf):
    top = similarity.rank_by_similarity(*_ranking_input(spark, sf), k=fv.MAX_EXEMPLARS)
    return top.withColumn("similarity", F.round("similarity", 7))


@query
def tfidf_selection(spark, sf):
    cells = _grid(spark, sf, tables.benchmark_cases(spark, sf), selections=["tfidf"])
    return _shown(selection.select_examples_tfidf(
        cells, tables.example_pool(spark, sf), cases=tables.benchmark_cases(spark, sf)))


def _fixed_cells(spark, sf):
    cells = _grid(spark, sf, tables.benchmark_cases(spark, sf), selections=["fixed"])
    return selection.select_examples_fixed(cells, tables.example_pool(spark, sf))


@query
def shuffled_examples(spark, sf):
    shuffled = selection.shuffle_examples(_fixed_cells(spark, sf), seed=7)
    shown = _shown(shuffled.withColumn("pos", F.concat_ws("/", "pos", "trial_id", "model_name")))
    return shown.select("task_id", "pos", "shot_count", "shown")


@query
def examples_sections(spark, sf):
    df = prompts.render_examples_section(_fixed_cells(spark, sf))
    return df.select("task_id", "pos", "shot_count", "model_name", "trial_id", "examples_section")


def _task_texts(spark, sf):
    langs = tables.table(spark, sf, "documents").select(F.col("lang").alias("task_id")).distinct()
    return langs.select(
        "task_id", F.concat(F.lit("about "), "task_id").alias("description"),
        F.when(F.col("task_id") == "en", "answer in English").otherwise("").alias("instruction"))


@query
def prompts_by_cell(spark, sf):
    cells = _grid(spark, sf, tables.benchmark_cases(spark, sf))
    built = prompts.build_prompts(cells, _task_texts(spark, sf), tables.example_pool(spark, sf), shuffle=False,
                                  cases=tables.benchmark_cases(spark, sf))
    return built.select("task_id", "pos", "shot_count", "example_selection", "model_name", "trial_id",
                        F.length("prompt").alias("prompt_length"), F.md5("prompt").alias("prompt_md5"))


def _of_run(cells):
    return cells.withColumns({
        "run_id": F.lit("run_1"), "category": F.lit("c"), "expected_output": F.col("input"),
        "scoring_method": F.lit("f1"), "timestamp": F.lit("2024-01-01T00:00:00")})


def _cells_and_answers(spark, sf):
    """Grid cells of the user turns, and the responses to most of them, one per key: turns
    with the same text are told before the grid multiplies them."""
    cells = grid.with_eval_key(_grid(spark, sf))
    turns = tables.turn_cases(spark, sf).filter(F.col("pos") % 3 != 0)
    once = turns.withColumn("_sha", names.input_sha256("input")).dropDuplicates(["task_id", "_sha"]).drop("_sha")
    said = grid.with_eval_key(_grid(spark, sf, once)).select(
        *EVAL_KEY, F.col("input").alias("output"), (F.length("input") * 7).cast("bigint").alias("latency_ms"),
        F.length("input").cast("bigint").alias("input_tokens"), F.col("shot_count").cast("bigint").alias("output_tokens"),
        F.when(F.length("input") % 3 == 1, "timeout").alias("error"))
    return cells, said


def _answered(spark, sf):
    cells, said = _cells_and_answers(spark, sf)
    return responses.attach_responses(_of_run(cells), said)


@query
def attached_responses(spark, sf):
    return _answered(spark, sf).select(
        *EVAL_KEY, "pos", "actual_output", "response_error", "latency_ms", "input_tokens", "output_tokens")


@query
def scored_facts(spark, sf):
    """Answers that differ from the expected text, under a served name, some of
    them given twice. Cells and answers are stored by key and meet without a shuffle."""
    cells, said = _cells_and_answers(spark, sf)
    said = said.withColumns({"output": F.expr("substring(output, 11)"), "served_model": F.lit("served/m")})
    again = said.filter(F.col("error").isNull()).withColumns(
        {"output": F.lit(None).cast("string"), "error": F.lit("again")})
    with keyed.KeyedTables(spark) as tables_by_key:
        cells = tables_by_key.store(cells.select(*EVAL_KEY, "input"), "cells")
        said = tables_by_key.store(said.unionByName(again), "answers")
        answered = responses.attach_responses(_of_run(cells), said, tables_by_key.order)
        facts = responses.to_eval_results(scoring.score_results(answered)).drop("input", "expected_output")
        return stored(rounded(facts), "facts")


@query
def grading_prompts(spark, sf):
    cases = tables.judge_cases(spark, sf).withColumns({
        "task_id": F.col("p_partkey").cast("string"), "model_name": F.lit("gpt-m"), "shot_count": F.lit(0), "trial_id": F.lit(1),
        "input_sha256": F.sha2("expected_output", 256), "example_selection": F.lit("fixed")})
    said = cases.filter(F.col("p_partkey") % 5 != 0).select(*EVAL_KEY, F.col("actual_output").alias("output"))
    asked = evaluation.prompts_to_grade(cases.drop("actual_output", "grader_reply"), said)
    return asked.select("task_id", "prompt_kind", F.md5("judge_prompt").alias("prompt_md5"))


@query
def cleaned_responses(spark, sf):
    return responses.clean_responses(tables.raw_responses(spark, sf))


@query
def providers(spark, sf):
    return grid.assign_provider(tables.raw_responses(spark, sf).drop("output"))


# --- text scoring ----------------------------------------------------------

@query
def markdown_removed(spark, sf):
    p = tables.part_pairs(spark, sf)
    return p.select("p_partkey", text.remove_markdown("actual_output").alias("actual_output"),
                    text.remove_markdown("expected_output").alias("expected_output"))


@query
def normalized_documents(spark, sf):
    d = tables.table(spark, sf, "documents").withColumn("norm", text.normalize_text("text"))
    return d.select("doc_id", F.length("norm").alias("norm_length"), F.md5("norm").alias("norm_md5"))


def _all_pairs(spark, sf):
    short = tables.part_pairs(spark, sf).withColumn("id", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    turns = tables.conversation_pairs(spark, sf).withColumn(
        "id", F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    cols = ["id", "expected_output", "actual_output"]
    return short.select(*cols).unionByName(turns.select(*cols))


@query
def score_exact(spark, sf):
    return scoring.score_exact_match(_all_pairs(spark, sf)).select("id", "score")


@query
def score_contains(spark, sf):
    return scoring.score_contains(_all_pairs(spark, sf)).select("id", "score")


@query
def char_type_runs(spark, sf):
    return _all_pairs(spark, sf).select(
        "id", F.array_join(text.char_type_runs("actual_output"), "|").alias("runs"))


@query
def tokens(spark, sf):
    df = scoring.with_normalized(_all_pairs(spark, sf))
    return df.select("id", F.array_join(text.tokenize("norm_expected"), "|").alias("tokens"))


@query
def score_f1(spark, sf):
    return rounded(scoring.score_f1(_all_pairs(spark, sf)).select("id", "score"))


@query
def score_dispatch(spark, sf):
    cases = tables.judge_cases(spark, sf).unionByName(
        tables.part_pairs(spark, sf).withColumn("scoring_method", F.when(
            F.col("p_partkey") % 5 == 0, "exact_match").when(F.col("p_partkey") % 5 == 1, "contains")
            .when(F.col("p_partkey") % 5 == 2, "f1").when(F.col("p_partkey") % 5 == 3, "custom:x")
            .otherwise("rouge")),
        allowMissingColumns=True).fillna({"expected_is_rubric": False})
    rubric_by_text = tables.judge_cases(spark, sf).withColumn("scoring_method", F.lit("f1"))
    scored = scoring.score_results(cases.unionByName(rubric_by_text))
    return rounded(scored.select("p_partkey", "scoring_method", "expected_is_rubric", "score", "score_error"))


@query
def judge_prompt_kinds(spark, sf):
    return judging.with_prompt_kind(tables.judge_cases(spark, sf)).select("p_partkey", "prompt_kind")


def _prompts_of_kind(spark, sf, kind, build):
    df = judging.with_prompt_kind(tables.judge_cases(spark, sf)).filter(F.col("prompt_kind") == kind)
    return build(df).select("p_partkey", "judge_prompt")


@query
def keyword_judge_prompts(spark, sf):
    return _prompts_of_kind(spark, sf, "keyword", judging.keyword_judge_prompts)


@query
def natural_judge_prompts(spark, sf):
    return _prompts_of_kind(spark, sf, "natural", judging.natural_judge_prompts)


@query
def rubric_judge_prompts(spark, sf):
    return _prompts_of_kind(spark, sf, "rubric", judging.rubric_judge_prompts)


@query
def judge_prompts(spark, sf):
    df = judging.judge_prompts(tables.judge_cases(spark, sf))
    return df.select("p_partkey", "prompt_kind", F.md5("judge_prompt").alias("prompt_md5"))


@query
def judge_replies(spark, sf):
    return rounded(judging.parse_judge_replies(tables.grader_replies(spark, sf)).drop("reply"))


@query
def clamped_scores(spark, sf):
    e = tables.table(spark, sf, "events")
    return rounded(e.select("event_id", text.clamp01(F.col("value") / 20 - 0.2).alias("score")))


@query
def judge_fallback(spark, sf):
    scored = scoring.judge_with_fallback(tables.judge_cases(spark, sf))
    return rounded(scored.select("p_partkey", "score", "reason"))


@query
def expected_texts(spark, sf):
    return tables.judge_cases(spark, sf).select("p_partkey", judge.expected_to_text(
        F.regexp_replace("expected_output", ': ', ':'), "expected_is_rubric").alias("expected_output"))


# --- aggregation -----------------------------------------------------------

@query
def trial_means(spark, sf):
    return rounded(agg.trial_means(agg.with_fact_defaults(facts_of(spark, sf))))


def _points(spark, sf, method):
    trials = agg.trial_means(agg.with_fact_defaults(facts_of(spark, sf)))
    return rounded(agg.aggregate_trials(trials, method=method, threshold=THRESHOLD).select(
        *SUMMARY_KEYS, "shot_count", "score", "num_trials"))


@query
def trials_mean(spark, sf):
    return _points(spark, sf, "mean")


@query
def trials_median(spark, sf):
    return _points(spark, sf, "median")


@query
def curve_pivot(spark, sf):
    trials = agg.trial_means(agg.with_fact_defaults(facts_of(spark, sf)))
    return rounded(agg.curve_pivot(agg.aggregate_trials(trials)))


@query
def usage_totals(spark, sf):
    return agg.usage_totals(facts_of(spark, sf))


@query
def improvement_rates(spark, sf):
    return rounded(summary_of(spark, sf).select(*SUMMARY_KEYS, metrics.improvement_rate().alias("improvement_rate")))


@query
def threshold_shots(spark, sf):
    return summary_of(spark, sf).select(*SUMMARY_KEYS, metrics.threshold_shots(0.25).alias("threshold_shots"))


@query
def learning_curve_aucs(spark, sf):
    return rounded(summary_of(spark, sf).select(*SUMMARY_KEYS, metrics.learning_curve_auc().alias("learning_curve_auc")))


@query
def efficiency_metrics(spark, sf):
    df = summary_of(spark, sf).select(*SUMMARY_KEYS, *metrics.SCORE_COLUMNS)
    return rounded(df.withColumns(metrics.efficiency_metrics(0.3)))


@query
def score_variance(spark, sf):
    return rounded(summary_of(spark, sf).select(*SUMMARY_KEYS, "score_variance"))


@query
def pass_probabilities(spark, sf):
    e = tables.table(spark, sf, "events")
    n = (F.col("event_id") % 11).cast("int")
    c = F.least(n, (F.col("user_id") % 9).cast("int"))
    cols = [metrics.pass_at_k(n, c, k).alias(f"pass_at_{k}") for k in (1, 3, 5)]
    cols += [metrics.pass_all_k(n, c, k).alias(f"pass_all_{k}") for k in (1, 3, 5)]
    return rounded(e.select("event_id", *cols))


@query
def reliability_metrics(spark, sf):
    facts = facts_of(spark, sf).withColumn("score", F.floor(F.col("score") * 100) / 100)
    return rounded(agg.reliability_metrics(facts, threshold=0.3))


@query
def summarize_mean(spark, sf):
    return rounded(summary_of(spark, sf))


@query
def summarize_median(spark, sf):
    return rounded(summary_of(spark, sf, aggregation="median"))


@query
def summarize_single_trial(spark, sf):
    facts = facts_of(spark, sf).filter(F.col("trial_id") == 2)
    return rounded(agg.summarize(facts, threshold=THRESHOLD, rounding=DIGITS))


@query
def summarize_lineitem(spark, sf):
    return rounded(agg.summarize(tables.lineitem_results(spark, sf), rounding=DIGITS))


@query
def trial_std(spark, sf):
    return rounded(agg.trial_std(facts_of(spark, sf), "click"))


def _priced(spark, sf):
    e = tables.table(spark, sf, "events")
    listed = F.array(*map(F.lit, tables.PRICED_MODELS))
    usage = e.select(
        "event_id", F.element_at(listed, (F.col("user_id") % 16 + 1).cast("int")).alias("model_name"),
        (F.col("event_id") % 5000 - 10).alias("input_tokens"), F.col("user_id").alias("output_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("score"))
    return costs.price_usage(usage)


@query
def priced_usage(spark, sf):
    return _priced(spark, sf).select("event_id", "model_name", "input_price", "output_price", "usage_error")


@query
def cost_economy(spark, sf):
    costed = costs.with_cost(_priced(spark, sf), time_price=0.0001)
    return costed.select("event_id", metrics.stable_round("total_cost", DIGITS).alias("total_cost"),
                         F.round("economy_score", 4).alias("economy_score"),
                         "usage_error")


@query
def adaptation_index(spark, sf):
    facts = facts_of(spark, sf)
    score = F.col("score")
    axes = facts.select(
        "model_name",
        F.when(F.col("task_id") == "click", score).alias("axis_Acquisition"),
        F.when(F.col("task_id") == "view", score).alias("axis_Resilience_Noise"),
        F.when((F.col("task_id") == "error") & (F.col("model_name") != "vendor/model_3"), score)
        .alias("axis_Efficiency"),
        F.lit(None).cast("double").alias("axis_Agency"))
    return rounded(collapse.adaptation_index(axes))


# --- curve analysis --------------------------------------------------------

def _gappy(spark, sf):
    """Summary whose zero scores are missing, so curves differ in length."""
    s = summary_of(spark, sf)
    return s.withColumns({c: F.when(F.col(c) < 0.07, F.lit(None)).otherwise(F.col(c))
                          for c in metrics.SCORE_COLUMNS})


@query
def shot_series(spark, sf):
    s = _gappy(spark, sf)
    return s.select(*SUMMARY_KEYS, F.array_join(F.transform(
        curves.shot_series(s.columns), lambda p: p["shot"].cast("string")), ",").alias("shots"))


@query
def few_shot_collapse(spark, sf):
    return rounded(collapse.detect_few_shot_collapse(summary_of(spark, sf)))


@query
def few_shot_collapse_at_four_shots(spark, sf):
    return rounded(collapse.detect_few_shot_collapse(summary_of(spark, sf).drop("score_8shot")))


@query
def peak_regression(spark, sf):
    return rounded(collapse.detect_peak_regression(summary_of(spark, sf)))


@query
def mid_curve_dip(spark, sf):
    return rounded(collapse.detect_mid_curve_dip(summary_of(spark, sf)))


@query
def mid_curve_dip_with_gaps(spark, sf):
    return rounded(collapse.detect_mid_curve_dip(_gappy(spark, sf)))


@query
def collapse_pattern(spark, sf):
    return collapse.classify_collapse(_gappy(spark, sf)).drop("scores")


@query
def resilience(spark, sf):
    return rounded(collapse.resilience_score(summary_of(spark, sf)))


@query
def enriched_summary(spark, sf):
    return rounded(collapse.enrich_summary(_gappy(spark, sf)).select(
        *SUMMARY_KEYS, "learning_curve_auc", "collapse_pattern", "resilience_score"))


@query
def enriched_runs(spark, sf):
    """Several runs in one table, the selection missing where it is the default one."""
    s = summary_of(spark, sf)
    fixed = F.col("example_selection") == "fixed"
    runs = s.withColumn("run_id", F.lit("run_2")).filter(F.col("task_id") != "view").unionByName(s).withColumn(
        "example_selection", F.when(~fixed, F.col("example_selection")))
    return rounded(collapse.enrich_summary(runs).select(
        *SUMMARY_KEYS, "collapse_pattern", "resilience_score"))


@query
def curve_long(spark, sf):
    return rounded(collapse.curve_long(summary_of(spark, sf)))


@query
def drop_intervals(spark, sf):
    return rounded(collapse.drop_intervals(summary_of(spark, sf)))


@query
def alerts(spark, sf):
    return rounded(collapse.collapse_alerts(summary_of(spark, sf)))


@query
def labelled_alerts(spark, sf):
    found = collapse.detect_few_shot_collapse(
        summary_of(spark, sf), label=lambda task, category: F.concat_ws("/", category, task))
    return rounded(found.select("model", "task_id", "example_selection", "task_label", "drop_pct"))


@query
def mapped_alert_labels(spark, sf):
    mapping = tables.table(spark, sf, "events").filter(F.col("event_type") != "view").select(
        F.col("event_type").alias("task_id"), F.upper("event_type").alias("label")).distinct()
    found = collapse.label_from(mapping, collapse.detect_few_shot_collapse(summary_of(spark, sf), ordered=False))
    return found.select("model", "task_id", "example_selection", "task_label")


# --- reports ---------------------------------------------------------------

@query
def short_model_names(spark, sf):
    return facts_of(spark, sf).groupBy("model_name").agg(F.count(F.lit(1)).alias("num_rows")).withColumn(
        "short_name", names.short_model_name("model_name"))


@query
def metrics_table(spark, sf):
    return rounded(reports.metrics_table(stored_summary_of(spark, sf)))


@query
def filtered_selection(spark, sf):
    facts = facts_of(spark, sf).withColumn(
        "example_selection", F.when(F.col("output_tokens") % 2 == 0, F.col("example_selection")))
    return reports.filter_selection(facts, "fixed").groupBy("task_id", "example_selection").agg(
        F.count(F.lit(1)).alias("num_rows"))


@query
def run_overview(spark, sf):
    overview = reports.run_overview(summary_of(spark, sf), facts_of(spark, sf))
    return overview.withColumn("selections", F.array_join("selections", ", "))


@query
def learning_curve_table(spark, sf):
    return rounded(reports.learning_curve_table(summary_of(spark, sf)))


@query
def leaderboard(spark, sf):
    return rounded(reports.resilience_leaderboard(stored_summary_of(spark, sf)))


@query
def pattern_table(spark, sf):
    return reports.pattern_table(stored_summary_of(spark, sf))


@query
def alert_labels(spark, sf):
    found = collapse.detect_peak_regression(summary_of(spark, sf), ordered=False)
    return found.select("task_id", reports.alert_label(several=True).alias("label"),
                        reports.alert_label().alias("short_label"))


# --- streaming, SQL functions, whole plans ---------------------------------

@query
def stream_ingest(spark, sf):
    """events.parquet as a file stream of facts, de-duplicated by key into a sink."""
    schema = tables.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    facts = tables.results_from_events(stream)
    sink, state = shared_folder(spark, "sink"), shared_folder(spark, "state")
    for _ in range(2):  # the second start finds everything done
        ingest.ingest_results_stream(facts, sink, state).awaitTermination()
    return spark.read.parquet(sink).drop(ingest.BATCH).withColumn("score", F.round("score", 9))


@query
def sql_functions(spark, sf):
    register_sql_functions(spark)
    summary_of(spark, sf).createOrReplaceTempView("curve_summary")
    scores = ", ".join(metrics.SCORE_COLUMNS)
    return spark.sql(f"""
        SELECT model, task_id, example_selection, round(auc + 1e-12D, 9) AS learning_curve_auc,
               reached AS threshold_shots, round(gain + 1e-12D, 9) AS improvement_rate,
               resolve_shot_count(reached + 4) AS nearest_shot,
               round(pass_at_k(10, reached + 1, 3) + 1e-12D, 9) AS chance
        FROM (SELECT short_model_name(model_name) AS model, task_id, example_selection,
                     learning_curve_auc({scores}) AS auc, threshold_shots({scores}, 0.25D) AS reached,
                     improvement_rate(score_0shot, score_8shot) AS gain
              FROM curve_summary)""")


@query
def whole_evaluation(spark, sf):
    """Pack JSON -> grid -> prompts -> responses -> scores -> summary. One model leaves
    its four-shot prompts unanswered; others answer under a served name, after a failure."""
    with keyed.by_text(spark), shuffles_removed(spark):
        return stored(_whole_evaluation(spark, sf), "whole-evaluation")


def _whole_evaluation(spark, sf):
    """Cells and answers are dealt out by task and text before the axes multiply them, and
    meet where they are."""
    packs = _packs(spark, sf).parsed()
    axes = {"trials": 2, "selections": grid.compare_selections()}
    axes["partitions"] = keyed.grid_partitions(
        packs.test_cases, len(MODELS) * len(fv.SHOTS) * axes["trials"] * len(axes["selections"]))
    built = evaluation.prompts_to_run(packs, MODELS, **axes)
    # texts of one task that are equal are told, and answered, before the axes multiply them
    once = packs.test_cases.withColumn("_sha", names.input_sha256("input")).dropDuplicates(["task_id", "_sha"])
    expected = packs.test_cases.filter(~F.col("expected_is_rubric")).select(
        F.col("task_id").alias("task"), F.col("input").alias("case"), F.col("expected_output").alias("answer"))
    once = once.select("task_id", "input").join(
        by_sorting(expected), (F.col("task_id") == F.col("task")) & (F.col("input") == F.col("case")), "left")
    said = grid.keyed_grid(once.select("task_id", "input", "answer"), MODELS, **axes).filter(
        (F.col("model_name") != MODELS[1]) | (F.col("shot_count") != 4)).select(*EVAL_KEY, F.when(
        F.col("shot_count") > 0, F.coalesce("answer", F.lit("?"))).otherwise(F.lit("?")).alias("output"))
    replies = said.select(*EVAL_KEY, F.concat(
        F.lit('{"score": 0.'), F.col("shot_count").cast("string"), F.lit("}")).alias("grader_reply"))
    answers = said.select("*", F.lit("served/m").alias("served_model"), F.explode(
        F.array(F.lit(None).cast("string"), F.lit("timeout"))).alias("error"))
    facts = evaluation.results_of_run(built, answers, "run_w", replies)
    return rounded(facts.groupBy("category", "model_name", "shot_count", "scoring_method", "example_selection").agg(
        F.count(F.lit(1)).alias("num_rows"), F.avg("score").alias("mean_score")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts -> learning curves -> collapse pattern and resilience per curve."""
    return rounded(collapse.enrich_summary(summary_of(spark, sf_dir)))
