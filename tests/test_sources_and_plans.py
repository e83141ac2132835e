import json
import os

import pytest
from pyspark.sql import functions as F

from shotcurve.operators import grid, prompts, responses
from shotcurve.plans import evaluation, keyed
from shotcurve.schemas import EVAL_KEY, EVAL_RESULTS
from shotcurve.sources import results, tasks
from shotcurve.streaming import ingest


def task(task_id, **more):
    return {"task_id": task_id, "category": "c", "description": "describe", "difficulty": "easy",
            "examples": [{"input": f"i{k}", "output": f"o{k}"} for k in range(3)],
            "test_cases": [{"input": "q", "expected_output": "o0", "scoring_method": "exact_match"},
                           {"input": "r", "expected_output": {"b": 1, "a": ["é"]}, "scoring_method": "llm_judge",
                            "acceptable_variations": ["v"]}], **more}


PACK = {"pack_id": "p", "pack_name": "P", "description": "d", "version": "2", "categories": ["c"],
        "tasks": [task("t1", distractors=[{"input": "x", "output": "y"}], instruction="do it"),
                  task("t0", measures=[], agency_config={"steps": 2})]}


@pytest.fixture
def folder(tmp_path):
    files = {"task_pack_a.json": PACK, "task_pack_b.json": {"pack_id": "only"}, "task_pack_c.json": {"x": 1},
             "b.json": task("b"), "a.json": task("a", version="3"), "other.json": {"pack_id": "z", "tasks": []}}
    for name, data in files.items():
        (tmp_path / name).write_text(json.dumps(data, ensure_ascii=False, indent=1))
    (tmp_path / "task_pack_broken.json").write_text("{")
    return str(tmp_path)


def test_packs(spark, folder):
    t = tasks.read_task_packs(spark, f"{folder}/task_pack_a.json")
    assert t.packs.first()["task_count"] == 2
    by_id = {r["task_id"]: r for r in t.tasks.collect()}
    assert (by_id["t1"]["version"], by_id["t1"]["measures"], by_id["t1"]["instruction"]) == ("1.0", ["Acquisition"], "do it")
    assert by_id["t0"]["measures"] == [] and json.loads(by_id["t0"]["agency_config"]) == {"steps": 2}
    assert t.examples.filter("is_distractor").count() == 1 and t.examples.count() == 7
    cases = {(r["task_id"], r["pos"]): r for r in t.test_cases.collect()}
    assert cases["t1", 0]["expected_output"] == "o0" and not cases["t1", 0]["expected_is_rubric"]
    assert cases["t1", 1]["expected_output"] == '{"b": 1, "a": ["é"]}' and cases["t1", 1]["expected_is_rubric"]
    assert [r["task_id"] for r in tasks.tasks_needing_judge(t.test_cases).collect()] == ["t1", "t0"]


def test_incomplete_packs_fail_or_are_skipped(spark, folder):
    with pytest.raises(Exception, match="required field missing: pack_name"):
        tasks.read_task_packs(spark, f"{folder}/task_pack_b.json").packs.collect()
    loose = tasks.read_task_packs(spark, f"{folder}/task_pack_*.json", strict=False)
    assert [r["pack_id"] for r in loose.packs.collect()] == ["p"]
    bad = spark.createDataFrame([(json.dumps({**PACK, "tasks": [task("t", measures=["Nope"])]}),)], "json string")
    with pytest.raises(Exception, match="invalid measure: Nope"):
        tasks.parse_task_packs(bad).tasks.collect()


def test_task_files_and_catalogue(spark, folder):
    t = tasks.read_task_files(spark, folder)
    assert [(r["file_name"], r["version"]) for r in t.tasks.collect()] == [("a.json", "3"), ("b.json", "1.0")]
    with pytest.raises(Exception):
        tasks.read_task_files(spark, folder + "/none")
    rows = tasks.list_task_packs(spark, folder).collect()
    assert [(r["pack_id"], r["pack_name"], r["task_count"]) for r in rows] == [("p", "P", 2), ("only", "only", 0)]
    assert rows[0]["file_path"] == f"{folder}/task_pack_a.json"
    assert tasks.list_task_packs(spark, folder + "/none").count() == 0


def fact(spark, n=6, **over):
    rows = [("r1" if i % 3 else "r2", f"t{i % 2}", "c", "m", 1, f'line "{i}",\nnext', "e", "a", 0.5, "f1", 7, "2024-01-01T00:00:00", 2, 1, 1, "tfidf")
            for i in range(n)]
    return spark.createDataFrame(rows, EVAL_RESULTS).withColumns({k: F.lit(v) for k, v in over.items()})


def test_results_files(spark, tmp_path):
    out = str(tmp_path / "facts")
    results.write_results(fact(spark), out)
    results.write_results(fact(spark).filter("run_id = 'r1'").limit(1), out)  # replaces r1 only
    back = results.read_eval_results(spark, out)
    assert back.schema.names == EVAL_RESULTS.names
    assert back.filter("run_id = 'r2'").count() == 2 and back.filter("run_id = 'r1'").count() == 1
    assert results.read_eval_results(spark, str(tmp_path / "none")).count() == 0
    assert results.read_eval_results(spark, str(tmp_path / "none"), format="csv").count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert results.read_eval_results(spark, str(tmp_path / "empty.csv"), format="csv").schema.names == EVAL_RESULTS.names
    path = results.write_run(fact(spark).drop("trial_id", "example_selection").withColumn("extra", F.lit(1)), str(tmp_path), "x")
    row = results.read_eval_results(spark, path, format="csv").orderBy("input").first()
    assert (row["trial_id"], row["example_selection"], row["input"]) == (1, "fixed", 'line "0",\nnext')


def test_catalog_and_summaries(spark, tmp_path):
    (tmp_path / "demo").mkdir()
    (tmp_path / "deeper" / "demo").mkdir(parents=True)
    for p in ("raw_results_1.csv", "summary_1.csv", "raw_results_2.csv", "demo/raw_results_9.csv", "deeper/demo/raw_results_3.csv"):
        (tmp_path / p).write_text("run_id,score_0shot,pass_at_1\n1,0.5,1\n" if "summary" in p else "x\n")
    got = [(r["run_id"], os.path.basename(r["summary_path"] or "-")) for r in results.run_catalog(spark, str(tmp_path)).collect()]
    assert got == [("2", "-"), ("1", "summary_1.csv"), ("9", "-")]
    (tmp_path / "summary_o.csv").write_text("run_id,score_0shot,collapse_pattern\n2,0.25,stable\n")
    both = results.read_summaries(spark, [str(tmp_path / "summary_1.csv"), str(tmp_path / "summary_o.csv")])
    assert sorted((r["run_id"], r["score_0shot"], r["pass_at_1"], r["collapse_pattern"]) for r in both.collect()) == [
        ("1", 0.5, 1.0, None), ("2", 0.25, None, "stable")]


def test_resume_counts_errors_as_done(spark):
    cells = grid.evaluation_grid(spark.createDataFrame([("t", 0, "q"), ("t", 1, "r")], "task_id string, pos int, input string"),
                                 ["a", "b"], shots=[0, 1], trials=2, selections=["fixed"], ordered=True)
    rows = cells.collect()
    assert len(rows) == 16
    assert [(r["trial_id"], r["model_name"], r["shot_count"], r["pos"]) for r in rows[:3]] == [(1, "a", 0, 0), (1, "a", 0, 1), (1, "a", 1, 0)]
    done = cells.limit(5).withColumn("actual_output", F.lit("ERROR: x"))
    assert grid.pending_evaluations(cells, done).count() == 11
    assert grid.pending_evaluations(cells, done, retry_errors=True).count() == 16
    assert grid.pending_evaluations(cells, done.drop("example_selection")).count() == 11
    with pytest.raises(ValueError):
        grid.evaluation_grid(cells, ["a"], selections=["random"])


def test_availability_keeps_order(spark):
    models = spark.createDataFrame([(i, m) for i, m in enumerate("cabd")], "pos int, model_name string")
    checks = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "model_name string, success boolean")
    assert [r["model_name"] for r in grid.restrict_to_available(models, checks).collect()] == ["c", "a"]
    with pytest.raises(ValueError):
        grid.restrict_to_available(models, checks.filter("false"))


def test_prompt_text(spark):
    df = spark.createDataFrame(
        [("", "desc", "q", [("i1", "o1", False), ("i2", "o2", True)]), ("instr", "desc", "q", [])],
        "instruction string, description string, input string, selected array<struct<input:string,output:string,is_distractor:boolean>>")
    got = [r[0] for r in prompts.render_examples_section(df).select(prompts.prompt_text()).collect()]
    assert got == [
        "以下のタスクを実行してください。\n\n【タスク】desc\n\n【例】\n入力: i1\n出力: o1\n\n入力: i2\n出力: o2\n\n【あなたの番】\n入力: q\n出力:",
        "以下のタスクを実行してください。\n\n【タスク】instr\n\n【あなたの番】\n入力: q\n出力:"]


def test_response_cleaning(spark):
    rows = [("lmstudio/x", "<think>a</think>\n yes "), ("lmstudio/x", " <think>a</think> "), ("gpt-x", "<think>a</think>"),
            ("claude-x", " <think>a</think> no"), ("other", None)]
    df = spark.createDataFrame(rows, "model_name string, output string")
    assert [r["output"] for r in responses.clean_responses(df).collect()] == ["yes", "<think>a</think>", "", "<think>a</think> no", None]


def test_run_from_pack_to_facts(spark, folder):
    packs = tasks.read_task_packs(spark, f"{folder}/task_pack_a.json")
    built = evaluation.prompts_to_run(packs, ["m1", "lmstudio/m2"], trials=1, selections=["fixed", "tfidf"])
    assert built.count() == 2 * 2 * 2 * 5 * 2
    said = built.filter("shot_count > 0").select(*EVAL_KEY, F.lit(" o0 ").alias("output"), F.lit(5).alias("latency_ms"))
    got = evaluation.results_of_run(built, said, "run").collect()
    assert len(got) == 80
    for r in got:
        if r["shot_count"] == 0:
            assert (r["actual_output"], r["score"], r["latency_ms"]) == ("ERROR: no response", 0.0, 0)
        elif r["scoring_method"] == "exact_match":
            assert (r["actual_output"], r["score"], r["latency_ms"]) == ("o0", 1.0, 5)
        else:  # a judge task without a grader is an error row
            assert r["actual_output"].startswith("ERROR: grader_client") and r["score"] == 0.0
    enriched, alerts = evaluation.analyse(spark.createDataFrame(got, EVAL_RESULTS))
    assert enriched.count() == 8 and alerts.count() == 0


def test_stream_drops_duplicates_across_files_and_restarts(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    fact(spark, 6).write.parquet(source)

    def run():
        ingest.ingest_results_stream(ingest.read_results_stream(spark, source), sink, state).awaitTermination()
    run()
    fact(spark, 9).write.mode("append").parquet(source)  # six known rows, three new ones
    run()
    run()
    stored = spark.read.parquet(sink)
    assert stored.count() == 9 and stored.select(*ingest.KEY).distinct().count() == 9
    ingest.append_new(fact(spark, 9), sink)  # a repeated batch
    assert spark.read.parquet(sink).count() == 9


def test_stream_reads_nothing_of_the_sink(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    read = []
    for i in range(4):
        # ever the same six facts with another answer, and one new
        fact(spark, 6, actual_output=f"{9 - i}").unionByName(fact(spark, 1, task_id=f"new {i}")).coalesce(1).write.mode("append").parquet(source)
        query = ingest.ingest_results_stream(ingest.read_results_stream(spark, source), sink, state)
        query.awaitTermination()
        read += [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        rows = spark.read.parquet(sink)
        assert rows.count() == (7 if i == 0 else 1)
        assert {r.actual_output for r in rows.filter("task_id not like 'new%'").collect()} <= {"9"}
        (tmp_path / "out").rename(tmp_path / f"away {i}")  # the state alone knows the keys
    assert read == [7, 7, 7, 7]


def test_repeated_batch_replaces_itself_and_the_first_row_survives(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    both = fact(spark, 6, actual_output="b").unionByName(fact(spark, 6, actual_output="a"))
    both.repartition(5).write.parquet(source)
    ingest.ingest_results_stream(ingest.read_results_stream(spark, source), sink, state).awaitTermination()
    rows = spark.read.parquet(sink)
    assert rows.count() == 6 and {r.actual_output for r in rows.collect()} == {"a"}
    again = rows.drop(ingest.BATCH)
    saved = spark.createDataFrame(again.collect(), again.schema).withColumn("_new", F.lit(True))
    ingest.write_batch(saved, 0, sink)
    assert spark.read.parquet(sink).count() == 6


def test_stream_with_watermark(spark, tmp_path):
    source, sink, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    fact(spark, 6).unionByName(fact(spark, 6)).write.parquet(source)
    ingest.ingest_results_stream(ingest.read_results_stream(spark, source), sink, state, watermark="1 hour").awaitTermination()
    assert spark.read.parquet(sink).count() == 6


def test_responses_keep_the_key_and_one_fact_each(spark):
    key = "task_id string, model_name string, shot_count int, trial_id int, input_sha256 string, example_selection string"
    cells = spark.createDataFrame([("t", "m", s, 1, "h", "fixed", "want") for s in (0, 1, 2)], f"{key}, expected_output string")
    said = spark.createDataFrame(
        [("t", "m", 0, 1, "h", "fixed", "b", None, "m-2024"), ("t", "m", 0, 1, "h", "fixed", "a", None, "m-2024"),
         ("t", "m", 1, 1, "h", "fixed", "x", "timeout", "m-2024"), ("t", "m", 1, 1, "h", "fixed", "y", None, None)],
        f"{key}, output string, error string, served_model string")
    got = {r["shot_count"]: r for r in responses.attach_responses(cells, said).collect()}
    assert len(got) == 3
    assert (got[0]["model_name"], got[0]["served_model"], got[0]["actual_output"]) == ("m", "m-2024", "a")
    assert (got[1]["actual_output"], got[1]["response_error"], got[2]["response_error"]) == ("y", None, "no response")


def test_prompts_keep_cells_of_unlisted_tasks(spark):
    grid = spark.createDataFrame([("t", "in", 0, "fixed"), ("unlisted", "in", 0, "fixed")],
                                 "task_id string, input string, shot_count int, example_selection string")
    tasks = spark.createDataFrame([("t", "d", None), ("t", "d", None)], "task_id string, description string, instruction string")
    examples = spark.createDataFrame([], "task_id string, pos int, input string, output string, is_distractor boolean")
    got = {r["task_id"]: r for r in prompts.build_prompts(grid, tasks, examples, selections=("fixed",)).collect()}
    assert len(got) == 2
    assert got["t"]["prompt"] and got["t"]["prompt_error"] is None
    assert got["unlisted"]["prompt"] is None and got["unlisted"]["prompt_error"] == "task is not listed"


def test_cells_meet_their_answers_where_they_are(spark):
    """Prompts are as build_prompts makes them of the grid, and no shuffle moves a cell, an answer or a reply."""
    packs = tasks.parse_task_packs(spark.createDataFrame([(json.dumps(PACK),), (json.dumps({**PACK, "pack_id": "q"}),)], "json string")).parsed()
    models, axes = ["m", "n"], {"trials": 2, "selections": ["fixed", "tfidf"]}
    cells = grid.with_eval_key(grid.evaluation_grid(packs.test_cases, models, **axes))
    shown = ["pack_id", "pos", *EVAL_KEY, "prompt_error", "prompt"]
    want = prompts.build_prompts(cells, packs.tasks, packs.examples).select(shown).orderBy(shown).collect()
    with keyed.by_text(spark):
        built = evaluation.prompts_to_run(packs, models, partitions=3, **axes)
        assert built.select(shown).orderBy(shown).collect() == want
        said = grid.keyed_grid(packs.test_cases.select("task_id", "input").distinct(), models, partitions=3, **axes)
        replies = said.select(*EVAL_KEY, F.lit("Score: 0.5").alias("grader_reply"))
        answers = said.select(*EVAL_KEY, F.lit("o0").alias("output"), F.explode(F.array(F.lit(None).cast("string"), F.lit("late"))).alias("error"))
        facts = evaluation.results_of_run(built, answers, "r", replies)
        plan = facts._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [x for x in plan if "Exchange" in x and "model_name" in x]
        rows = facts.groupBy("scoring_method", "score").count().collect()
    # two packs of two tasks; two models, trials and selections, five shots
    assert {tuple(r) for r in rows} == {("exact_match", 1.0, 160), ("llm_judge", 0.5, 160)}
    assert spark.conf.get(keyed.ALL_KEYS) == "true"
    assert keyed.grid_partitions(packs.test_cases, 40, 10) == 32 and keyed.grid_partitions(packs.test_cases, 1) == 8
    done = facts.filter("model_name = 'm'")
    left = evaluation.prompts_to_run(packs, models, done, **axes).groupBy("model_name").count().collect()
    assert [tuple(r) for r in left] == [("n", 160)]
