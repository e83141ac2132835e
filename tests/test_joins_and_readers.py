import pytest
from pyspark.sql import functions as F

from shotcurve import scratch
from shotcurve.operators import collapse, costs, grid, joins, prompts, responses, scoring, selection, summarize
from shotcurve.plans import keyed
from shotcurve.schemas import EVAL_KEY
from shotcurve.sources import results
from tests.test_sources_and_plans import fact


def test_one_row_per_key_by_a_stated_order_or_refused(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "z"), ("a", 1, "y"), ("b", 5, None), (None, 1, "n")], "k string, n int, t string")
    assert {(r.k, r.n, r.t) for r in joins.one_per_key(rows, ["k"]).collect()} == {("a", 1, "y"), ("b", 5, None), (None, 1, "n")}
    by_n = joins.one_per_key(rows, ["k"], [-F.col("n")])
    assert {(r.k, r.n) for r in by_n.collect()} == {("a", 2), ("b", 5), (None, 1)}
    with pytest.raises(Exception, match="several rows in prices for: a"):
        joins.one_per_key(rows, ["k"], refuse="prices").collect()
    same = rows.filter("k = 'b'").unionByName(rows.filter("k = 'b'"))
    assert joins.one_per_key(same, ["k"], refuse="prices").count() == 1


def test_repeated_prices_labels_and_replies_multiply_nothing(spark):
    usage = spark.createDataFrame([("m", 1, 1, 1), ("n", 1, 1, 1)], "model_name string, input_tokens bigint, output_tokens bigint, latency_ms bigint")
    prices = spark.createDataFrame([("m", 2.0, 1.0), ("m", 1.0, 9.0)], "model_name string, input_price double, output_price double")
    got = {r.model_name: (r.input_price, r.output_price) for r in costs.price_usage(usage, prices).collect()}
    assert got == {"m": (1.0, 9.0), "n": (0.0, 0.0)} and costs.price_usage(usage, prices).count() == 2
    with pytest.raises(Exception, match="price list"):
        costs.price_usage(usage, prices, strict=True).collect()

    alerts = spark.createDataFrame([("t", "t"), ("u", "u")], "task_id string, task_label string")
    labels = spark.createDataFrame([("t", "B"), ("t", "A"), ("t", None)], "task_id string, label string")
    assert sorted(r.task_label for r in collapse.label_from(labels, alerts).collect()) == ["A", "u"]

    rows = spark.createDataFrame([("t", 1), ("u", 1)], "task_id string, trial_id int")
    replies = spark.createDataFrame([("t", 1, None), ("t", 1, '{"score": 0.9}'), ("t", 1, '{"score": 0.1}')], "task_id string, trial_id int, grader_reply string")
    got = scoring.attach_grader_replies(rows, replies, ["task_id", "trial_id"]).collect()
    assert sorted((r.task_id, r.grader_reply) for r in got if r.grader_reply) == [("t", '{"score": 0.1}')] and len(got) == 2


def test_packs_that_share_a_task_id_keep_their_own_texts(spark):
    grid = spark.createDataFrame(
        [(p, "t", 0, f"ask {p}", s, m) for p in ("p1", "p2") for s in (0, 1) for m in ("fixed", "tfidf")],
        "pack_id string, task_id string, pos int, input string, shot_count int, example_selection string")
    tasks = spark.createDataFrame([("p1", "t", "one", None), ("p2", "t", "two", None)], "pack_id string, task_id string, description string, instruction string")
    examples = spark.createDataFrame([("p1", "t", 0, "ask first", "o1", False), ("p2", "t", 0, "ask second", "o2", False)],
                                     "pack_id string, task_id string, pos int, input string, output string, is_distractor boolean")
    got = prompts.build_prompts(grid, tasks, examples).collect()
    assert len(got) == 8
    for r in got:
        own, other = ("one", "two") if r.pack_id == "p1" else ("two", "one")
        assert own in r.prompt and other not in r.prompt
        assert ("o1" in r.prompt, "o2" in r.prompt) == ((r.shot_count, r.pack_id) == (1, "p1"), (r.shot_count, r.pack_id) == (1, "p2"))


def test_large_tasks_are_split_by_their_counted_size(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("task_id"), F.col("id").alias("pos"))
    right = spark.createDataFrame([("big", "B"), ("small", "S"), ("none", "N")], "task_id string, text string")
    parts = joins.task_parts(left, part_rows=100)
    assert [(r.task_id, r["_parts"]) for r in parts.collect()] == [("big", 9)]
    got = joins.join_by_task(left, right, parts)
    assert {(r.text, r["count"]) for r in got.groupBy("text").count().collect()} == {("B", 900), ("S", 100)}
    assert set(got.columns) == {"task_id", "pos", "text"}


def test_trials_are_counted_per_run(spark):
    rows = [("one", t, s, 1, 0.5) for t in "ab" for s in (0, 8)] + [("three", t, s, k, 0.25 * k) for t in "ab" for s in (0, 8) for k in (1, 2, 3)]
    facts = spark.createDataFrame(rows, "run_id string, task_id string, shot_count int, trial_id int, score double").withColumns(
        {"category": F.lit("c"), "model_name": F.lit("m"), "example_selection": F.lit("fixed"),
         **{c: F.lit(1).cast("bigint") for c in summarize.USAGE}})
    got = {(r.run_id, r.task_id): r for r in summarize.summarize(facts).collect()}
    assert {k: r.num_trials for k, r in got.items()} == {("one", "a"): 1, ("one", "b"): 1, ("three", "a"): 3, ("three", "b"): 3}
    assert got["one", "a"].pass_at_1 is None and got["three", "a"].pass_at_1 is not None and got["one", "a"].score_variance == 0.0
    alone = summarize.summarize(facts.filter("run_id = 'three'")).collect()
    assert sorted(alone) == sorted(r for k, r in got.items() if k[0] == "three")


def test_unreadable_values_fail_or_are_rescued(spark, tmp_path):
    path = tmp_path / "raw_results_x.csv"
    path.write_text("run_id,task_id,trial_id,score,shot_count,latency_ms\nr,a,abc,oops,1,5\nr,b,2.0,0.5,1.5,9007199254740993\nr,c,,,2,\n")
    for column in ("trial_id", "score", "shot_count"):
        with pytest.raises(Exception, match=f"unreadable {column}"):
            results.read_eval_results(spark, str(path), "csv").select(column).collect()
    got = {r.task_id: r for r in results.read_eval_results(spark, str(path), "csv", rescued="unreadable").collect()}
    assert (got["a"].trial_id, got["a"].score, got["a"].unreadable) == (None, None, {"trial_id": "abc", "score": "oops"})
    assert (got["b"].trial_id, got["b"].shot_count, got["b"].unreadable) == (2, None, {"shot_count": "1.5"})
    assert got["b"].latency_ms == 9007199254740993
    assert (got["c"].trial_id, got["c"].score, got["c"].unreadable) == (1, None, None)
    assert results.read_eval_results(spark, str(tmp_path / "none"), "csv", rescued="unreadable").count() == 0


def test_files_of_few_headers_are_few_scans(spark, tmp_path):
    heads = ["run_id,score_0shot", "run_id,score_0shot,pass_at_1", "score_0shot,run_id,num_trials"]
    rows = ["{i},0.5", "{i},0.5,1", "0.5,{i},3"]
    paths = []
    for i in range(1000):
        path = tmp_path / f"summary_{i}.csv"
        path.write_text(heads[i % 3] + "\n" + rows[i % 3].format(i=i) + "\n")
        paths.append(str(path))
    (tmp_path / "summary_e.csv").write_text("")
    both = results.read_summaries(spark, [*paths, str(tmp_path / "summary_e.csv")])
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    got = both.collect()
    assert sorted(int(r.run_id) for r in got) == list(range(1000)) and {r.score_0shot for r in got} == {0.5}
    assert {(int(r.run_id) % 3, r.pass_at_1, r.num_trials) for r in got} == {(0, None, None), (1, 1.0, None), (2, None, 3)}


def test_catalogue_does_not_open_other_folders(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "raw_results_9.csv").write_text("x\n")
    (tmp_path / "raw_results_1.csv").write_text("x\n")
    (tmp_path / "deep").chmod(0)  # a visit would fail for others than root
    try:
        names = []
        found = results._names
        results._names = lambda s, p: names.append(p) or found(s, p)
        assert [r.run_id for r in results.run_catalog(spark, str(tmp_path)).collect()] == ["1"]
    finally:
        results._names = found
        (tmp_path / "deep").chmod(0o755)
    assert len(names) == 4 and all(n.rsplit("/", 1)[0] in (str(tmp_path), f"{tmp_path}/demo") for n in names)
    assert results.run_catalog(spark, str(tmp_path / "none")).count() == 0


def test_loading_a_run_of_the_catalogue(spark, tmp_path):
    results.write_run(fact(spark), str(tmp_path), "x")
    results.write_run(fact(spark).groupBy("run_id").agg(F.avg("score").alias("score_0shot")), str(tmp_path), "x", "summary")
    results.write_run(fact(spark, 3), str(tmp_path / "demo"), "y")
    x, y = results.run_catalog(spark, str(tmp_path)).collect()
    facts, summary = results.load_run(spark, x)
    assert facts.count() == 6 and {r.score_0shot for r in summary.collect()} == {0.5}
    facts, summary = results.load_run(spark, y)
    assert facts.count() == 3 and summary is None


def test_stored_by_key_the_grid_does_not_move_again(spark):
    cases = spark.createDataFrame([("t", i, f"ask {i % 40}") for i in range(60)], "task_id string, pos int, input string")
    cells = grid.with_eval_key(grid.evaluation_grid(cases, ["m", "n"], trials=2, selections=["fixed", "tfidf"]))
    cells = cells.withColumns({"expected_output": F.lit("yes"), "scoring_method": F.lit("llm_judge")})
    said = cells.select(*keyed.EVAL_KEY, F.col("input").alias("output")).distinct()
    replies = said.select(*keyed.EVAL_KEY, F.lit('{"score": 0.5}').alias("grader_reply"))

    def scored(cells, said, replies):
        rows = scoring.attach_grader_replies(responses.attach_responses(cells, said), replies, keyed.EVAL_KEY)
        return scoring.score_results(rows, grader=True)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with keyed.KeyedTables(spark, buckets=4) as tables:
            stored = [tables.store(df, name) for df, name in ((cells, "cells"), (said, "said"), (replies, "replies"))]
            got = scored(*stored)
            pending = grid.pending_evaluations(stored[0], stored[1].filter("shot_count > 0").withColumn("input", F.col("output")))
            assert keyed.exchanges_of(got) == 0 and keyed.exchanges_of(scored(cells, said, replies)) > 1
            want = scored(cells, said, replies)
            columns = sorted(want.columns)
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
            assert got.count() == cells.count() and pending.count() == cells.filter("shot_count = 0").count()
        assert not [t for t in spark.catalog.listTables() if t.name.startswith(keyed.PREFIX)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_cells_of_a_text_are_stored_side_by_side(spark):
    """Copies of a text in one file, next to each other, take little more room than one; all keys and rows are kept."""
    cases = spark.range(40).selectExpr("'t' AS task_id", "id AS pos", "array_join(transform(sequence(1, 60), i -> sha2(concat(id, '/', i), 256)), ' ') AS input")
    cells = grid.with_eval_key(grid.evaluation_grid(cases, ["m", "n"], trials=2, selections=["fixed", "tfidf"]))
    with keyed.KeyedTables(spark, buckets=4) as tables:
        got = tables.store(cells.select(*keyed.EVAL_KEY, "input"), "cells")
        files = got.withColumn("file", F.input_file_name()).groupBy("input").agg(F.count_distinct("file").alias("n"))
        assert got.count() == cells.count() and files.filter("n > 1").count() == 0
        rows = got.withColumns({"file": F.input_file_name(), "at": F.col("_metadata.row_index")}).groupBy("input").agg(
            F.count(F.lit(1)).alias("rows"), (F.max("at") - F.min("at") + 1).alias("reach"))
        assert rows.count() == 40 and rows.filter("reach <> rows").count() == 0


def test_local_scratch_is_refused_on_a_cluster(spark):
    class Session:
        def __init__(self, master, **conf):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: conf.get(k.split(".")[-2], d))})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_root(Session("yarn", warehouse="file:/tmp/w"))
    assert scratch.shared_root(Session("yarn", warehouse="hdfs://a/w")) == "hdfs://a/w/scratch"
    assert scratch.shared_root(Session("local[2]", warehouse="file:/tmp/w")) == "file:/tmp/w/scratch"


def test_answers_of_a_grid_are_not_broadcast(spark):
    """Rows exploded from a small table are many; they meet the grid by sorting, whatever Spark takes their size for."""
    cases = spark.createDataFrame([("t", 0, "a", "f1", "x")], "task_id string, pos int, input string, scoring_method string, expected_output string")
    cells = grid.with_eval_key(grid.evaluation_grid(cases, ["m", "n"], trials=2, selections=["fixed", "tfidf"]))
    examples = spark.createDataFrame([("t", 0, "a", "x", False)], "task_id string, pos int, input string, output string, is_distractor boolean")
    said = cells.select(*EVAL_KEY, F.lit("x").alias("output"))
    rows = responses.attach_responses(selection.select_examples(cells, examples), said)
    rows = scoring.attach_grader_replies(rows, said.withColumnRenamed("output", "grader_reply"), EVAL_KEY)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and ("input_sha256" in line or "case_key" in line)]
    assert joins == []
    assert "SortMergeJoin" in plan and rows.count() == 40


def test_answers_are_one_per_key_before_the_grid_multiplies_them(spark, sf_dir):
    """The grid of answers is not shuffled by key to find those given once."""
    from shotcurve.plans import queries
    cells, said = queries._cells_and_answers(spark, sf_dir)
    assert keyed.exchanges_of(said) == 0
    assert said.count() == cells.filter("pos % 3 <> 0").select(*EVAL_KEY).distinct().count()
