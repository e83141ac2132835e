import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from shotcurve.functions import metrics, names
from shotcurve.functions.sql import register_sql_functions
from shotcurve.operators import collapse, costs, reports, summarize as agg
from shotcurve.schemas import EVAL_RESULTS

SCORES = [f"score_{s}shot" for s in (0, 1, 2, 4, 8)]


def facts(spark, rows):
    """rows: (task, model, shot, trial, selection, score)"""
    full = [("run", t, "cat", m, s, f"in{i}", "e", "a", v, "f1", 10, "2024-01-01T00:00:00", k, 3, 2, sel)
            for i, (t, m, s, k, sel, v) in enumerate(rows)]
    return spark.createDataFrame(full, EVAL_RESULTS)


def test_multi_trial_summary(spark):
    rows = [("t", "m", s, k, "fixed", min(1.0, 0.2 + 0.1 * s + 0.05 * k)) for s in (0, 1, 2, 4, 8) for k in (1, 2, 3)]
    row = agg.summarize(facts(spark, rows)).first()
    assert [row[c] for c in SCORES] == pytest.approx([0.3, 0.4, 0.5, 0.7, 1.0])
    assert row["num_trials"] == 3 and row["threshold_shots"] == 8
    assert row["improvement_rate"] == pytest.approx(0.0875)
    assert row["learning_curve_auc"] == pytest.approx((0.3 + 2 * 0.4 + 3 * 0.5 + 6 * 0.7 + 4) / 16)
    assert (row["total_input_tokens"], row["total_output_tokens"], row["total_latency_ms"]) == (45, 30, 150)
    assert row["score_variance"] == pytest.approx(0.8 * statistics.pvariance([0.25, 0.3, 0.35]))
    assert row["pass_at_1"] == row["pass_all_3"] == pytest.approx(0.2)


def test_median_missing_shots_odd_shots_and_nan(spark):
    rows = [("t", "m", 0, k, "fixed", v) for k, v in ((1, 0.1), (2, 0.2), (3, 0.9), (4, 0.6))]
    rows += [("t", "m", 3, 1, "fixed", 1.0), ("t", "m", 1, 1, "fixed", math.nan), ("t", "m", 1, 1, "fixed", 0.5),
             ("t", "m", 2, 1, "fixed", math.nan), (None, "m", 0, 1, "fixed", 1.0)]
    row = agg.summarize(facts(spark, rows), aggregation="median").collect()
    assert len(row) == 1
    row = row[0]
    assert row["score_0shot"] == pytest.approx(0.4)
    assert row["score_1shot"] == 0.5  # NaN is skipped inside a mean
    assert row["score_2shot"] is None  # nothing but NaN
    assert row["score_4shot"] == row["score_8shot"] == 0.0  # absent shots
    assert row["total_latency_ms"] == 80  # odd shots count here
    assert row["learning_curve_auc"] is None


def test_single_trial_has_no_pass_columns(spark):
    rows = [("t", "m", s, 1, sel, 0.5) for s in (0, 8) for sel in ("fixed", "tfidf")]
    df = agg.summarize(facts(spark, rows))
    assert not [c for c in df.columns if c.startswith("pass_")]
    assert sorted(r["example_selection"] for r in df.collect()) == ["fixed", "tfidf"]
    assert {r["score_variance"] for r in df.collect()} == {0.0}
    no_columns = facts(spark, rows).drop("trial_id", "example_selection")
    assert agg.summarize(no_columns).first()["example_selection"] == "fixed"
    switched_off = agg.summarize(facts(spark, rows + [("t", "m", 0, 2, "fixed", 1.0)]), pass_at_k=False)
    assert "pass_at_1" not in switched_off.columns and switched_off.first()["score_variance"] == 0.0


def test_pass_probabilities(spark):
    cases = [(n, c, k) for n in range(7) for c in range(n + 1) for k in (1, 2, 3, 6)]
    df = spark.createDataFrame(cases, "n int, c int, k int")
    for k in (1, 2, 3, 6):
        got = df.filter(F.col("k") == k).select(
            "n", "c", metrics.pass_at_k("n", "c", k).alias("any"), metrics.pass_all_k("n", "c", k).alias("all"))
        for n, c, some, every in got.collect():
            valid = n > 0 and k <= n
            assert some == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k) if valid else 0.0)
            assert every == pytest.approx(math.comb(c, k) / math.comb(n, k) if valid else 0.0)


def test_trial_std(spark):
    rows = [("t", "m", 0, k, "fixed", v) for k, v in ((1, 0.1), (2, 0.4))] + [("t", "m", 1, 1, "fixed", 0.3), ("u", "m", 0, 1, "fixed", 1.0)]
    got = {r["shot_count"]: r["std"] for r in agg.trial_std(facts(spark, rows), "t").collect()}
    assert got == {0: pytest.approx(statistics.stdev([0.1, 0.4])), 1: None}
    assert agg.trial_std(facts(spark, [r for r in rows if r[3] == 1]), "t").count() == 0


# published results: five scores, pattern, and the model's curve resilience follows from them
GOLDEN = [
    ([0.20000000000000004, 0.6, 0.6, 0.6, 0.8000000000000002], 0.07500000000000001, 8, 0.625, "stable"),
    ([0.9333333333333332, 0.9333333333333332, 0.4333333333333333, 0.5333333333333333, 0.3],
     -0.07916666666666666, 0, 0.53125, "gradual_decline"),
    ([0.3333333333333333, 0.3333333333333333, 0.4444444444444444, 0.4444444444444444, 0.3333333333333333],
     0.0, -1, 0.39583333333333326, "peak_regression"),
    ([0.5555555555555555, 0.3333333333333333, 0.2222222222222222, 0.0, 0.0],
     -0.06944444444444443, -1, 0.11805555555555555, "gradual_decline"),
    ([0.0711111111111111, 0.0, 0.0, 0.0, 0.0], -0.008888888888888887, -1, 0.004444444444444444, "immediate_collapse"),
    ([0.6666666666666666, 1.0, 1.0, 0.6666666666666666, 0.6666666666666666], 0.0, 1, 0.7708333333333333, "peak_regression"),
    ([0.3333333333333333, 0.2666666666666666, 0.2666666666666666, 0.6363636363636364, 0.3333333333333333],
     0.0, -1, 0.4261363636363636, "peak_regression"),
]


def curves(spark, rows, columns=SCORES):
    data = [(f"t{i}", "c", f"v/m{i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "task_id string, category string, model_name string, "
                                 + ", ".join(f"{c} double" for c in columns))


def test_published_curves(spark):
    df = curves(spark, [g[0] for g in GOLDEN]).withColumns(metrics.efficiency_metrics())
    got = {r["task_id"]: r for r in collapse.with_pattern(df).collect()}
    for i, (_, rate, shots, auc, pattern) in enumerate(GOLDEN):
        r = got[f"t{i}"]
        assert (r["threshold_shots"], r["pattern"]) == (shots, pattern)
        assert (r["improvement_rate"], r["learning_curve_auc"]) == (pytest.approx(rate, abs=1e-15), pytest.approx(auc, abs=1e-15))
    # one non-stable curve among five published ones gives the published mean
    assert (4 + got["t2"]["resilience"]) / 5 == pytest.approx(0.97)
    assert (4 + got["t4"]["resilience"]) / 5 == pytest.approx(0.8)
    assert (2 + got["t5"]["resilience"]) / 3 == pytest.approx(0.9333333333333332)
    assert (4 + got["t3"]["resilience"]) / 5 == pytest.approx(0.9)


def plain_dip(points):
    drops = [((a - b) / a * 100, -s, s, t) for (s, a), (t, b) in itertools.pairwise(points) if a > 0.05 and b < a * 0.7]
    return max(drops)[2:] if drops else None


def test_detectors_with_gaps(spark):
    import random
    rng = random.Random(1)
    rows = [[rng.choice([None, 0.0, 0.05, 0.3, 0.5, 0.8, 1.0]) for _ in SCORES] for _ in range(300)]
    df = curves(spark, rows)
    dips = {r["task_id"]: (r["from_shot"], r["to_shot"]) for r in collapse.detect_mid_curve_dip(df).collect()}
    peaks = {r["task_id"]: r["peak_shot"] for r in collapse.detect_peak_regression(df).collect()}
    patterns = {r["task_id"]: r["pattern"] for r in collapse.classify_collapse(df).collect()}
    for i, row in enumerate(rows):
        points = [(s, v) for s, v in zip((0, 1, 2, 4, 8), row) if v is not None]
        assert dips.get(f"t{i}") == plain_dip(points)
        peak = None
        if len(points) > 1 and points[0][1] > 0.05:
            shot, top = max(points[1:], key=lambda p: p[1])
            if shot != points[-1][0] and top > 1.1 * points[0][1] and points[-1][1] < 0.8 * top:
                peak = shot
        assert peaks.get(f"t{i}") == peak
        assert (patterns.get(f"t{i}") == "peak_regression") == (peak is not None)
        assert (f"t{i}" in patterns) == (len(points) > 1)


def test_few_shot_collapse_rules(spark):
    df = curves(spark, [[0.8, 0.1, 0.1, 0.1, 0.4], [0.8, 1.0, 1.0, 1.0, 0.71], [0.8, 1.0, 1.0, 1.0, 0.73], [0.05, 0.0, 0.0, 0.0, 0.0], [0.8, 1.0, 1.0, 1.0, None]])
    got = [(r["task_id"], r["severity"]) for r in collapse.detect_few_shot_collapse(df).collect()]
    assert got == [("t0", "collapse"), ("t1", "degradation")]  # worst first
    shorter = collapse.detect_few_shot_collapse(df.drop("score_8shot"))
    assert [r["task_id"] for r in shorter.collect()] == ["t0"]
    assert collapse.detect_few_shot_collapse(df.drop("score_0shot")).count() == 0
    labelled = collapse.detect_few_shot_collapse(df, label=lambda t, c: F.concat(c, F.lit("/"), t))
    assert labelled.first()["task_label"] == "c/t0"
    assert collapse.detect_negative_learning is collapse.detect_few_shot_collapse
    assert collapse.collapse_alerts(curves(spark, [[0.5] * 5])).count() == 0


def test_enrich_keeps_selections_apart(spark):
    df = curves(spark, [[0.8, 0.1, 0.1, 0.1, 0.1], [0.8] * 5, [0.8, None, None, None, None]]).withColumns(
        {"model_name": F.lit("m"), "example_selection": F.when(F.col("task_id") == "t1", "tfidf").otherwise("fixed")})
    got = {r["task_id"]: (r["collapse_pattern"], r["resilience_score"]) for r in collapse.enrich_summary(df).collect()}
    assert got["t0"] == ("immediate_collapse", pytest.approx(0.125))
    assert got["t1"] == ("stable", 1.0)
    assert got["t2"] == ("", pytest.approx(0.125))


def test_adaptation_index(spark):
    schema = "model_name string, axis_Acquisition double, axis_Agency double, axis_Fidelity double"
    df = spark.createDataFrame([("a", 0.2, None, 1.0), ("a", 0.4, None, None), ("b", 0.9, None, None)], schema)
    out = collapse.adaptation_index(df)
    assert out.columns == ["model_name", "Acquisition", "Fidelity", "AEI"]
    assert [(r["model_name"], r["AEI"]) for r in out.collect()] == [("b", 0.9), ("a", pytest.approx(0.65))]
    assert collapse.adaptation_index(df.select("model_name", "axis_Agency")) is None
    assert collapse.adaptation_index(df.select("model_name")) is None


def test_costs(spark):
    usage = spark.createDataFrame(
        [("gpt-4o", 1_000_000, 500_000, 2000, 0.5), ("local", 10, 10, 0, 0.5), ("gpt-4o", -1, 0, 0, 1.0)],
        "model_name string, input_tokens long, output_tokens long, latency_ms long, score double")
    got = costs.with_cost(costs.price_usage(usage), time_price=0.001).collect()
    assert [(r["total_cost"], r["economy_score"]) for r in got] == [
        (pytest.approx(7.502), pytest.approx(0.5 / 7.502)), (0.0, 0.0), (None, None)]
    assert [r["usage_error"] for r in got] == [None, None, "input_tokens must be non-negative"]
    joined = costs.with_cost(costs.price_usage(usage, costs.price_table(spark)), time_price=0.001).collect()
    assert sorted(str(r["total_cost"]) for r in joined) == sorted(str(r["total_cost"]) for r in got)
    with pytest.raises(Exception, match="non-negative"):
        costs.price_usage(usage, strict=True).collect()


def test_reports(spark):
    df = curves(spark, [[0.8] * 5, [0.8, 0.1, 0.1, 0.1, 0.1]]).withColumns(
        {"improvement_rate": F.lit(0.0), "pass_at_1": F.lit(1.0), "num_trials": F.lit(3), "x": F.lit(1)})
    assert reports.metrics_table(df).columns == ["Model", "Task", "Category", *SCORES, "improvement_rate", "num_trials", "pass_at_1"]
    board = reports.resilience_leaderboard(df).collect()
    assert [r["model"] for r in board] == ["m0", "m1"]
    overview = reports.run_overview(df, df).first()
    assert (overview["num_tasks"], overview["num_models"], overview["num_trials"], overview["num_results"]) == (2, 2, 3, 2)
    mixed = df.withColumn("example_selection", F.when(F.col("task_id") == "t0", "tfidf"))
    assert [r["task_id"] for r in reports.filter_selection(mixed, "fixed").collect()] == ["t1"]
    assert reports.filter_selection(df, "fixed").count() == 2


def test_sql_functions_agree_with_columns(spark):
    assert "pass_at_k" in register_sql_functions(spark)
    rows = spark.range(-3, 15).select(F.col("id").cast("int").alias("n")).collect()
    df = spark.createDataFrame([(r["n"],) for r in rows], "n int")
    same = df.select(
        (F.expr("resolve_shot_count(n)") == names.resolve_shot_count("n")).alias("a"),
        F.expr("pass_at_k(n, 2, 3)").eqNullSafe(metrics.pass_at_k(F.col("n"), F.lit(2), 3)).alias("b"),
        F.expr("pass_all_k(n, 4, 3)").eqNullSafe(metrics.pass_all_k(F.col("n"), F.lit(4), 3)).alias("c"))
    assert all(all(r) for r in same.collect())
