"""Scalar functions for Spark SQL text."""

from pyspark.sql import SparkSession

from shotcurve import fixed_values as fv

_NEAREST = ", ".join(f"named_struct('d', abs(shots - {s}), 's', {s})" for s in fv.SHOTS)
_SCORES = ", ".join(f"s{s} DOUBLE" for s in fv.SHOTS)
_CASES = " ".join(f"WHEN s{s} >= threshold THEN {s}" for s in fv.SHOTS)
_AREA = " + ".join(f"(s{a} + s{b}) / 2 * {b - a}" for a, b in zip(fv.SHOTS, fv.SHOTS[1:]))
_DRAWS = ("aggregate(sequence(0, k - 1), 1D, (a, i) -> a * (CAST({top} - i AS DOUBLE) / CAST(n - i AS DOUBLE)))")

FUNCTIONS = {
    "short_model_name(name STRING) RETURNS STRING": "substring_index(name, '/', -1)",
    "resolve_shot_count(shots INT) RETURNS INT":
        f"CASE WHEN shots IS NOT NULL THEN array_min(array({_NEAREST})).s END",
    "clamp01(x DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, x))",
    "improvement_rate(first DOUBLE, last DOUBLE) RETURNS DOUBLE":
        f"(last - first) / {fv.SHOTS[-1]}",
    f"threshold_shots({_SCORES}, threshold DOUBLE) RETURNS INT": f"CASE {_CASES} ELSE -1 END",
    f"learning_curve_auc({_SCORES}) RETURNS DOUBLE": f"({_AREA}) / {fv.SHOTS[-1]}",
    "pass_at_k(n INT, c INT, k INT) RETURNS DOUBLE":
        "CASE WHEN n <= 0 OR k <= 0 OR k > n THEN 0D WHEN c >= n THEN 1D WHEN c <= 0 THEN 0D"
        f" WHEN n - c < k THEN 1D ELSE 1D - {_DRAWS.format(top='n - c')} END",
    "pass_all_k(n INT, c INT, k INT) RETURNS DOUBLE":
        "CASE WHEN n <= 0 OR k <= 0 OR k > n OR c < k THEN 0D"
        f" ELSE {_DRAWS.format(top='c')} END",
    "economy_score(accuracy DOUBLE, cost DOUBLE) RETURNS DOUBLE":
        "CASE WHEN cost > 0 THEN accuracy / cost ELSE 0D END",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the scalar functions as temporary SQL functions; Catalyst inlines
    their bodies. Returns their names."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in FUNCTIONS]
