"""Collapse analytics on one learning curve, held as an ordered array on the row.

Every test here is row-local: no shuffle, no window, no explode.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.metrics import score_column
from shotcurve.functions.text import as_column


def point_columns(columns: list[str]) -> dict[int, str]:
    """Scheduled score columns present among the given column names."""
    return {s: score_column(s) for s in fv.SHOTS if score_column(s) in columns}


def all_points(columns: list[str]) -> Column:
    """Array of (shot, score) for every score column present, NULL scores kept."""
    points = [
        F.struct(F.lit(s).alias("shot"),
                 F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("score"))
        for s, c in point_columns(columns).items()
    ]
    if not points:
        return F.array().cast("array<struct<shot:int,score:double>>")
    return F.array(*points)


def shot_series(columns: list[str]) -> Column:
    """Array of (shot, score) in shot order, only the points that have a score."""
    return F.filter(all_points(columns), lambda p: p["score"].isNotNull())


def baseline(series) -> Column:
    return F.get(as_column(series), F.lit(0))["score"]


def final_score(series) -> Column:
    return F.try_element_at(as_column(series), F.lit(-1))["score"]


def final_shot(series) -> Column:
    return F.try_element_at(as_column(series), F.lit(-1))["shot"]


def peak(series) -> Column:
    """Best point after the first one, the earliest on ties; NULL if there is none."""
    series = as_column(series)
    later = F.slice(series, F.lit(2), F.greatest(F.size(series), F.lit(1)))
    best = F.array_max(F.transform(
        later, lambda p: F.struct(p["score"].alias("score"), (-p["shot"]).alias("order"))))
    return F.struct(best["score"].alias("score"), (-best["order"]).alias("shot"))


def is_peak_regression(series) -> Column:
    """The curve learned, peaked before its last point and then fell back."""
    series = as_column(series)
    top = peak(series)
    base, last = baseline(series), final_score(series)
    return F.coalesce(
        (F.size(series) >= 2)
        & (base > fv.BASELINE_FLOOR)
        & (top["shot"] != final_shot(series))
        & (top["score"] > base * fv.LEARNING_FACTOR)
        & (last < top["score"] * fv.REGRESSION_FACTOR),
        F.lit(False))


def largest_dip(series) -> Column:
    """Steepest relative fall between neighbouring points, the earliest on ties.

    Struct (drop_pct, from_shot, to_shot, score_from, score_to); NULL if no
    fall is steep enough."""
    series = as_column(series)
    steps = _steps(series)
    dips = F.filter(
        steps,
        lambda s: (s["score_from"] > fv.BASELINE_FLOOR)
        & (s["score_to"] < s["score_from"] * fv.DIP_FACTOR))
    return F.array_max(F.transform(dips, lambda s: F.struct(
        ((s["score_from"] - s["score_to"]) / s["score_from"] * 100).alias("drop_pct"),
        (-s["from_shot"]).alias("order"),
        s["from_shot"].alias("from_shot"),
        s["to_shot"].alias("to_shot"),
        s["score_from"].alias("score_from"),
        s["score_to"].alias("score_to"))))


def drop_steps(points, threshold: float = fv.INTERVAL_DROP) -> Column:
    """Neighbouring points whose score falls by more than the threshold."""
    return F.filter(_steps(as_column(points)),
                    lambda s: s["score_to"] < s["score_from"] - threshold)


def _steps(series: Column) -> Column:
    n = F.greatest(F.size(series) - 1, F.lit(0))
    return F.zip_with(
        F.slice(series, F.lit(1), n), F.slice(series, F.lit(2), n),
        lambda a, b: F.struct(
            a["shot"].alias("from_shot"), b["shot"].alias("to_shot"),
            a["score"].alias("score_from"), b["score"].alias("score_to")))


def collapse_pattern(series) -> Column:
    """stable, peak_regression, immediate_collapse or gradual_decline; NULL when
    the curve has fewer than two points."""
    series = as_column(series)
    base, last = baseline(series), final_score(series)
    second = F.get(series, F.lit(1))["score"]
    total_drop = base - last
    return (
        F.when(F.size(series) < 2, F.lit(None).cast("string"))
        .when(base <= fv.BASELINE_FLOOR, F.lit("stable"))
        .when(is_peak_regression(series), F.lit("peak_regression"))
        .when(total_drop / base < fv.DECLINE_RATIO, F.lit("stable"))
        .when((total_drop > 0) & (F.try_divide(base - second, total_drop) >= fv.IMMEDIATE_RATIO),
              F.lit("immediate_collapse"))
        .otherwise(F.lit("gradual_decline"))
    )


def curve_resilience(series, pattern) -> Column:
    """1 minus the pattern's penalty scaled by how far the curve fell; NULL
    without a pattern."""
    series, pattern = as_column(series), as_column(pattern)
    base, last, top = baseline(series), final_score(series), peak(series)["score"]
    weight = F
    for name, value in fv.PATTERN_PENALTY.items():
        weight = weight.when(pattern == name, F.lit(value))
    fallen_from = F.when(pattern == "peak_regression", top).otherwise(base)
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(fallen_from - last, fallen_from)))
    penalty = (
        F.when(pattern == "stable", F.lit(0.0))
        .when((pattern != "peak_regression") & (base <= fv.BASELINE_FLOOR), F.lit(0.0))
        .otherwise(weight * ratio))
    return F.when(pattern.isNotNull(), 1.0 - penalty)
