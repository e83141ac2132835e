"""Curve, reliability and cost metrics as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.text import as_column


def score_column(shot: int) -> str:
    return f"score_{shot}shot"


SCORE_COLUMNS = [score_column(s) for s in fv.SHOTS]


def stable_round(c, digits: int) -> Column:
    """Round with ties going up even when the sum behind them came out a bit
    low, so that results agree between runs and engines."""
    return F.round(as_column(c) + 10.0 ** -(digits + 3), digits)


def improvement_rate(first="score_0shot", last="score_8shot") -> Column:
    """Score gained per example between no example and eight."""
    return (as_column(last) - as_column(first)) / fv.SHOTS[-1]


def threshold_shots(threshold: float = fv.SUCCESS_THRESHOLD, columns=None) -> Column:
    """Fewest shots whose score reaches the threshold; -1 if none does."""
    columns = columns or dict(zip(fv.SHOTS, SCORE_COLUMNS))
    reached = [F.when(as_column(c) >= threshold, F.lit(s)) for s, c in columns.items()]
    return F.coalesce(*reached, F.lit(-1))


def learning_curve_auc(columns=None) -> Column:
    """Trapezoid area under the curve over shots, as a share of the full width.
    A NULL score gives NULL."""
    columns = columns or SCORE_COLUMNS
    width = fv.SHOTS[-1] - fv.SHOTS[0]
    pieces = [
        (as_column(a) + as_column(b)) / 2 * (hi - lo)
        for a, b, lo, hi in zip(columns, columns[1:], fv.SHOTS, fv.SHOTS[1:])
    ]
    total = pieces[0]
    for piece in pieces[1:]:
        total = total + piece
    return total / width


def efficiency_metrics(threshold: float = fv.SUCCESS_THRESHOLD) -> dict[str, Column]:
    """The three curve metrics by output name, for DataFrame.withColumns."""
    return {
        "improvement_rate": improvement_rate(),
        "threshold_shots": threshold_shots(threshold),
        "learning_curve_auc": learning_curve_auc(),
    }


def _draw_ratio(top: Column, n: Column, k: int) -> Column:
    # C(top, k) / C(n, k) as a product of k factors
    ratio = F.lit(1.0)
    for i in range(k):
        ratio = ratio * F.try_divide((top - i).cast("double"), (n - i).cast("double"))
    return ratio


def pass_at_k(n, c, k: int) -> Column:
    """Chance that k draws without replacement hit at least one success."""
    n, c = as_column(n), as_column(c)
    if k <= 0:
        return F.lit(0.0)
    return (
        F.when((n <= 0) | (n < k), F.lit(0.0))
        .when(c >= n, F.lit(1.0))
        .when(c <= 0, F.lit(0.0))
        .when(n - c < k, F.lit(1.0))
        .otherwise(1.0 - _draw_ratio(n - c, n, k))
    )


def pass_all_k(n, c, k: int) -> Column:
    """Chance that k draws without replacement are all successes."""
    n, c = as_column(n), as_column(c)
    if k <= 0:
        return F.lit(0.0)
    return F.when((n <= 0) | (n < k) | (c < k), F.lit(0.0)).otherwise(_draw_ratio(c, n, k))


def total_cost(input_tokens="input_tokens", output_tokens="output_tokens",
               latency_ms="latency_ms", input_price="input_price",
               output_price="output_price", time_price=0.0) -> Column:
    """Token cost plus time cost in USD."""
    time_price = F.lit(time_price) if isinstance(time_price, (int, float)) else as_column(time_price)
    return (
        as_column(input_tokens) / 1_000_000 * as_column(input_price)
        + as_column(output_tokens) / 1_000_000 * as_column(output_price)
        + as_column(latency_ms) / 1000 * time_price
    )


def economy_score(accuracy, cost) -> Column:
    """Accuracy per USD; 0 when nothing was paid."""
    accuracy, cost = as_column(accuracy), as_column(cost)
    return F.when(cost > 0, accuracy / cost).otherwise(F.lit(0.0))
