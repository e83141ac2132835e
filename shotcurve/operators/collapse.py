"""Collapse detection over summary rows (one learning curve per row)."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions import curves
from shotcurve.operators.joins import join_one
from shotcurve.scratch import cut_lineage

LabelFn = Callable[[Column, Column], Column]


def _or_default(summary: DataFrame, name: str, default: str) -> Column:
    return F.col(name) if name in summary.columns else F.lit(default)


def _identity(summary: DataFrame, label: LabelFn | None) -> list[Column]:
    task, category = _or_default(summary, "task_id", ""), _or_default(summary, "category", "")
    return [
        F.col("model_name").alias("model"),
        task.alias("task_id"),
        (label(task, category) if label else task).alias("task_label"),
        _or_default(summary, "example_selection", fv.DEFAULT_SELECTION).alias("example_selection"),
    ]


def label_from(mapping: DataFrame, alerts: DataFrame) -> DataFrame:
    """Replace task_label by the mapping's label (task_id[, category] -> label);
    tasks it does not list keep their label. Of several labels the least counts."""
    keys = [c for c in ("task_id", "category") if c in mapping.columns and c in alerts.columns]
    named = mapping.select(*keys, F.col("label").alias("mapped_label"))
    return (
        join_one(alerts, named.filter(F.col("mapped_label").isNotNull()), keys)
        .withColumn("task_label", F.coalesce("mapped_label", "task_label"))
        .drop("mapped_label")
    )


def with_series(summary: DataFrame) -> DataFrame:
    """Add the array column series: the row's available (shot, score) points."""
    return summary.withColumn("series", curves.shot_series(summary.columns))


def final_shot_column(summary: DataFrame) -> str | None:
    """Last scheduled score column the frame has, whatever its rows hold."""
    present = curves.point_columns(summary.columns)
    return present[max(present)] if present else None


def _with_curve(summary: DataFrame) -> DataFrame:
    return with_series(summary).withColumn("dip", curves.largest_dip("series"))


_ALERT_TYPES = {
    "severity": "string", "score_0shot": "double", "score_final": "double", "score_peak": "double",
    "peak_shot": "int", "from_shot": "int", "to_shot": "int", "score_from": "double",
    "score_to": "double", "drop_pct": "double",
}


def _few_shot_collapse(summary: DataFrame) -> tuple[Column, dict[str, Column]]:
    last = final_shot_column(summary)
    zero = F.col("score_0shot") if "score_0shot" in summary.columns else F.lit(0.0)
    zero = F.nanvl(zero.cast("double"), F.lit(None))
    final = F.nanvl(F.col(last).cast("double"), F.lit(None)) if last else F.lit(None).cast("double")
    drop = F.try_divide(zero - final, zero) * 100
    severity = F.when(drop >= fv.COLLAPSE_SEVERE_PCT, "collapse").otherwise("degradation")
    return (
        (zero > fv.BASELINE_FLOOR) & (final < zero * fv.COLLAPSE_FACTOR),
        {"severity": severity, "score_0shot": zero, "score_final": final, "drop_pct": drop})


def _peak_regression(summary: DataFrame) -> tuple[Column, dict[str, Column]]:
    top, last = curves.peak("series"), curves.final_score("series")
    return curves.is_peak_regression("series"), {
        "score_peak": top["score"], "peak_shot": top["shot"], "score_final": last,
        "drop_pct": F.try_divide(top["score"] - last, top["score"]) * 100}


def _mid_curve_dip(summary: DataFrame) -> tuple[Column, dict[str, Column]]:
    names = ["from_shot", "to_shot", "score_from", "score_to", "drop_pct"]
    return F.col("dip").isNotNull(), {n: F.col("dip")[n] for n in names}


_DETECTORS = {
    "few_shot_collapse": _few_shot_collapse,
    "peak_regression": _peak_regression,
    "mid_curve_dip": _mid_curve_dip,
}


def _detect(kind: str, summary: DataFrame, label: LabelFn | None, ordered: bool) -> DataFrame:
    found, fields = _DETECTORS[kind](summary)
    alerts = _with_curve(summary).filter(found).select(
        F.lit(kind).alias("type"), *_identity(summary, label),
        *[c.alias(name) for name, c in fields.items()])
    if not ordered:
        return alerts
    return alerts.orderBy(F.desc("drop_pct"), "model", "task_id", "example_selection")


def detect_few_shot_collapse(summary: DataFrame, label: LabelFn | None = None,
                             ordered: bool = True) -> DataFrame:
    """Rows whose last score lies more than a tenth below the zero-shot score,
    worst first."""
    return _detect("few_shot_collapse", summary, label, ordered)


detect_negative_learning = detect_few_shot_collapse


def detect_peak_regression(summary: DataFrame, label: LabelFn | None = None,
                           ordered: bool = True) -> DataFrame:
    """Rows that learned, peaked before the last shot and fell back, worst first."""
    return _detect("peak_regression", summary, label, ordered)


def detect_mid_curve_dip(summary: DataFrame, label: LabelFn | None = None,
                         ordered: bool = True) -> DataFrame:
    """The steepest fall between neighbouring shots of each row that has one,
    worst first."""
    return _detect("mid_curve_dip", summary, label, ordered)


def collapse_alerts(summary: DataFrame, label: LabelFn | None = None,
                    ordered: bool = False) -> DataFrame:
    """The three detectors' rows in one table, from one pass over the summary:
    each row yields its alerts, none to three."""
    alerts = []
    for kind, detector in _DETECTORS.items():
        found, fields = detector(summary)
        columns = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in _ALERT_TYPES.items()]
        alerts.append(F.when(found, F.struct(F.lit(kind).alias("type"), *columns)))
    rows = (
        _with_curve(summary)
        .select(*_identity(summary, label), F.explode(F.array(*alerts)).alias("alert"))
        .filter(F.col("alert").isNotNull())
        .select("alert.type", "model", "task_id", "task_label", "example_selection",
                *[f"alert.{n}" for n in _ALERT_TYPES]))
    return rows.orderBy("type", F.desc("drop_pct"), "model", "task_id") if ordered else rows


def classify_collapse(summary: DataFrame) -> DataFrame:
    """Collapse pattern per curve with at least two points, and its scores as a
    shot -> score map."""
    rows = with_series(summary).withColumn("pattern", curves.collapse_pattern("series"))
    return rows.filter(F.col("pattern").isNotNull()).select(
        F.col("model_name").alias("model"),
        _or_default(summary, "task_id", "").alias("task_id"),
        F.map_from_entries("series").alias("scores"),
        "pattern",
        _or_default(summary, "example_selection", fv.DEFAULT_SELECTION).alias("example_selection"))


def with_pattern(summary: DataFrame) -> DataFrame:
    """Summary rows plus pattern (NULL below two points) and the row's resilience."""
    rows = with_series(summary).withColumn("pattern", curves.collapse_pattern("series"))
    return rows.withColumn("resilience", curves.curve_resilience("series", "pattern")).drop("series")


def resilience_score(summary: DataFrame, per_selection: bool = False, per_run: bool = False) -> DataFrame:
    """Mean resilience per model (and selection, and run) over its classified curves."""
    rows = with_pattern(summary).filter(F.col("pattern").isNotNull())
    keys = [*(["run_id"] if per_run else []), "model_name"]
    if per_selection:
        keys = ["example_selection", *keys]
        rows = rows.withColumn("example_selection", F.coalesce(
            _or_default(summary, "example_selection", fv.DEFAULT_SELECTION),
            F.lit(fv.DEFAULT_SELECTION)))
    return rows.groupBy(*keys).agg(F.avg("resilience").alias("resilience_score"))


def enrich_summary(summary: DataFrame, checkpoint: bool = True) -> DataFrame:
    """Add collapse_pattern ('' when unclassified) and the model's
    resilience_score, separately for each run and selection.

    The mean comes back by join, not by window: a model with very many curves
    is averaged with map-side combine, and the join can split its rows. The
    summary, read twice for that, is checkpointed first, so that the facts
    behind it are scanned once; pass checkpoint=False for a stored summary."""
    if checkpoint:
        summary = cut_lineage(summary)
    if "example_selection" not in summary.columns:
        summary = summary.withColumn("example_selection", F.lit(fv.DEFAULT_SELECTION))
    # a NULL selection is the default one; a row without run id belongs to run ''
    keys = {"_selection": F.coalesce("example_selection", F.lit(fv.DEFAULT_SELECTION)),
            "_run": F.coalesce("run_id", F.lit("")) if "run_id" in summary.columns else F.lit("")}
    rows = with_pattern(summary).withColumns(keys)
    means = (
        rows.filter(F.col("pattern").isNotNull())
        .groupBy(*keys, "model_name")
        .agg(F.avg("resilience").alias("resilience_score")))
    return (
        rows.join(means, [*keys, "model_name"], "left")
        .withColumn("collapse_pattern", F.coalesce("pattern", F.lit("")))
        .select(*summary.columns, "collapse_pattern", "resilience_score"))


def curve_long(summary: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Summary -> one row per curve and shot column present."""
    ids = ids or [c for c in ("run_id", "task_id", "category", "model_name", "example_selection")
                  if c in summary.columns]
    return summary.select(*ids, F.inline(curves.all_points(summary.columns)).alias("shot_count", "score"))


def drop_intervals(summary: DataFrame, threshold: float = fv.INTERVAL_DROP,
                   ids: list[str] | None = None) -> DataFrame:
    """Neighbouring shot columns between which the score falls by more than the
    threshold, in score points."""
    ids = ids or [c for c in ("run_id", "task_id", "category", "model_name", "example_selection")
                  if c in summary.columns]
    steps = curves.drop_steps(curves.all_points(summary.columns), threshold)
    return summary.select(*ids, F.inline(steps))


def adaptation_index(scores: DataFrame, axes: list[str] | None = None) -> DataFrame | None:
    """Mean of each axis per model and AEI, the plain mean of the axes a model
    has; best first. None when no axis holds a value.

    Axes left out, a job counting values per axis column decides which exist."""
    if axes is None:
        present = [a for a in fv.AXES if a in scores.columns]
        if not present:
            return None
        found = scores.agg(*[F.count(F.nanvl(F.col(a).cast("double"), F.lit(None))).alias(a)
                             for a in present]).first()
        axes = [a for a in present if found[a] > 0]
    if not axes:
        return None
    means = scores.groupBy("model_name").agg(
        *[F.avg(F.nanvl(F.col(a).cast("double"), F.lit(None))).alias(fv.AXES[a]) for a in axes]
    ).filter(F.col("model_name").isNotNull())
    labels = [fv.AXES[a] for a in axes]
    values = F.filter(F.array(*[F.col(f"`{x}`") for x in labels]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return (
        means.withColumn("AEI", F.try_divide(total, F.size(values)))
        .orderBy(F.desc_nulls_last("AEI"), "model_name"))


__all__ = [
    "adaptation_index", "classify_collapse", "collapse_alerts", "curve_long",
    "detect_few_shot_collapse", "detect_mid_curve_dip", "detect_negative_learning",
    "detect_peak_regression", "drop_intervals", "enrich_summary", "final_shot_column",
    "label_from", "resilience_score", "with_pattern", "with_series",
]
