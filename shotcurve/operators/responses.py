"""Joining model responses to prompts and shaping fact rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.names import provider
from shotcurve.functions.text import strip
from shotcurve.operators.joins import by_sorting, eval_key, one_per_key
from shotcurve.schemas import EVAL_RESULTS

NO_RESPONSE = "no response"


def clean_responses(df: DataFrame, output: str = "output") -> DataFrame:
    """Trim outputs. The two chat-style providers also lose their think blocks;
    when nothing is left the local one keeps the raw text, the other is empty."""
    raw = strip(output)
    without = strip(F.regexp_replace(raw, fv.THINK_BLOCK, ""))
    who = provider("model_name")
    return df.withColumn(
        output,
        F.when((who == "local") & (without == ""), raw)
        .when(who.isin("local", "openai"), without)
        .otherwise(raw))


def attach_responses(prompts: DataFrame, responses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Left join responses by key and add actual_output, latency_ms, token
    counts, served_model and response_error.

    responses: the keys, output, and optionally latency_ms, input_tokens,
    output_tokens, error and served_model (the name the response reports). A
    missing row, NULL output or error makes the row failed. model_name, part of
    the key, stays the name that was asked for. Of several responses with one
    key the first in the order output, latency, tokens counts, one without error
    before one with."""
    keys = keys or eval_key(prompts, responses)
    wanted = ["output", "latency_ms", "input_tokens", "output_tokens", "error", "served_model"]
    answers = responses.select(*keys, *[c for c in wanted if c in responses.columns])
    for c in wanted:
        if c not in answers.columns:
            kind = "string" if c in ("error", "served_model") else "bigint"
            answers = answers.withColumn(c, F.lit(None).cast(kind))
    failed = F.col("error").isNotNull() | F.col("output").isNull()
    answers = one_per_key(answers, keys, [failed, *[F.col(c) for c in wanted]])
    joined = prompts.join(by_sorting(answers.drop(*[c for c in wanted if c in prompts.columns and c not in keys])),
                          keys, "left")
    error = F.when(F.col("error").isNotNull(), F.col("error")).when(
        F.col("output").isNull(), F.lit(NO_RESPONSE))
    return (
        joined.withColumns({
            "response_error": error,
            "actual_output": F.when(error.isNull(), F.col("output")),
            "served_model": F.when(error.isNull(), F.col("served_model")),
            "latency_ms": F.coalesce("latency_ms", F.lit(0)).cast("bigint"),
            "input_tokens": F.coalesce("input_tokens", F.lit(0)).cast("bigint"),
            "output_tokens": F.coalesce("output_tokens", F.lit(0)).cast("bigint"),
        }).drop("output", "error"))


def to_eval_results(scored: DataFrame, run_id: str | None = None, served_names: bool = False) -> DataFrame:
    """Scored rows -> fact rows. model_name is the name that was asked for, so
    that a run can be resumed; served_names puts the served one in its place. A failed response or score becomes an error row:
    the message as output, score 0.0, no latency and no tokens."""
    error = F.coalesce(F.col("response_error"),
                       F.col("score_error") if "score_error" in scored.columns else F.lit(None))
    failed = error.isNotNull()
    cols = {
        "actual_output": F.when(failed, F.concat(F.lit(fv.ERROR_PREFIX), error))
        .otherwise(F.col("actual_output")),
        "score": F.when(failed, F.lit(0.0)).otherwise(F.col("score")),
    }
    for c in ("latency_ms", "input_tokens", "output_tokens"):
        cols[c] = F.when(failed, F.lit(0)).otherwise(F.col(c))
    if served_names and "served_model" in scored.columns:
        cols["model_name"] = F.coalesce("served_model", "model_name")
    if run_id is not None:
        cols["run_id"] = F.lit(run_id)
    if "timestamp" not in scored.columns:
        cols["timestamp"] = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = scored.withColumns(cols)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVAL_RESULTS])
