"""Scoring of expected/actual text pairs, whole tables at a time."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions.text import (
    common_tokens, contains_score, exact_match_score, normalize_text, token_set_f1, tokenize)
from shotcurve.operators.joins import by_sorting, one_per_key
from shotcurve.operators.judge import with_parsed_reply


def with_normalized(pairs: DataFrame, expected="expected_output", actual="actual_output",
                    where: Column | None = None) -> DataFrame:
    """Add norm_expected and norm_actual, worked out once for all scorers; NULL
    for rows outside where."""
    def text(c):
        return F.col(c) if where is None else F.when(where, F.col(c))
    return pairs.withColumns({"norm_expected": normalize_text(text(expected)),
                              "norm_actual": normalize_text(text(actual))})


def with_tokens(normalized: DataFrame, where: Column | None = None) -> DataFrame:
    """Add the token sets of the normalized texts and the number of tokens they
    share; NULL for rows outside where."""
    def tokens(c):
        distinct = F.array_distinct(tokenize(c))
        return distinct if where is None else F.when(where, distinct)
    return normalized.withColumns({
        "expected_tokens": tokens("norm_expected"), "actual_tokens": tokens("norm_actual"),
    }).withColumn("common_tokens", common_tokens("expected_tokens", "actual_tokens"))


_WORK = ["norm_expected", "norm_actual", "expected_tokens", "actual_tokens", "common_tokens"]


def _f1() -> Column:
    return token_set_f1("expected_tokens", "actual_tokens", "common_tokens",
                        "norm_expected", "norm_actual")


def score_exact_match(pairs: DataFrame) -> DataFrame:
    return with_normalized(pairs).withColumn(
        "score", exact_match_score("norm_expected", "norm_actual")).drop(*_WORK)


def score_contains(pairs: DataFrame) -> DataFrame:
    return with_normalized(pairs).withColumn(
        "score", contains_score("norm_expected", "norm_actual")).drop(*_WORK)


def score_f1(pairs: DataFrame) -> DataFrame:
    return with_tokens(with_normalized(pairs)).withColumn("score", _f1()).drop(*_WORK)


def _standard(method: Column) -> Column:
    return (
        F.when(method == "exact_match", exact_match_score("norm_expected", "norm_actual"))
        .when(method == "contains", contains_score("norm_expected", "norm_actual"))
        .when(method == "f1", _f1()))


def attach_grader_replies(df: DataFrame, replies: DataFrame, keys: list[str],
                          reply: str = "grader_reply") -> DataFrame:
    """Left join grader replies by key; rows without one get NULL (failed). Of several
    replies with one key the least text counts, and NULL only if there is no other."""
    return df.join(by_sorting(one_per_key(replies.select(*keys, reply), keys, [F.col(reply).isNull()])), keys, "left")


def score_results(df: DataFrame, grader: bool = False, reply: str = "grader_reply",
                  fallback: str = "f1", strict: bool = False) -> DataFrame:
    """Add score, reason and score_error by each row's scoring_method.

    Reads expected_output, actual_output, scoring_method and, if present,
    expected_is_rubric, the reply column and response_error. llm_judge rows
    take their score from the grader's reply; a missing or unreadable reply
    falls back to the fallback scorer, or to 0.0 when a rubric was expected.
    Without a grader those rows are errors, as are custom methods, unknown
    methods and rubrics under a text method. Error rows get a NULL score and
    their message, or fail the job when strict. Rows whose response failed
    stay unscored.
    """
    method = F.coalesce(F.col("scoring_method"), F.lit(""))
    rubric = F.col("expected_is_rubric") if "expected_is_rubric" in df.columns else F.lit(False)
    failed = (F.col("response_error").isNotNull() if "response_error" in df.columns
              else F.lit(False))
    fallback_method = fallback if fallback in fv.STANDARD_METHODS else "f1"
    judged = method == "llm_judge"

    if grader and reply in df.columns:
        df = with_parsed_reply(df, F.when(judged & ~failed, F.col(reply)))
        parsed_score, parsed_reason = F.col("_parsed.score"), F.col("_parsed.reason")
    else:
        parsed_score, parsed_reason = F.lit(None).cast("double"), F.lit(None).cast("string")

    error = (
        F.when(failed, F.lit(None))
        .when(judged, F.lit(None if grader else fv.ERROR_NO_GRADER))
        .when(method.startswith("custom:"), F.lit(fv.ERROR_CUSTOM))
        .when(~method.isin(fv.STANDARD_METHODS), F.concat(F.lit(fv.ERROR_UNKNOWN_METHOD), method))
        .when(rubric, F.concat(F.lit(fv.ERROR_NOT_TEXT), method)))
    by_text = F.when(
        ~failed & ~rubric & (F.lit(grader) & judged & parsed_score.isNull()
                             | method.isin(fv.STANDARD_METHODS)),
        F.when(judged, F.lit(fallback_method)).otherwise(method))
    df = df.withColumns({"score_error": error.cast("string"), "_by_text": by_text})
    df = with_normalized(df, where=F.col("_by_text").isNotNull())
    df = with_tokens(df, where=F.col("_by_text") == "f1")

    score = (
        F.when(F.col("score_error").isNotNull() | failed, F.lit(None))
        .when(F.col("_by_text").isNotNull(), _standard(F.col("_by_text")))
        .when(judged & rubric & parsed_score.isNull(), F.lit(0.0))
        .otherwise(parsed_score))
    reason = (
        F.when(~judged | failed | F.col("score_error").isNotNull(), F.lit(None))
        .when(parsed_score.isNotNull(), parsed_reason)
        .when(rubric, F.lit(fv.JUDGE_RUBRIC_FALLBACK_REASON))
        .otherwise(F.lit(fv.JUDGE_FALLBACK_REASON + fallback)))
    if strict:
        score = F.when(F.col("score_error").isNotNull(),
                       F.raise_error(F.col("score_error")).cast("double")).otherwise(score)
    return (df.withColumns({"score": score.cast("double"), "reason": reason.cast("string")})
            .drop("_parsed", "_by_text", *_WORK))


def judge_with_fallback(df: DataFrame, fallback: str = "f1", reply: str = "grader_reply") -> DataFrame:
    """score_results for a table of llm_judge rows that had a grader."""
    return score_results(df.withColumn("scoring_method", F.lit("llm_judge")),
                         grader=True, reply=reply, fallback=fallback).drop("score_error")
