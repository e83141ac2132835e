"""Grader prompt tables and grader reply tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotcurve.functions import judge as J
from shotcurve.functions.text import strip


def _column(df: DataFrame, name: str, kind: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _parts(df: DataFrame):
    return (F.col("actual_output"), _column(df, "input", "string"),
            _column(df, "acceptable_variations", "array<string>"))


def _rubric_flag(df: DataFrame):
    return F.coalesce(_column(df, "expected_is_rubric", "boolean"), F.lit(False))


def with_prompt_kind(df: DataFrame) -> DataFrame:
    """Add prompt_kind: rubric, keyword or natural."""
    return df.withColumn("prompt_kind", J.judge_prompt_kind("expected_output", _rubric_flag(df)))


def keyword_judge_prompts(df: DataFrame) -> DataFrame:
    return df.withColumn("judge_prompt", J.keyword_judge_prompt("expected_output", *_parts(df)))


def natural_judge_prompts(df: DataFrame) -> DataFrame:
    return df.withColumn("judge_prompt", J.natural_judge_prompt("expected_output", *_parts(df)))


def rubric_judge_prompts(df: DataFrame) -> DataFrame:
    return df.withColumn("judge_prompt", J.rubric_judge_prompt("expected_output", *_parts(df)))


def judge_prompts(df: DataFrame) -> DataFrame:
    """Add prompt_kind and the judge_prompt of that kind."""
    df = with_prompt_kind(df)
    kind = F.col("prompt_kind")
    expected, rest = F.col("expected_output"), _parts(df)
    rubric = J.rubric_judge_prompt(F.when(kind == "rubric", expected), *rest)
    return df.withColumn(
        "judge_prompt",
        F.when(kind == "rubric", rubric)
        .when(kind == "keyword", J.keyword_judge_prompt(expected, *rest))
        .otherwise(J.natural_judge_prompt(expected, *rest)))


def with_parsed_reply(df: DataFrame, reply) -> DataFrame:
    """Add _parsed, the struct (score, reason) of a reply column; step by step,
    so that each reply is trimmed and parsed once."""
    return (
        df.withColumn("_text", strip(reply))
        .withColumn("_data", F.try_parse_json(J.reply_body("_text")))
        .withColumn("_parsed", J.score_of_reply("_text", "_data"))
        .drop("_text", "_data"))


def parse_judge_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add score and reason; score is NULL when the reply cannot be read."""
    return with_parsed_reply(df, reply).withColumns(
        {"score": F.col("_parsed.score"), "reason": F.col("_parsed.reason")}).drop("_parsed")
