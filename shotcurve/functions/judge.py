"""Grader prompts and grader replies as Column expressions."""

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotcurve import fixed_values as fv
from shotcurve.functions.text import as_column, clamp01, split_words, strip


def _json_text(indent: int | None):
    # nested, so that it travels to workers by value
    def rewrite(texts: pa.Array) -> pa.Array:
        return pa.array([
            None if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=indent)
            for t in texts.to_pylist()], pa.string())
    return F.arrow_udf(rewrite, T.StringType())


def expected_to_text(text, is_rubric) -> Column:
    """Strings as they are; rubric objects as one-line JSON text. Only rubric
    rows reach Python."""
    text = as_column(text)
    return F.coalesce(_json_text(None)(F.when(as_column(is_rubric), text)), text)


def is_keyword_list(expected) -> Column:
    """At least two words, short on average, and no sentence end."""
    expected = as_column(expected)
    words = split_words(expected)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    mean_length = F.try_divide(letters, F.size(words))
    return F.coalesce(
        (F.size(words) >= 2) & (mean_length <= fv.KEYWORD_MAX_MEAN_LENGTH)
        & ~expected.rlike(fv.SENTENCE_END),
        F.lit(False))


def judge_prompt_kind(expected, is_rubric) -> Column:
    return (F.when(as_column(is_rubric), "rubric")
            .when(is_keyword_list(expected), "keyword").otherwise("natural"))


def _block(title: str, text: Column) -> Column:
    return F.concat(F.lit(title + "\n"), text)


def _prompt(head: Column, main: Column | None, actual, input_text, variations, tail: str) -> Column:
    # NULL parts drop out of concat_ws, so optional blocks are just NULL
    given = as_column(input_text)
    items = as_column(variations)
    parts = [head, F.when(given.isNotNull(), F.concat(_block(fv.JUDGE_INPUT, given), F.lit("\n")))]
    if main is not None:
        parts.append(F.concat(main, F.lit("\n")))
    parts.append(_block(fv.JUDGE_ACTUAL, as_column(actual)))
    parts.append(F.when(F.size(items) > 0, F.concat(
        F.lit("\n" + fv.JUDGE_VARIATIONS + "\n"),
        F.concat_ws("\n", F.transform(items, lambda v: F.concat(F.lit("  - "), v))))))
    parts.append(F.lit("\n" + tail))
    return F.concat_ws("\n", *parts)


def keyword_judge_prompt(expected, actual, input_text, variations) -> Column:
    numbered = F.transform(
        split_words(expected),
        lambda w, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), w))
    head = F.concat_ws(
        "\n", F.lit("\n".join([*fv.JUDGE_KEYWORD_HEAD, fv.JUDGE_KEYWORD_LIST])),
        F.concat_ws("\n", numbered), F.lit("\n".join(fv.JUDGE_KEYWORD_RULE)))
    return _prompt(head, None, actual, input_text, variations, fv.JUDGE_KEYWORD_TAIL)


def natural_judge_prompt(expected, actual, input_text, variations) -> Column:
    return _prompt(F.lit("\n".join(fv.JUDGE_NATURAL_HEAD)),
                   _block(fv.JUDGE_EXPECTED, as_column(expected)),
                   actual, input_text, variations, fv.JUDGE_NATURAL_TAIL)


def rubric_judge_prompt(rubric, actual, input_text, variations) -> Column:
    """rubric is JSON text, or NULL on rows that are not rubric rows."""
    return _prompt(F.lit("\n".join(fv.JUDGE_RUBRIC_HEAD)),
                   _block(fv.JUDGE_RUBRIC, _json_text(2)(as_column(rubric))),
                   actual, input_text, variations, fv.JUDGE_RUBRIC_TAIL)


def _to_number(text: Column) -> Column:
    # full-width digits count as digits
    return F.translate(text, "０１２３４５６７８９", "0123456789").try_cast("double")


def reply_body(text) -> Column:
    """The first fenced block of a trimmed reply, or all of it."""
    text = as_column(text)
    return F.when(text.rlike(fv.REPLY_FENCE),
                  strip(F.regexp_extract(text, fv.REPLY_FENCE, 1))).otherwise(text)


def score_of_reply(text, data) -> Column:
    """Struct (score, reason) of a trimmed reply and its body as variant; NULL
    score when unreadable.

    Tried in turn: a JSON object with a numeric score, the word score followed
    by a number, a bare number."""
    text, data = as_column(text), as_column(data)
    raw = F.try_variant_get(data, "$.score", "variant")
    is_text = F.schema_of_variant(raw) == "STRING"
    numeric = F.try_variant_get(data, "$.score", "string").rlike(fv.NUMERIC_TEXT)
    from_json = F.when(~is_text | numeric, F.try_variant_get(data, "$.score", "double"))
    worded = _to_number(F.nullif(F.regexp_extract(text, fv.REPLY_SCORE, 1), F.lit("")))
    bare = F.when(text.rlike(fv.REPLY_BARE), _to_number(text))
    score = F.coalesce(from_json, worded, bare)
    return F.struct(
        F.when(score.isNotNull(), clamp01(score)).alias("score"),
        F.when(from_json.isNotNull(), F.try_variant_get(data, "$.reason", "string")).alias("reason"))
