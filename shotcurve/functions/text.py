"""Text cleaning, tokenizing and pair scoring as Column expressions."""

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotcurve import fixed_values as fv

WHITESPACE_RUN = f"(?U){fv.WHITESPACE}+"
_WS_EDGES = f"(?U)^{fv.WHITESPACE}+|{fv.WHITESPACE}+$"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nfkc():
    # Nested, so that it travels to workers by value. Arrow's own utf8_normalize
    # decomposes but does not compose again, so it will not do.
    def normalize(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t)
                         for t in texts.to_pylist()], pa.string())
    return F.arrow_udf(normalize, T.StringType())


def _nfkc_changes(c: Column) -> Column:
    # ASCII texts pass on their size alone; only other characters are looked at
    beyond_ascii = F.regexp_replace(c, r"[\x00-\x7f]+", "")
    return (F.octet_length(c) != F.char_length(c)) & beyond_ascii.rlike(f"[^{fv.NFKC_STABLE}]")


def nfkc(c, source=None) -> Column:
    """NFKC form. Only rows holding a character NFKC might change reach Python.
    source is the text c was cut from, if there is one: searched in its place,
    it saves working out c twice."""
    c = as_column(c)
    affected = _nfkc_changes(c if source is None else as_column(source))
    return F.coalesce(_nfkc()(F.when(affected, c)), c)


def strip(c) -> Column:
    """Drop whitespace of any kind at both ends."""
    return F.regexp_replace(as_column(c), _WS_EDGES, "")


def split_words(c) -> Column:
    """Whitespace-separated words; no empty strings, [] for blank text."""
    return F.array_remove(F.split(as_column(c), WHITESPACE_RUN), "")


def remove_markdown(c) -> Column:
    """Unwrap fenced and inline code, drop bullets and list numbering."""
    c = F.regexp_replace(as_column(c), fv.FENCED_CODE, "$1")
    c = F.regexp_replace(c, fv.INLINE_CODE, "$1")
    c = F.regexp_replace(c, fv.BULLET, "")
    return F.regexp_replace(c, fv.NUMBERING, "")


def normalize_text(c) -> Column:
    """Markdown removed, NFKC, lower case, single spaces, trimmed."""
    c = F.lower(nfkc(remove_markdown(c), source=c))
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def char_type_runs(c) -> Column:
    """Maximal runs of one character class; a space ends a run."""
    return F.regexp_extract_all(as_column(c), F.lit(fv.CHARACTER_RUNS), F.lit(0))


def tokenize(c) -> Column:
    """Words when there are at least three, else character-class runs."""
    c = as_column(c)
    return F.when(c.rlike(fv.THREE_WORDS), split_words(c)).otherwise(char_type_runs(c))


def exact_match_score(norm_expected, norm_actual) -> Column:
    return (as_column(norm_expected) == as_column(norm_actual)).cast("double")


def contains_score(norm_expected, norm_actual) -> Column:
    return F.contains(as_column(norm_actual), as_column(norm_expected)).cast("double")


def common_tokens(expected_tokens, actual_tokens) -> Column:
    return F.size(F.array_intersect(as_column(expected_tokens), as_column(actual_tokens)))


def token_set_f1(expected_tokens, actual_tokens, common, norm_expected, norm_actual) -> Column:
    """F1 over token sets. With no common token, tokens found inside the other
    text count instead, in both directions.

    With precision x/a and recall y/e, F1 = 2xy / (xe + ya); both are the
    common tokens in the first case, which leaves 2x / (a + e)."""
    et, at, common = as_column(expected_tokens), as_column(actual_tokens), as_column(common)
    n_e, n_a = F.size(et), F.size(at)

    def hits(tokens, text):
        return F.size(F.filter(
            tokens,
            lambda t: (F.length(t) >= fv.MIN_PARTIAL_LENGTH) & F.contains(text, t)))

    x, y = hits(at, as_column(norm_expected)), hits(et, as_column(norm_actual))
    return (
        F.when(common.isNull(), F.lit(None).cast("double"))
        .when((n_e == 0) | (n_a == 0), F.lit(0.0))
        .when(common > 0, 2.0 * common / (n_a + n_e))
        .otherwise(F.coalesce(F.try_divide(2.0 * x * y, x * n_e + y * n_a), F.lit(0.0))))


def f1_score(norm_expected, norm_actual) -> Column:
    """F1 of two normalized texts."""
    et, at = F.array_distinct(tokenize(norm_expected)), F.array_distinct(tokenize(norm_actual))
    return token_set_f1(et, at, common_tokens(et, at), norm_expected, norm_actual)


def char_ngrams(c) -> Column:
    """2- to 4-character n-grams of each lower-cased word padded by one space
    on both sides, repeats kept. A word shorter than n gives no n-gram."""
    padded = F.transform(split_words(F.lower(as_column(c))),
                         lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, word_ngrams))


def word_ngrams(padded: Column) -> Column:
    """2- to 4-grams of one padded word."""
    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        return F.when(F.length(padded) >= n, grams).otherwise(F.array().cast("array<string>"))
    return F.concat(*map(of_size, fv.NGRAM_SIZES))


def clamp01(c) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_column(c)))
