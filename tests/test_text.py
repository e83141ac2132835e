import unicodedata

import pytest
from pyspark.sql import functions as F

from shotcurve import fixed_values as fv
from shotcurve.functions import text
from shotcurve.operators import scoring


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("given, wanted", [
    ("```python\nprint(1)\n```", "print(1)\n"),
    ("use `code` here", "use code here"),
    ("- one\n* two\n• three", "one\ntwo\nthree"),
    ("1. one\n22. two", "one\ntwo"),
    ("plain - text 1. x", "plain - text 1. x"),
    ("", ""),
])
def test_remove_markdown(spark, given, wanted):
    assert one(spark, text.remove_markdown, given) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("  Hello   World ", "hello world"),
    ("ＡＢＣ１２３", "abc123"),
    ("ﾃｽﾄ", "テスト"),
    ("a　b\x1cc", "a b c"),
    ("É́ é", "é́ é"),
    ("```\n①\n```", "1"),
    (None, None),
])
def test_normalize(spark, given, wanted):
    assert one(spark, text.normalize_text, given) == wanted


def test_stable_characters_really_are_stable():
    ranges = [("À", "ÿ"), ("–", "–"), ("—", "—"), ("‘", "•"), ("、", "。"), ("ぁ", "ゔ"), ("ァ", "ヺ"), ("ー", "ー"), ("一", "鿿")]
    chars = [chr(c) for a, b in ranges for c in range(ord(a), ord(b) + 1)]
    assert fv.NFKC_STABLE == "À-ÿ–—‘-•、。ぁ-ゔァ-ヺー一-鿿"
    joined = "".join(chars)
    assert unicodedata.normalize("NFKC", joined) == joined
    assert unicodedata.normalize("NFKC", "a".join(chars)) == "a".join(chars)
    assert not any(unicodedata.combining(c) for c in chars)


@pytest.mark.parametrize("given, wanted", [
    ("one two three", ["one", "two", "three"]),
    ("category: billing", ["category", ":", "billing"]),
    ("東京タワーへ行く", ["東京", "タワー", "へ", "行", "く"]),
    ("abc123!?é", ["abc123", "!?", "é"]),
    ("", []),
])
def test_tokenize(spark, given, wanted):
    assert one(spark, text.tokenize, given) == wanted


def scores(spark, scorer, pairs):
    df = spark.createDataFrame(pairs, "expected_output string, actual_output string")
    return [r["score"] for r in scorer(df).collect()]


def test_scores(spark):
    assert scores(spark, scoring.score_exact_match, [("Yes", " yes "), ("a", "b"), ("", "")]) == [1.0, 0.0, 1.0]
    assert scores(spark, scoring.score_contains, [("pos", "It is POSITIVE"), ("", "x"), ("x", "y")]) == [1.0, 1.0, 0.0]
    assert scores(spark, scoring.score_f1, [("a b c", "a b c"), ("a b c", "a b d"), ("", ""), ("x", "")]) == [
        1.0, pytest.approx(2 / 3), 0.0, 0.0]


def plain_tokens(t):
    words = t.split()
    if len(words) >= 3:
        return words

    def kind(c):
        for lo, hi, name in ((0x3040, 0x309F, "h"), (0x30A0, 0x30FF, "k"), (0x4E00, 0x9FFF, "j")):
            if lo <= ord(c) <= hi:
                return name
        return "n" if c.isascii() and c.isalnum() else "s" if c.isascii() else "o"
    out, last = [], None
    for c in t:
        k = None if c == " " else kind(c)
        if k is not None:
            if k == last:
                out[-1] += c
            else:
                out.append(c)
        last = k
    return out


def plain_f1(e, a):
    et, at = set(plain_tokens(e)), set(plain_tokens(a))
    if not et or not at:
        return 0.0
    common = len(et & at)
    p = common / len(at) if common else sum(len(t) >= 2 and t in e for t in at) / len(at)
    r = common / len(et) if common else sum(len(t) >= 2 and t in a for t in et) / len(et)
    return 2 * p * r / (p + r) if p + r else 0.0


def test_f1_against_brute_force(spark):
    import random
    rng = random.Random(3)
    alphabet = ["ab", "cat", "猫", "ネコ", "ねこ", "x", ":", " ", " ", "é", "7"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(9))).strip() for _ in range(600)]
    texts = [" ".join(t.split()) for t in texts]
    pairs = list(zip(texts[::2], texts[1::2]))
    assert scores(spark, scoring.score_f1, pairs) == pytest.approx([plain_f1(e, a) for e, a in pairs], abs=1e-12)
