from __future__ import annotations

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelloom.functions import scores as SC
from labelloom.functions import text as T


def values(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("Fee of 35.50 EUR -- charged 2x by xxxx, Unit #7!", "fee of num num eur charged num x by unit num"),
        ("xxxx1234", "xxxx num"),
        ("Café", "caf"),
        ("x xx xxx", "x"),
        ("", ""),
        (None, ""),
        ("XX/XX/2015", "num"),
    ],
)
def test_tfidf_clean_examples(spark, text, cleaned):
    assert values(spark, T.tfidf_clean, [text]) == [cleaned]


@pytest.mark.parametrize(
    "text, cleaned",
    [
        ("Order No. 9 (XXXXXX) isn't here; they've lost 2?", "order no <num> <anon> isn't here they've lost <num>"),
        ("it's <b>fine</b>", "it's <b>fine< b>"),
        (None, ""),
    ],
)
def test_neural_clean_examples(spark, text, cleaned):
    assert values(spark, T.neural_clean, [text]) == [cleaned]


def plain_tfidf(text):
    step = re.sub(r"\bx{2,}\b", " ", text.strip().lower())
    return " ".join(re.sub(r"[^a-z]", " ", re.sub(r"\d+", " num ", step)).split())


def plain_neural(text):
    step = re.sub(r"\bx{2,}\b", " <anon> ", text.strip().lower())
    return " ".join(re.sub(r"[^a-z<>']", " ", re.sub(r"\d+", " <num> ", step)).split())


def plain_char_wb(text, low, high):
    grams = []
    for word in text.lower().split():
        padded = f" {word} "
        if len(padded) < low:
            grams.append(padded)
        for n in range(low, high + 1):
            grams += [padded[i : i + n] for i in range(len(padded) - n + 1)]
    return grams


ALPHABET = "aXxYz 09\t\n\x0b\x1c  　'<>.!$|-é１"


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=40, max_size=60))
def test_expressions_equal_plain_python(spark, texts):
    assert values(spark, T.text_key, texts) == [re.sub(r"\s+", " ", t.strip().lower()) for t in texts]
    assert values(spark, T.strip, texts) == [t.strip() for t in texts]
    assert values(spark, T.has_text, texts) == [t.strip() != "" for t in texts]
    for limit in (1, 2, 8):
        longer = values(spark, lambda t: T.stripped_longer_than(t, limit), texts)  # noqa: B023
        assert longer == [len(t.strip()) > limit for t in texts]
    assert values(spark, T.tfidf_clean, texts) == [plain_tfidf(t) for t in texts]
    assert values(spark, T.neural_clean, texts) == [plain_neural(t) for t in texts]
    assert values(spark, T.simple_tokenize, texts) == [plain_neural(t).split() for t in texts]
    assert values(spark, T.alpha_tokens, texts) == [re.findall("[a-z]+", t.lower()) for t in texts]
    words = [[w for w in plain_tfidf(t).split() if len(w) > 1] for t in texts]
    assert values(spark, T.word_tokens, texts) == words
    pairs = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    assert values(spark, lambda t: T.word_ngrams(T.word_tokens(t)), texts) == pairs
    grams = values(spark, lambda t: T.char_wb_ngrams(t, 3, 5), texts)
    assert [Counter(g) for g in grams] == [Counter(plain_char_wb(t, 3, 5)) for t in texts]
    counted = values(spark, lambda t: T.term_counts(T.word_ngrams(T.word_tokens(t))), texts)
    assert [{r["term"]: r["tf"] for r in row} for row in counted] == [dict(Counter(p)) for p in pairs]


def test_ngram_ranges(spark):
    def run(low, high):
        return values(spark, lambda t: T.word_ngrams(F.split(t, " "), low, high), ["aa bb cc", "aa"])

    assert run(2, 3) == [["aa bb", "bb cc", "aa bb cc"], []]
    assert run(1, 1) == [["aa", "bb", "cc"], ["aa"]]
    assert values(spark, lambda t: T.char_wb_ngrams(t, 4, 5), ["a"]) == [[" a "]]


def test_pattern_share_counts_null_as_no_match(spark):
    df = spark.createDataFrame([("XXX",), ("abc",), (None,), ("XX",)], "t string")
    assert df.agg(T.pattern_share(F.col("t"), T.ANON_PATTERN)).first()[0] == 0.25


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 2), ([0.0, 1000.0, 5.0], 0)], "s array<double>, y int")
    best = [r[0] for r in df.select(SC.argmax_index(F.col("s"))).collect()]
    assert best == [1, 1]
    proba = [r[0] for r in df.select(SC.softmax(F.col("s"))).collect()]
    assert all(abs(sum(p) - 1) < 1e-12 for p in proba) and proba[1][1] == 1.0
    hits = [tuple(r) for r in df.select(*[SC.in_top_k(F.col("s"), F.col("y"), k) for k in (1, 2, 3)]).collect()]
    assert hits == [(True, True, True), (False, False, True)]
