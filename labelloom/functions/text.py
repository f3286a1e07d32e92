"""Cleaning, tokenising and n-gram expressions over text columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and replacement tokens that decide every cleaned text.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
EDGE_WHITESPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
NON_SPACE = r"[^\s\x1c-\x1f]"
ANONYMISED = r"(?U)\bx{2,}\b"
DIGITS = r"(?U)\d+"
TFIDF_DROPPED = r"[^a-z]+"
NEURAL_DROPPED = r"[^a-z<>']+"
NUMBER_WORD = " num "
ANON_TOKEN = " <anon> "
NUMBER_TOKEN = " <num> "
ALPHA_RUN = r"[a-z]+"
NON_ALPHA_PATTERN = r"[^a-zA-Z ]"
ANON_PATTERN = r"X{3,}"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``let value in body``: the value is computed once per row however often ``body`` mentions it."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends; SQL ``trim`` removes spaces only."""
    return F.regexp_replace(text, EDGE_WHITESPACE, "")


def has_text(text: Column) -> Column:
    """Whether anything is left after stripping; stops at the first such character."""
    return F.rlike(text, F.lit(f"(?U){NON_SPACE}"))


def stripped_longer_than(text: Column, limit: int) -> Column:
    """Whether the stripped text has more than ``limit`` (at least 1) characters.

    Two non-space characters with ``limit - 1`` or more characters between them decide it, so the match
    ends near the start of a long text instead of rewriting all of it.
    """
    return F.rlike(text, F.lit(f"(?Us){NON_SPACE}.{{{limit - 1},}}?{NON_SPACE}"))


def text_key(text: Column) -> Column:
    """Lower-cased text with whitespace runs collapsed to one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), WHITESPACE, " "))


def key_digest(key: Column) -> Column:
    """SHA-256 of a text key, as hex: what groupings and joins shuffle in place of the text."""
    return F.sha2(key, 256)


def tfidf_clean(text: Column) -> Column:
    """Letters-only text: anonymised words vanish, digit runs become ``num``."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    without_anon = F.regexp_replace(lowered, ANONYMISED, " ")
    with_numbers = F.regexp_replace(without_anon, DIGITS, NUMBER_WORD)
    return F.trim(F.regexp_replace(with_numbers, TFIDF_DROPPED, " "))


def neural_clean(text: Column) -> Column:
    """Letters, apostrophes and the ``<anon>`` / ``<num>`` markers."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    with_anon = F.regexp_replace(lowered, ANONYMISED, ANON_TOKEN)
    with_numbers = F.regexp_replace(with_anon, DIGITS, NUMBER_TOKEN)
    return F.trim(F.regexp_replace(with_numbers, NEURAL_DROPPED, " "))


def simple_tokenize(text: Column) -> Column:
    """Tokens of the neural cleaning; an empty text has none."""
    return F.filter(F.split(neural_clean(text), " "), lambda t: t != "")


def alpha_tokens(text: Column) -> Column:
    """Every run of ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(ALPHA_RUN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words of two letters or more of the TF-IDF cleaning."""
    return F.filter(F.split(tfidf_clean(text), " "), lambda t: F.length(t) >= 2)


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """Space-joined runs of ``low`` to ``high`` adjacent tokens, shorter runs first."""

    def grams(words: Column) -> Column:
        sized, current = [], words
        for n in range(1, high + 1):
            if n > 1:
                pairs = F.greatest(F.size(words) - (n - 1), F.lit(0))
                current = F.zip_with(
                    F.slice(current, F.lit(1), pairs),
                    F.slice(words, F.lit(n), pairs),
                    lambda left, right: F.concat(left, F.lit(" "), right),
                )
            if n >= low:
                sized.append(current)
        return F.concat(*sized)

    return bind(tokens, grams)


def char_wb_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside space-padded words; a padded word shorter than ``low`` counts once."""

    def windows(word: Column, n: int) -> Column:
        return F.when(
            F.length(word) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda at: F.substring(word, at, F.lit(n))
            ),
        ).otherwise(F.array().cast("array<string>"))

    def grams(word: Column) -> Column:
        short = F.when(F.length(word) < low, F.array(word)).otherwise(F.array().cast("array<string>"))
        return F.concat(short, *[windows(word, n) for n in range(low, high + 1)])

    words = F.filter(F.split(text_key(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, grams))


def term_counts(terms: Column) -> Column:
    """Distinct terms of one row with their counts, as ``array<struct<term, tf>>``.

    Counting is done inside the row (sort, then run lengths), so no shuffle on (row, term) is needed.
    """

    def counted(ordered: Column) -> Column:
        total = F.size(ordered)
        starts = F.filter(
            F.sequence(F.lit(0), total - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return bind(
            starts,
            lambda first: F.transform(
                first,
                lambda at, j: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(first, j + 1), total) - at).cast("long").alias("tf"),
                ),
            ),
        )

    return F.when(F.size(terms) > 0, bind(F.sort_array(terms), counted)).otherwise(
        F.array().cast("array<struct<term:string,tf:bigint>>")
    )


def items(array: Column) -> Column:
    """The array itself, to be handed to ``explode``.

    Spark adds a size test below a generator over a plain column and pushes it down to where the column is
    computed, which would tokenise every text twice. It leaves a generator over an expression alone.
    """
    return F.filter(array, lambda item: item.isNotNull())


def pattern_share(text: Column, pattern: str) -> Column:
    """Aggregate: share of rows whose text matches; null counts as no match."""
    return F.avg(F.coalesce(F.rlike(text, F.lit(pattern)), F.lit(False)).cast("double"))
