"""Cleaning, tokens and n-grams over every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as Q
from contract.registry import query
from contract.tables import complaints, marked_complaints
from labelloom.functions import text as T
from labelloom.operators import features as X
from labelloom.operators import profile as D
from labelloom.schema import NARRATIVE, RECORD_ID


def _text():
    return F.col(NARRATIVE)


@query(f"SELECT doc_id AS record_id, {Q.text_key(Q.MARKED)} AS text_key FROM documents")
def text_key(spark, sf_dir):
    return marked_complaints(spark, sf_dir).select(RECORD_ID, T.text_key(_text()).alias("text_key"))


@query(f"SELECT doc_id AS record_id, {Q.tfidf_clean(Q.MARKED)} AS cleaned FROM documents")
def tfidf_clean(spark, sf_dir):
    return marked_complaints(spark, sf_dir).select(RECORD_ID, T.tfidf_clean(_text()).alias("cleaned"))


@query(f"SELECT doc_id AS record_id, {Q.neural_clean(Q.MARKED)} AS cleaned FROM documents")
def neural_clean(spark, sf_dir):
    return marked_complaints(spark, sf_dir).select(RECORD_ID, T.neural_clean(_text()).alias("cleaned"))


def _listed(df, terms, separator=" "):
    listed = df.select(RECORD_ID, terms.alias("terms"))
    return listed.select(
        RECORD_ID, F.size("terms").alias("n_terms"), F.array_join("terms", separator).alias("terms")
    )


def _listed_sql(terms: str, separator: str = " ") -> str:
    return (
        f"SELECT record_id, len(t) AS n_terms, coalesce(array_to_string(t, '{separator}'), '') AS terms "
        f"FROM (SELECT doc_id AS record_id, {terms} AS t FROM documents)"
    )


@query(_listed_sql(Q.words(Q.neural_clean(Q.MARKED))))
def simple_tokenize(spark, sf_dir):
    return _listed(marked_complaints(spark, sf_dir), T.simple_tokenize(_text()))


@query(_listed_sql(f"regexp_extract_all(lower({Q.MARKED}), '[a-z]+')"))
def alpha_tokens(spark, sf_dir):
    return _listed(marked_complaints(spark, sf_dir), T.alpha_tokens(_text()))


@query(_listed_sql(Q.words(Q.tfidf_clean(Q.MARKED), 2)))
def word_tokens(spark, sf_dir):
    return _listed(marked_complaints(spark, sf_dir), T.word_tokens(_text()))


@query(f"""
SELECT record_id, len(g) AS n_terms, array_to_string(g, '/') AS terms FROM (
  SELECT record_id, {Q.bigrams('t')} AS g
  FROM (SELECT doc_id AS record_id, {Q.words(Q.tfidf_clean(Q.MARKED), 2)} AS t FROM documents))""")
def word_ngrams(spark, sf_dir):
    return _listed(marked_complaints(spark, sf_dir), T.word_ngrams(T.word_tokens(_text())), "/")


def _windows(n: int) -> str:
    return (
        f"CASE WHEN length(p) >= {n} THEN list_transform(range(1, length(p) - {n - 2}), "
        f"lambda i: substr(p, i, {n})) ELSE [] END"
    )


@query(f"""
WITH padded AS (
  SELECT doc_id, ' ' || unnest({Q.words(Q.text_key('text'))}) || ' ' AS p FROM documents
),
word_counts AS (SELECT doc_id, p, count(*) AS n FROM padded GROUP BY doc_id, p),
grams AS (
  SELECT doc_id, n, unnest(list_concat(CASE WHEN length(p) < 3 THEN [p] ELSE [] END,
                                       {_windows(3)}, {_windows(4)}, {_windows(5)})) AS term
  FROM word_counts
)
SELECT term, count(DISTINCT doc_id) AS df, CAST(sum(n) AS BIGINT) AS cf FROM grams GROUP BY term""")
def char_wb_ngrams(spark, sf_dir):
    docs = complaints(spark, sf_dir).select(T.char_wb_ngrams(_text(), 3, 5).alias("terms"))
    return X.term_stats(docs)


@query(f"""
SELECT avg(CASE WHEN regexp_matches({Q.MARKED}, 'X{{3,}}') THEN 1e0 ELSE 0e0 END) AS marked_share,
       avg(CASE WHEN regexp_matches(text, '[0-9]') THEN 1e0 ELSE 0e0 END) AS digit_share
FROM documents""")
def pattern_share(spark, sf_dir):
    return complaints(spark, sf_dir).agg(
        T.pattern_share(F.concat(_text(), F.lit(" XXXX 12/03 don't")), T.ANON_PATTERN).alias("marked_share"),
        T.pattern_share(_text(), "[0-9]").alias("digit_share"),
    )


@query(f"""
SELECT avg(CASE WHEN regexp_matches({Q.MARKED}, '[^a-zA-Z ]') THEN 1e0 ELSE 0e0 END) AS non_alpha_share,
       avg(CASE WHEN regexp_matches({Q.MARKED}, 'X{{3,}}') THEN 1e0 ELSE 0e0 END) AS anonymised_share
FROM documents WHERE length({Q.MARKED}) > 20""")
def pattern_shares(spark, sf_dir):
    return D.pattern_shares(D.eda_slice(marked_complaints(spark, sf_dir)))
