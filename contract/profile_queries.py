"""Profiles of tables, lengths and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract import sql as Q
from contract.prepare_queries import _GAPPY
from contract.registry import query
from contract.tables import complaints, gappy_complaints, marked_complaints, split_of, table
from labelloom.operators import profile as D
from labelloom.schema import NARRATIVE, RECORD_ID

_EDA = """
eda AS (
  SELECT doc_id AS record_id, text, lang AS product, source AS issue, lang || '|' || source AS category
  FROM documents WHERE length(text) > 20 AND lang IS NOT NULL AND source IS NOT NULL
),
sizes AS (SELECT category, count(*) AS n FROM eda GROUP BY category)"""


def _eda(spark, sf_dir):
    return D.eda_slice(complaints(spark, sf_dir))


@query(Q.with_(_GAPPY, """
SELECT column_name, CASE WHEN column_name = 'record_id' THEN 'bigint' ELSE 'string' END AS column_type,
       non_null_count, n_rows, CAST(4 AS BIGINT) AS n_columns
FROM (SELECT count(*) AS n_rows, count(record_id) AS record_id,
             count(narrative) AS consumer_complaint_narrative, count(product) AS product, count(issue) AS issue
      FROM gappy)
UNPIVOT (non_null_count FOR column_name IN (record_id, consumer_complaint_narrative, product, issue))"""))
def table_profile(spark, sf_dir):
    return D.table_profile(gappy_complaints(spark, sf_dir))


@query(Q.with_(_GAPPY, """
SELECT column_name, null_percent
FROM (SELECT 100e0 * (count(*) - count(record_id)) / count(*) AS record_id,
             100e0 * (count(*) - count(narrative)) / count(*) AS consumer_complaint_narrative,
             100e0 * (count(*) - count(product)) / count(*) AS product,
             100e0 * (count(*) - count(issue)) / count(*) AS issue FROM gappy)
UNPIVOT (null_percent FOR column_name IN (record_id, consumer_complaint_narrative, product, issue))"""))
def null_share_top(spark, sf_dir):
    return D.null_share_top(gappy_complaints(spark, sf_dir)).withColumn(
        "null_percent", F.round("null_percent", 9)
    )


@query(Q.with_(_GAPPY, """
SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS DOUBLE) / sum(n) AS duplicate_share
FROM (SELECT count(*) AS n FROM gappy GROUP BY narrative, product, issue)"""))
def duplicate_share(spark, sf_dir):
    return D.duplicate_share(gappy_complaints(spark, sf_dir).drop(RECORD_ID))


@query("SELECT year(o_orderdate) AS year, count(*) AS n_rows FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def yearly_counts(spark, sf_dir):
    return D.yearly_counts(table(spark, sf_dir, "orders"), "o_orderdate")


@query(Q.with_(_GAPPY, """
SELECT narrative IS NULL AS text_missing, count(*) AS n_rows,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM gappy) AS share
FROM gappy GROUP BY 1"""))
def text_availability(spark, sf_dir):
    return D.text_availability(gappy_complaints(spark, sf_dir))


@query(Q.with_(_GAPPY + f""",
marked AS (SELECT product, (narrative IS NOT NULL AND {Q.strip('narrative')} <> '') AS has_text FROM gappy),
shares AS (
  SELECT product, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM marked WHERE product IS NOT NULL) AS raw_share,
         CAST(nullif(count(*) FILTER (has_text), 0) AS DOUBLE)
           / (SELECT count(*) FROM marked WHERE has_text AND product IS NOT NULL) AS text_share
  FROM marked WHERE product IS NOT NULL GROUP BY product
)""", """
SELECT product, raw_share, text_share, text_share - raw_share AS delta FROM shares
ORDER BY delta DESC NULLS LAST, product LIMIT 15"""))
def selection_bias(spark, sf_dir):
    return D.selection_bias(gappy_complaints(spark, sf_dir))


def _describe_sql(source: str, value: str) -> str:
    return f"""
SELECT count(*) AS count, round(avg({value}), 6) AS mean, round(stddev_samp({value}), 6) AS std,
       CAST(min({value}) AS DOUBLE) AS min, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q25,
       quantile_cont(CAST({value} AS DOUBLE), 0.5) AS q50, quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q75,
       CAST(max({value}) AS DOUBLE) AS max
FROM {source}"""


def _rounded(df):
    return df.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(_describe_sql("(SELECT length(text) AS v FROM documents)", "v"))
def length_describe(spark, sf_dir):
    return _rounded(D.length_describe(complaints(spark, sf_dir)))


@query(Q.with_(_EDA, "SELECT record_id, category, length(text) AS n_chars FROM eda"))
def eda_slice(spark, sf_dir):
    return _eda(spark, sf_dir).select(RECORD_ID, "category", F.length(NARRATIVE).alias("n_chars"))


@query(Q.with_(_EDA, f"""
SELECT count AS n_classes, CAST(0 AS BIGINT) AS n_missing, mean, std, min, q25, q50, q75, max
FROM ({_describe_sql('sizes', 'n')})"""))
def class_count_describe(spark, sf_dir):
    return _rounded(D.class_count_describe(_eda(spark, sf_dir)))


@query(Q.with_(_EDA, """
SELECT count(*) FILTER (n > 1000) AS head_gt_1000, count(*) FILTER (n BETWEEN 100 AND 1000) AS mid_100_1000,
       count(*) FILTER (n < 100) AS tail_lt_100 FROM sizes"""))
def longtail_buckets(spark, sf_dir):
    return D.longtail_buckets(_eda(spark, sf_dir))


@query(Q.with_(_EDA, """
SELECT row_number() OVER (ORDER BY n DESC, category) AS class_rank, category, n AS n_rows FROM sizes"""))
def longtail_curve(spark, sf_dir):
    return D.longtail_curve(_eda(spark, sf_dir))


def _histogram_sql(source: str, bins: int) -> str:
    return f"""
SELECT least(floor(CASE WHEN hi = lo THEN 0e0 ELSE CAST(v - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) * {bins} END),
             {bins - 1})::BIGINT AS bin, count(*) AS n_rows, min(v) AS least
FROM {source}, (SELECT min(v) AS lo, max(v) AS hi FROM {source}) GROUP BY 1"""


@query(Q.with_(_EDA + ", lengths AS (SELECT length(text) AS v FROM eda)", _histogram_sql("lengths", 50)))
def length_histogram(spark, sf_dir):
    return D.length_histogram(_eda(spark, sf_dir))


_TOKEN_LENGTHS = f"""
lengths AS (SELECT len({Q.words(Q.neural_clean(Q.MARKED))}) AS v FROM prepared WHERE split = 'train')"""


def _train_marked(spark, sf_dir):
    return split_of(spark, sf_dir, "train").withColumn(NARRATIVE, F.concat(NARRATIVE, F.lit(" XXXX 12/03 don't")))


@query(Q.with_(Q.PREPARED + "," + _TOKEN_LENGTHS, """
SELECT metric, round(value, 6) AS value FROM (
  SELECT CAST(min(v) AS DOUBLE) AS "min", CAST(max(v) AS DOUBLE) AS "max",
         quantile_cont(CAST(v AS DOUBLE), 0.5) AS median, quantile_cont(CAST(v AS DOUBLE), 0.9) AS p90,
         quantile_cont(CAST(v AS DOUBLE), 0.95) AS p95, quantile_cont(CAST(v AS DOUBLE), 0.99) AS p99,
         100e0 * count(*) FILTER (v > 128) / count(*) AS "% > 128",
         100e0 * count(*) FILTER (v > 256) / count(*) AS "% > 256",
         100e0 * count(*) FILTER (v > 384) / count(*) AS "% > 384"
  FROM lengths)
UNPIVOT (value FOR metric IN ("min", "max", median, p90, p95, p99, "% > 128", "% > 256", "% > 384"))"""))
def token_length_stats(spark, sf_dir):
    return D.token_length_stats(_train_marked(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(Q.with_(Q.PREPARED + "," + _TOKEN_LENGTHS, f"""
SELECT *, least <= (SELECT quantile_cont(CAST(v AS DOUBLE), 0.995) FROM lengths) AS shown
FROM ({_histogram_sql('lengths', 80)})"""))
def token_length_histogram(spark, sf_dir):
    return D.token_length_histogram(_train_marked(spark, sf_dir))


@query(Q.with_(_EDA, """
SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM eda)
GROUP BY token ORDER BY freq DESC, token LIMIT 40"""))
def top_tokens(spark, sf_dir):
    return D.top_tokens(_eda(spark, sf_dir))
