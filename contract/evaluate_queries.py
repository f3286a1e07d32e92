"""Stored scores, metrics, frequency groups, tail errors and model comparison."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from contract import sql as Q
from contract.registry import query
from contract.tables import (
    frequency_groups,
    labelled,
    mean_class_size,
    pairs,
    predictions,
    shared,
    table,
    tail,
)
from labelloom.functions import scores as SC
from labelloom.operators import evaluate as E
from labelloom.operators import experiments as EX
from labelloom.operators import model as M
from labelloom.scale.staging import shared_dir
from labelloom.sources import writers as W
from labelloom.schema import NARRATIVE, RECORD_ID

# --- score arrays -----------------------------------------------------------------


@query("""
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS best, CAST(label AS BIGINT) AS label
FROM embeddings""")
def argmax_from_scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", SC.argmax_index(F.col("embedding")).alias("best"), "label")


@query("""
SELECT vec_id, round(list_max(p), 6) AS top_probability, round(p[label + 1], 6) AS label_probability FROM (
  SELECT vec_id, label, list_transform(e, lambda x: exp(x - list_max(e))
    / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS p
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""")
def softmax(spark, sf_dir):
    proba = table(spark, sf_dir, "embeddings").withColumn("p", SC.softmax(F.col("embedding")))
    return proba.select(
        "vec_id",
        F.round(F.array_max("p"), 6).alias("top_probability"),
        F.round(F.get("p", "label"), 6).alias("label_probability"),
    )


def _topk_sql(k: int) -> str:
    return f"avg(CASE WHEN len(list_filter(embedding, lambda s: s > embedding[label + 1])) < {k} THEN 1e0 ELSE 0e0 END)"


@query(f"SELECT {_topk_sql(3)} AS top3_accuracy FROM embeddings")
def top3_accuracy(spark, sf_dir):
    return E.topk_accuracy(table(spark, sf_dir, "embeddings"), 3, "embedding", "label")


@query(f"SELECT {_topk_sql(5)} AS top5_accuracy FROM embeddings")
def top5_accuracy(spark, sf_dir):
    return E.topk_accuracy(table(spark, sf_dir, "embeddings"), 5, "embedding", "label")


@query(Q.with_(Q.PREDICTIONS, """
SELECT record_id, y_true, y_pred, label_id, round(list_max(proba), 6) AS pred_confidence FROM predictions"""))
def predictions_from_scores(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        RECORD_ID, "y_true", "y_pred", "label_id", F.round(F.array_max("proba"), 6).alias("pred_confidence")
    )


# --- metrics ---------------------------------------------------------------------


@query(Q.with_(Q.METRICS, "SELECT category, tp, fp, fn, support FROM counts"))
def class_counts(spark, sf_dir):
    return E.class_counts(pairs(spark, sf_dir))


@query(Q.with_(Q.METRICS, "SELECT category, tp, fp, fn, support, precision, recall, f1 FROM metrics"))
def prf_support(spark, sf_dir):
    return E.prf_support(E.class_counts(pairs(spark, sf_dir)))


@query(Q.with_(Q.METRICS, "SELECT round(avg(f1), 9) AS macro_f1 FROM metrics"))
def macro_f1(spark, sf_dir):
    return E.macro_f1(prf_support(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(Q.with_(Q.PREDICTIONS, "SELECT avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS accuracy FROM predictions"))
def accuracy(spark, sf_dir):
    return E.accuracy(pairs(spark, sf_dir))


@query(Q.with_(Q.METRICS, "SELECT round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM metrics"))
def weighted_f1(spark, sf_dir):
    return E.weighted_f1(prf_support(spark, sf_dir)).select(F.round("weighted_f1", 9).alias("weighted_f1"))


@query(Q.with_(Q.METRICS, """
SELECT category AS label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support
FROM metrics
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 9), CAST(sum(support) AS BIGINT)
FROM metrics
UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9),
  CAST(sum(support) AS BIGINT) FROM metrics
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9),
  round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9),
  CAST(sum(support) AS BIGINT) FROM metrics"""))
def classification_report(spark, sf_dir):
    report = E.classification_report(pairs(spark, sf_dir))
    return report.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(Q.with_(Q.METRICS, """
SELECT round((SELECT avg(f1) FROM metrics), 9) AS macro_f1,
       avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS accuracy,
       avg(CASE WHEN len(list_filter(scores, lambda s: s > scores[label_id + 1])) < 3 THEN 1e0 ELSE 0e0 END)
         AS top3_accuracy,
       avg(CASE WHEN len(list_filter(scores, lambda s: s > scores[label_id + 1])) < 5 THEN 1e0 ELSE 0e0 END)
         AS top5_accuracy,
       count(*) AS n_test_samples, (SELECT count(*) FROM labels_by_id) AS n_labels
FROM predictions"""))
def overall_summary(spark, sf_dir):
    n_labels = shared(spark, sf_dir).labels.count()
    summary = E.overall_summary(predictions(spark, sf_dir), n_labels)
    return summary.withColumn("macro_f1", F.round("macro_f1", 9))


@query(Q.with_(Q.FREQUENCY, "SELECT category, train_count, class_group FROM class_groups"))
def class_frequency_groups(spark, sf_dir):
    return frequency_groups(spark, sf_dir)


@query(Q.with_(Q.GROUP_METRICS + """,
inside AS (
  SELECT g.class_group, p.y_true, p.y_pred FROM predictions p JOIN class_groups g ON g.category = p.y_true
),
group_sides AS (
  SELECT class_group, y_true AS category, CAST(y_true = y_pred AS BIGINT) AS tp, 1 AS n FROM inside
  UNION ALL SELECT class_group, y_pred, 0, 1 FROM inside
),
group_f1 AS (
  SELECT class_group, avg(f1) AS macro_f1 FROM (
    SELECT class_group, category, CAST(2 * sum(tp) AS DOUBLE) / sum(n) AS f1
    FROM group_sides GROUP BY class_group, category) GROUP BY class_group
)""", """
SELECT i.class_group, (SELECT count(*) FROM class_groups c WHERE c.class_group = i.class_group) AS n_classes,
       count(*) AS n_samples_test, round(any_value(f.macro_f1), 9) AS macro_f1,
       avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS accuracy
FROM inside i JOIN group_f1 f USING (class_group) GROUP BY i.class_group"""))
def group_metrics(spark, sf_dir):
    grouped = E.group_metrics(pairs(spark, sf_dir), frequency_groups(spark, sf_dir))
    return grouped.withColumn("macro_f1", F.round("macro_f1", 9))


@query(Q.with_(Q.GROUP_METRICS, """
SELECT l.category, coalesce(m.support, 0) AS support_test, coalesce(m.precision, 0e0) AS precision,
       coalesce(m.recall, 0e0) AS recall, coalesce(m.f1, 0e0) AS f1, coalesce(g.class_group, 'unknown') AS class_group
FROM labels_by_id l LEFT JOIN metrics m USING (category) LEFT JOIN class_groups g USING (category)"""))
def per_class_report(spark, sf_dir):
    return E.per_class_report(
        pairs(spark, sf_dir), shared(spark, sf_dir).labels, frequency_groups(spark, sf_dir)
    )


@query(Q.with_(Q.PREDICTIONS, """
SELECT y_pred AS category, count(*) AS pred_count,
       CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM predictions) AS pred_share
FROM predictions GROUP BY y_pred"""))
def prediction_distribution(spark, sf_dir):
    return E.prediction_distribution(pairs(spark, sf_dir))


@query(Q.with_(Q.GROUP_METRICS + """,
head AS (
  SELECT category FROM class_groups WHERE class_group = 'head' ORDER BY train_count DESC, category LIMIT 20
)""", """
SELECT t.category AS y_true, s.category AS y_pred, count(p.record_id) AS n
FROM head t CROSS JOIN head s LEFT JOIN predictions p ON p.y_true = t.category AND p.y_pred = s.category
GROUP BY ALL"""))
def head_confusion(spark, sf_dir):
    return E.head_confusion(pairs(spark, sf_dir), frequency_groups(spark, sf_dir))


@query(Q.with_(Q.GROUP_METRICS + """,
head AS (
  SELECT category FROM class_groups WHERE class_group = 'head' ORDER BY train_count DESC, category LIMIT 20
),
cells AS (
  SELECT t.category AS y_true, s.category AS y_pred, count(p.record_id) AS n
  FROM head t CROSS JOIN head s LEFT JOIN predictions p ON p.y_true = t.category AND p.y_pred = s.category
  GROUP BY ALL
)""", """
SELECT y_true, string_agg(y_pred || '=' || n, ';' ORDER BY y_pred) AS predicted FROM cells GROUP BY y_true"""))
def head_confusion_wide(spark, sf_dir):
    """The matrix with one column per predicted label; its cells are told with their column names, which depend on the data."""
    wide = E.head_confusion_wide(pairs(spark, sf_dir), frequency_groups(spark, sf_dir))
    labels = [c for c in wide.columns if c != "y_true"]
    cells = [F.concat(F.lit(f"{c}="), F.col(f"`{c}`").cast("string")) for c in labels]
    return wide.select("y_true", F.concat_ws(";", *cells).alias("predicted"))


# --- tail errors -------------------------------------------------------------------


@query(Q.with_(Q.FREQUENCY, "SELECT category, train_count FROM train_counts, border WHERE train_count < m"))
def tail_classes(spark, sf_dir):
    return tail(spark, sf_dir)


@query(Q.with_(Q.TAIL, "SELECT * FROM tail_metrics"))
def tail_class_metrics(spark, sf_dir):
    return E.tail_class_metrics(pairs(spark, sf_dir), tail(spark, sf_dir))


@query(Q.with_(Q.TAIL, "SELECT * FROM worst"))
def worst_tail(spark, sf_dir):
    return E.worst_tail(tail_class_metrics(spark, sf_dir))


def _samples_sql(focus: str, other: str, name: str, direction: str) -> str:
    return Q.with_(Q.TAIL + f""",
wrong AS (
  SELECT w.category AS focus_class, p.record_id, p.y_true, p.y_pred, list_max(p.proba) AS pred_confidence,
         p.proba[l.label_id + 1] AS score, p.text
  FROM predictions p JOIN worst w ON w.category = p.{focus} JOIN labels_by_id l ON l.category = w.category
  WHERE p.{other} <> p.{focus}
)""", f"""
SELECT focus_class, record_id, y_true, y_pred, round(pred_confidence, 6) AS pred_confidence,
       round(score, 6) AS {name}, text AS consumer_complaint_narrative
FROM wrong
QUALIFY row_number() OVER (PARTITION BY focus_class ORDER BY score {direction}, record_id) <= 5""")


def _sampled(fn, name, spark, sf_dir):
    labels = shared(spark, sf_dir).labels
    rows = fn(predictions(spark, sf_dir, text=True), worst_tail(spark, sf_dir), labels, RECORD_ID, NARRATIVE)
    return rows.withColumns({c: F.round(c, 6) for c in ("pred_confidence", name)})


@query(_samples_sql("y_true", "y_pred", "true_class_proba", "ASC"))
def fn_samples(spark, sf_dir):
    return _sampled(E.fn_samples, "true_class_proba", spark, sf_dir)


@query(_samples_sql("y_pred", "y_true", "predicted_class_proba", "DESC"))
def fp_samples(spark, sf_dir):
    return _sampled(E.fp_samples, "predicted_class_proba", spark, sf_dir)


@query(Q.with_(Q.TAIL, """
SELECT (SELECT m FROM border) AS tail_threshold, CAST(20 AS BIGINT) AS worst_k, CAST(5 AS BIGINT) AS samples_per_class,
       count(*) AS n_tail_classes_train, count(*) FILTER (support_test > 0) AS n_tail_classes_with_test_support,
       round(avg(f1), 9) AS mean_tail_f1,
       (SELECT string_agg(category, '/' ORDER BY f1, support_test DESC, category) FROM worst) AS worst_classes
FROM tail_metrics"""))
def tail_summary(spark, sf_dir):
    metrics = tail_class_metrics(spark, sf_dir)
    summary = E.tail_summary(metrics, E.worst_tail(metrics), mean_class_size(spark, sf_dir))
    return summary.withColumns(
        {"mean_tail_f1": F.round("mean_tail_f1", 9), "worst_classes": F.array_join("worst_classes", "/")}
    )


# --- baseline and comparison ---------------------------------------------------------

_MAJORITY = """,
majority AS (
  SELECT category FROM prepared WHERE split = 'train' GROUP BY category ORDER BY count(*) DESC, category LIMIT 1
)"""


@query(Q.with_(Q.PREPARED + _MAJORITY, """
SELECT record_id, category AS y_true, (SELECT category FROM majority) AS y_pred FROM prepared WHERE split = 'test'"""))
def majority_baseline(spark, sf_dir):
    rows = labelled(spark, sf_dir, "test").select(RECORD_ID, F.col("category").alias("y_true"))
    return M.majority_baseline(labelled(spark, sf_dir, "train"), rows)


@query(Q.with_(Q.METRICS + _MAJORITY + """,
base_sides AS (
  SELECT category, CAST(category = (SELECT category FROM majority) AS BIGINT) AS tp, 1 AS support, 0 AS said FROM prepared
  UNION ALL SELECT (SELECT category FROM majority), 0, 0, 1 FROM prepared
),
base_metrics AS (
  SELECT CAST(2 * sum(tp) AS DOUBLE) / (sum(support) + sum(said)) AS f1, sum(support) AS support, sum(tp) AS tp
  FROM base_sides GROUP BY category
)""", """
SELECT 'stored_scores' AS model_name, 'test' AS split, 'scores.json' AS source,
       round(CAST(sum(tp) AS DOUBLE) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1,
       round(sum(f1 * support) / sum(support), 9) AS weighted_f1, 'flat' AS config_summary FROM metrics
UNION ALL
SELECT 'majority', 'test', 'baseline.json:run/test', round(CAST(sum(tp) AS DOUBLE) / sum(support), 9), round(avg(f1), 9),
       round(sum(f1 * support) / sum(support), 9), 'nested' FROM base_metrics
UNION ALL
SELECT 'accuracy_only', 'test', 'partial.json', round(CAST(sum(tp) AS DOUBLE) / sum(support), 9), NULL, NULL, 'absent'
FROM metrics"""))
def model_comparison(spark, sf_dir):
    """Records read from JSON files: a flat one, a nested one, one without two metrics, an empty one and one that is not there."""
    folder = f"{shared_dir(spark)}/records-{uuid4().hex}"
    stored = E.summary_metrics(pairs(spark, sf_dir))
    rows = labelled(spark, sf_dir).select(F.col("category").alias("y_true"))
    majority = E.summary_metrics(E.confusion_pairs(M.majority_baseline(labelled(spark, sf_dir, "train"), rows)))
    W.write_metadata(stored, f"{folder}/scores.json")
    W.write_metadata(majority.select(F.struct(F.struct("*").alias("test")).alias("run")), f"{folder}/baseline.json")
    W.write_metadata(stored.select("accuracy", F.lit("text").alias("note")), f"{folder}/partial.json")
    W.write_metadata(stored.select(F.struct("accuracy").alias("val")), f"{folder}/unfinished.json")

    def record(name, source, summary, *path):
        return EX.metrics_record(spark, f"{folder}/{source.split(':')[0]}", name, source, summary, path)

    compared = EX.compare_records(
        [
            record("stored_scores", "scores.json", "flat"), record("absent", "absent.json", ""),
            record("majority", "baseline.json:run/test", "nested", "run", "test"),
            record("accuracy_only", "partial.json", "absent"), record("unfinished", "unfinished.json:test", "", "test"),
        ]
    )
    return compared.withColumns({c: F.round(c, 9) for c in EX.METRIC_FIELDS})
