from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelloom.operators import evaluate as E


def predicted(spark, *pairs):
    return spark.createDataFrame(list(pairs), "y_true string, y_pred string")


def pairs_of(spark, *pairs):
    return E.confusion_pairs(predicted(spark, *pairs))


MIXED = [("a", "a")] * 3 + [("a", "b")] * 1 + [("b", "b")] * 2 + [("c", "a")] * 2 + [("b", "d")]


def test_perfect_predictions(spark):
    metrics = E.summary_metrics(pairs_of(spark, ("A", "A"), ("B", "B"), ("C", "C"))).first()
    assert metrics.asDict() == {"macro_f1": 1.0, "accuracy": 1.0, "weighted_f1": 1.0}


def test_counts_cover_labels_that_are_only_predicted(spark):
    rows = {r["category"]: r for r in E.prf_support(E.class_counts(pairs_of(spark, *MIXED))).collect()}
    assert {k: (r["tp"], r["fp"], r["fn"], r["support"]) for k, r in rows.items()} == {
        "a": (3, 2, 1, 4), "b": (2, 1, 1, 3), "c": (0, 0, 2, 2), "d": (0, 1, 0, 0),
    }
    assert rows["a"]["precision"] == 0.6 and rows["a"]["recall"] == 0.75
    assert rows["c"]["precision"] == 0.0 and rows["d"]["recall"] == 0.0
    f1 = [2 / 3, 2 / 3, 0, 0]
    pairs = pairs_of(spark, *MIXED)
    assert E.macro_f1(E.prf_support(E.class_counts(pairs))).first()[0] == pytest.approx(sum(f1) / 4)
    assert E.weighted_f1(E.prf_support(E.class_counts(pairs))).first()[0] == pytest.approx((4 * 2 / 3 + 3 * 2 / 3) / 9)
    assert E.accuracy(pairs).first()[0] == pytest.approx(5 / 9)


def test_report_has_the_three_summary_rows(spark):
    rows = {r["label"]: r for r in E.classification_report(pairs_of(spark, *MIXED)).collect()}
    assert set(rows) == {"a", "b", "c", "d", "accuracy", "macro avg", "weighted avg"}
    assert rows["accuracy"]["f1"] == pytest.approx(5 / 9) and rows["accuracy"]["precision"] is None
    assert rows["weighted avg"]["recall"] == pytest.approx(5 / 9) and rows["macro avg"]["support"] == 9


def test_frequency_groups(spark):
    train = spark.createDataFrame([(c,) for c, n in {"h": 10, "m": 5, "gap": 4, "t": 3}.items() for _ in range(n)], "category string")
    rows = {r["category"]: r["class_group"] for r in E.class_frequency_groups(train, "category", 10, 5, 3).collect()}
    assert rows == {"h": "head", "m": "mid", "gap": "mid", "t": "tail"}


def test_group_metrics_count_outside_predictions(spark):
    groups = spark.createDataFrame([("a", 9, "head"), ("b", 2, "tail"), ("z", 2, "mid")], "category string, train_count int, class_group string")
    rows = {r["class_group"]: r for r in E.group_metrics(pairs_of(spark, *MIXED), groups).collect()}
    assert set(rows) == {"head", "tail"}
    # In the head group, 'a' has tp 3, fn 1, and 'b' is predicted once without being true there.
    assert rows["head"]["macro_f1"] == pytest.approx((6 / 7 + 0) / 2)
    assert (rows["head"]["n_classes"], rows["head"]["n_samples_test"], rows["head"]["accuracy"]) == (1, 4, 0.75)


def test_per_class_report_and_distribution(spark):
    pairs = pairs_of(spark, *MIXED)
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("e", 2)], "category string, label_id int")
    groups = spark.createDataFrame([("a", 9, "head")], "category string, train_count int, class_group string")
    rows = E.per_class_report(pairs, labels, groups).collect()
    assert [r["category"] for r in rows] == ["e", "a", "b"]
    assert [r["class_group"] for r in rows] == ["unknown", "head", "unknown"] and rows[0]["support_test"] == 0
    dist = E.prediction_distribution(pairs).collect()
    assert [(r["category"], r["pred_count"]) for r in dist] == [("a", 5), ("b", 3), ("d", 1)]
    assert sum(r["pred_share"] for r in dist) == pytest.approx(1)


def test_head_confusion_is_dense_and_drops_other_labels(spark):
    groups = spark.createDataFrame(
        [("a", 9, "head"), ("b", 8, "head"), ("c", 8, "head"), ("d", 1, "tail")], "category string, train_count int, class_group string"
    )
    pairs = pairs_of(spark, *MIXED)
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in E.head_confusion(pairs, groups, 2).collect()}
    assert cells == {("a", "a"): 3, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 2}
    wide = {r["y_true"]: (r["a"], r["b"]) for r in E.head_confusion_wide(pairs, groups, 2).collect()}
    assert wide == {"a": (3, 1), "b": (0, 2)}


def test_overall_summary(spark):
    df = spark.createDataFrame(
        [("a", "a", 0, [5.0, 1.0, 0.0, 0.0]), ("b", "a", 1, [5.0, 1.0, 2.0, 3.0]), ("b", "a", 1, [5.0, 4.0, 3.0, 2.0])],
        "y_true string, y_pred string, label_id int, scores array<double>",
    )
    row = E.overall_summary(df, 4).first()
    assert row["accuracy"] == pytest.approx(1 / 3) and row["top3_accuracy"] == pytest.approx(2 / 3)
    assert row["top5_accuracy"] == 1.0 and row["n_test_samples"] == 3 and row["n_labels"] == 4
    assert row["macro_f1"] == pytest.approx(0.25)
    assert E.topk_accuracy(df, 2).first()[0] == pytest.approx(2 / 3)


@pytest.fixture(scope="module")
def tail_case(spark):
    train = spark.createDataFrame([("a",)] * 9 + [("b",)] * 2 + [("c",)] + [("q",)], "category string")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("q", 3)], "category string, label_id int")
    rows = [
        (1, "b", "a", [0.7, 0.2, 0.1, 0.0]), (2, "b", "a", [0.8, 0.1, 0.1, 0.0]), (3, "b", "b", [0.1, 0.8, 0.1, 0.0]),
        (4, "c", "b", [0.1, 0.6, 0.3, 0.0]), (5, "a", "b", [0.2, 0.7, 0.1, 0.0]), (6, "a", "a", [0.9, 0.1, 0.0, 0.0]),
    ]
    p = spark.createDataFrame([(*r, f"text {r[0]}") for r in rows], "record_id int, y_true string, y_pred string, proba array<double>, text string")
    tail = E.tail_classes(train, 3)
    metrics = E.tail_class_metrics(E.confusion_pairs(p), tail)
    return train, labels, p, metrics


def test_tail_metrics_and_worst(spark, tail_case):
    train, _, _, metrics = tail_case
    rows = {r["category"]: r for r in metrics.collect()}
    assert set(rows) == {"b", "c", "q"}
    assert (rows["b"]["support_test"], rows["b"]["fn_count"], rows["b"]["fp_count"]) == (3, 2, 2)
    assert rows["q"]["support_test"] == 0
    assert [r["category"] for r in E.worst_tail(metrics).collect()] == ["c", "b"]
    assert [r["category"] for r in E.worst_tail(metrics, 1).collect()] == ["c"]
    with pytest.raises(ValueError, match="fewer than 1"):
        E.tail_classes(train, 1)


def test_error_samples(tail_case):
    _, labels, p, metrics = tail_case
    worst = E.worst_tail(metrics)
    fn = E.fn_samples(p, worst, labels, "record_id", "text", 1)
    assert {(r["focus_class"], r["record_id"], r["true_class_proba"]) for r in fn.collect()} == {("b", 2, 0.1), ("c", 4, 0.3)}
    fp = E.fp_samples(p, worst, labels, "record_id", "text", 1).collect()
    assert [(r["focus_class"], r["record_id"], r["predicted_class_proba"], r["pred_confidence"], r["text"]) for r in fp] == [("b", 5, 0.7, 0.7, "text 5")]
    assert "WindowGroupLimit" in fn._jdf.queryExecution().executedPlan().toString()


def test_tail_summary(tail_case):
    _, _, _, metrics = tail_case
    row = E.tail_summary(metrics, E.worst_tail(metrics), 3).first()
    assert row["worst_classes"] == ["c", "b"] and row["n_tail_classes_train"] == 3
    assert row["n_tail_classes_with_test_support"] == 2 and row["tail_threshold"] == 3
    mean = metrics.agg(F.avg("f1")).first()[0]
    assert row["mean_tail_f1"] == pytest.approx(mean)
