"""Classification metrics, class-frequency groups and error samples.

Metrics start from :func:`confusion_pairs`, one row per (true, predicted) pair. Counting pairs is the only
step that touches all predictions, it aggregates before it shuffles, and everything after it works on at
most (number of classes)^2 rows, so a dominant class costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.scores import in_top_k
from labelloom.scale.joins import lookup_join, pin

# Group thresholds and report sizes.
HEAD_MIN, MID_MIN, TAIL_MAX = 1000, 100, 99
TAIL_THRESHOLD = 100
WORST_K, SAMPLES_PER_CLASS, TOP_HEAD_CONFUSION = 20, 5, 20
GROUPS = ["head", "mid", "tail"]


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion_pairs(predictions: DataFrame) -> DataFrame:
    """Rows per (true, predicted) pair, computed once: every metric reads this table."""
    return pin(predictions.groupBy("y_true", "y_pred").agg(F.count("*").alias("n")), "pairs")


def class_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """tp, fp, fn and support of every label seen as truth or prediction, optionally per ``by``."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y_true").alias("category"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("said")),
        F.struct(F.col("y_pred").alias("category"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("said")),
    )
    summed = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "category")
        .agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    )
    return summed.select(
        *by,
        "category",
        "tp",
        (F.col("said") - F.col("tp")).alias("fp"),
        (F.col("support") - F.col("tp")).alias("fn"),
        "support",
    )


def prf_support(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1, each 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        counts.withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def macro_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("f1").alias("macro_f1"))


def weighted_f1(metrics: DataFrame) -> DataFrame:
    return metrics.agg(_ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))


def _accuracy() -> Column:
    return _ratio(F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)), F.sum("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(_accuracy().alias("accuracy"))


def summary_metrics(pairs: DataFrame, *by: str) -> DataFrame:
    """Macro-F1, accuracy and weighted F1 in one row (per ``by``), from one aggregation over the per-class counts."""
    f1, support = F.col("f1"), F.col("support")
    return prf_support(class_counts(pairs, *by)).groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        _ratio(F.sum(f1 * support), F.sum("support")).alias("weighted_f1"),
    )


def classification_report(pairs: DataFrame) -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows, under ``label``."""
    per_class = prf_support(class_counts(pairs)).select(
        F.col("category").alias("label"), "precision", "recall", "f1", "support", "tp"
    )

    def weighted(column: str) -> Column:
        return _ratio(F.sum(F.col(column) * F.col("support")), F.sum("support"))

    averages = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("label"),
                F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                _ratio(F.sum("tp"), F.sum("support")).alias("f1"),
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("label"),
                F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"),
                F.avg("f1").alias("f1"),
                F.sum("support").alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("label"),
                weighted("precision").alias("precision"),
                weighted("recall").alias("recall"),
                weighted("f1").alias("f1"),
                F.sum("support").alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    return per_class.drop("tp").unionByName(averages)


def topk_accuracy(scored: DataFrame, k: int, scores: str = "scores", true_index: str = "label_id") -> DataFrame:
    """Share of rows whose true label is among the ``k`` best scores; a label without a score is a miss."""
    hit = F.coalesce(in_top_k(F.col(scores), F.col(true_index), k), F.lit(False))
    return scored.agg(F.avg(hit.cast("double")).alias(f"top{k}_accuracy"))


def overall_summary(predictions: DataFrame, n_labels: int, scores: str = "scores") -> DataFrame:
    """Macro-F1, accuracy, top-3, top-5, rows and labels, from one pass over the predictions."""
    def hits(k: int) -> Column:
        return F.sum(F.coalesce(in_top_k(F.col(scores), F.col("label_id"), k).cast("long"), F.lit(0)))

    pairs = predictions.groupBy("y_true", "y_pred").agg(
        F.count("*").alias("n"), hits(3).alias("hit3"), hits(5).alias("hit5")
    )
    pairs = pin(pairs, "pairs")
    totals = pairs.agg(
        _accuracy().alias("accuracy"),
        _ratio(F.sum("hit3"), F.sum("n")).alias("top3_accuracy"),
        _ratio(F.sum("hit5"), F.sum("n")).alias("top5_accuracy"),
        F.sum("n").alias("n_test_samples"),
    )
    macro = macro_f1(prf_support(class_counts(pairs))).scalar()
    return totals.select(macro.alias("macro_f1"), "*", F.lit(n_labels).cast("long").alias("n_labels"))


# --- class-frequency groups ----------------------------------------------------


def class_frequency_groups(
    train: DataFrame,
    label: str = "category",
    head_min: int = HEAD_MIN,
    mid_min: int = MID_MIN,
    tail_max: int = TAIL_MAX,
) -> DataFrame:
    """Training rows per class and its group: head, mid or tail; a gap between the thresholds is mid."""
    n = F.col("train_count")
    sizes = pin(train.groupBy(label).agg(F.count("*").alias("train_count")), "classes")
    return sizes.withColumn(
        "class_group",
        F.when(n >= head_min, "head").when(n >= mid_min, "mid").when(n <= tail_max, "tail").otherwise("mid"),
    )


def group_metrics(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Metrics per group over the rows whose true class is in it; groups without rows are absent.

    A label predicted from outside the group still counts as a class of the group, with F1 0.
    """
    named = groups.select(F.col("category").alias("y_true"), "class_group")
    inside = lookup_join(pairs, named, "y_true").select("class_group", "y_true", "y_pred", "n")
    f1 = prf_support(class_counts(inside, "class_group")).groupBy("class_group").agg(F.avg("f1").alias("macro_f1"))
    rows = inside.groupBy("class_group").agg(F.sum("n").alias("n_samples_test"), _accuracy().alias("accuracy"))
    sizes = groups.groupBy("class_group").agg(F.count("*").alias("n_classes"))
    return (
        rows.join(f1, "class_group")
        .join(sizes, "class_group")
        .select("class_group", "n_classes", "n_samples_test", "macro_f1", "accuracy")
    )


def per_class_report(pairs: DataFrame, labels: DataFrame, groups: DataFrame) -> DataFrame:
    """Metrics of every known label with its group (``unknown`` if never trained on), weakest first."""
    metrics = prf_support(class_counts(pairs)).select("category", "support", "precision", "recall", "f1")
    zero = F.lit(0.0)
    return (
        labels.select("category")
        .join(metrics, "category", "left")
        .join(groups.select("category", "class_group"), "category", "left")
        .select(
            "category",
            F.coalesce("support", F.lit(0)).alias("support_test"),
            F.coalesce("precision", zero).alias("precision"),
            F.coalesce("recall", zero).alias("recall"),
            F.coalesce("f1", zero).alias("f1"),
            F.coalesce("class_group", F.lit("unknown")).alias("class_group"),
        )
        .orderBy("f1", "category")
    )


def prediction_distribution(pairs: DataFrame) -> DataFrame:
    """How often each label is predicted, and its share, most frequent first."""
    total = pairs.agg(F.sum("n")).scalar()
    counts = pairs.groupBy(F.col("y_pred").alias("category")).agg(F.sum("n").alias("pred_count"))
    return counts.withColumn("pred_share", _ratio(F.col("pred_count"), total)).orderBy(
        F.desc("pred_count"), "category"
    )


def head_confusion(
    pairs: DataFrame, groups: DataFrame, top: int = TOP_HEAD_CONFUSION
) -> DataFrame:
    """Confusion counts among the ``top`` largest head classes, zero cells included, in long form."""
    head = (
        groups.filter(F.col("class_group") == "head").orderBy(F.desc("train_count"), "category").limit(top)
    )
    # At most ``top`` labels: the dense grid is built from one array.
    cells = (
        head.agg(F.collect_list("category").alias("labels"))
        .select("labels", F.explode("labels").alias("y_true"))
        .select("y_true", F.explode("labels").alias("y_pred"))
    )
    return cells.join(pairs, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def head_confusion_wide(
    pairs: DataFrame, groups: DataFrame, top: int = TOP_HEAD_CONFUSION
) -> DataFrame:
    """:func:`head_confusion` with one column per predicted label."""
    cells = pin(head_confusion(pairs, groups, top), "confusion")
    labels = [r["y_true"] for r in cells.select("y_true").distinct().orderBy("y_true").collect()]
    return cells.groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))


# --- tail errors -----------------------------------------------------------------


def tail_classes(train: DataFrame, threshold: int = TAIL_THRESHOLD, label: str = "category") -> DataFrame:
    """Classes with fewer than ``threshold`` training rows; raises if there are none."""
    sizes = train.groupBy(label).agg(F.count("*").alias("train_count"))
    tail = pin(sizes.filter(F.col("train_count") < threshold), "tail")
    if tail.isEmpty():
        raise ValueError(f"no class has fewer than {threshold} training rows")
    return tail


def tail_class_metrics(pairs: DataFrame, tail: DataFrame) -> DataFrame:
    """Metrics and error counts of the tail classes, measured against all predictions, weakest first."""
    counts = lookup_join(class_counts(pairs), tail.select("category"), "category", "left_semi")
    zero = F.lit(0).cast("long")
    filled = tail.select("category").join(counts, "category", "left").select(
        "category", *[F.coalesce(c, zero).alias(c) for c in ("tp", "fp", "fn", "support")]
    )
    return (
        prf_support(filled)
        .select(
            "category",
            F.col("support").alias("support_test"),
            "precision",
            "recall",
            "f1",
            F.col("fn").alias("fn_count"),
            F.col("fp").alias("fp_count"),
        )
        .orderBy("f1", "category")
    )


def worst_tail(metrics: DataFrame, k: int = WORST_K) -> DataFrame:
    """The ``k`` weakest tail classes that occur in the test rows."""
    return (
        metrics.filter(F.col("support_test") > 0)
        .orderBy("f1", F.desc("support_test"), "category")
        .limit(k)
    )


def _samples(
    predictions: DataFrame,
    worst: DataFrame,
    labels: DataFrame,
    id_column: str,
    text: str,
    n: int,
    focus: str,
    proba_name: str,
    ascending: bool,
) -> DataFrame:
    # ``worst`` has at most k rows, so the class list and its label ids are broadcast.
    classes = worst.select("category").join(labels, "category").select(
        F.col("category").alias("focus_class"), F.col("label_id").alias("_focus")
    )
    wrong = predictions.filter(F.col("y_true") != F.col("y_pred"))
    focused = wrong.join(F.broadcast(classes), wrong[focus] == classes["focus_class"]).withColumn(
        proba_name, F.get("proba", "_focus")
    )
    score = F.col(proba_name).asc() if ascending else F.col(proba_name).desc()
    nearest = Window.partitionBy("focus_class").orderBy(score, id_column)
    return (
        focused.withColumn("pred_confidence", F.array_max("proba"))
        .select("focus_class", id_column, "y_true", "y_pred", "pred_confidence", proba_name, text)
        .withColumn("_rank", F.row_number().over(nearest))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def fn_samples(
    predictions: DataFrame, worst: DataFrame, labels: DataFrame, id_column: str, text: str, n: int = SAMPLES_PER_CLASS
) -> DataFrame:
    """Per weak class, ``n`` of its rows predicted otherwise, least probable first."""
    return _samples(predictions, worst, labels, id_column, text, n, "y_true", "true_class_proba", True)


def fp_samples(
    predictions: DataFrame, worst: DataFrame, labels: DataFrame, id_column: str, text: str, n: int = SAMPLES_PER_CLASS
) -> DataFrame:
    """Per weak class, ``n`` other rows predicted as it, most probable first."""
    return _samples(predictions, worst, labels, id_column, text, n, "y_pred", "predicted_class_proba", False)


def tail_summary(
    metrics: DataFrame,
    worst: DataFrame,
    threshold: int = TAIL_THRESHOLD,
    k: int = WORST_K,
    n: int = SAMPLES_PER_CLASS,
) -> DataFrame:
    """Settings, tail sizes, mean tail F1 and the weakest classes in order."""
    order = F.struct("f1", (-F.col("support_test")).alias("s"), "category")
    names = worst.agg(F.sort_array(F.collect_list(order)).alias("w")).select("w.category").scalar()
    return metrics.agg(
        F.count("*").alias("n_tail_classes_train"),
        F.count_if(F.col("support_test") > 0).alias("n_tail_classes_with_test_support"),
        F.avg("f1").alias("mean_tail_f1"),
    ).select(
        F.lit(threshold).cast("long").alias("tail_threshold"),
        F.lit(k).cast("long").alias("worst_k"),
        F.lit(n).cast("long").alias("samples_per_class"),
        "*",
        names.alias("worst_classes"),
    )
