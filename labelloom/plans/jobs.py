"""End-to-end jobs: prepare a raw table, train and evaluate, analyse errors, encode sequences, compare settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import scores as SC
from labelloom.functions import text as T
from labelloom.operators import evaluate as E
from labelloom.operators import experiments as EX
from labelloom.operators import features as X
from labelloom.operators import model as M
from labelloom.operators import split as S
from labelloom.plans.slice import PreparedSlice
from labelloom.scale.joins import lookup_join
from labelloom.scale.staging import stage
from labelloom.schema import NARRATIVE, RECORD_ID, SPLITS
from labelloom.sources import readers as R
from labelloom.sources import writers as W


def prepare_data(raw: DataFrame, out: str, seed: int | None = None) -> PreparedSlice:
    """Prepare, split, check for leakage, and write splits and metadata under ``out``."""
    prepared = PreparedSlice(raw) if seed is None else PreparedSlice(raw, seed=seed)
    prepared.check()
    W.write_splits(prepared.split_rows(), f"{out}/splits")
    metadata = W.split_metadata(prepared.numbered, prepared.funnel(), prepared.seed, prepared.min_text_length)
    W.write_metadata(metadata, f"{out}/metadata")
    return prepared


def train_category(spark: SparkSession, data: str, model_path: str, stack: M.TextStack, report: str) -> M.FittedStack:
    """Fit on train, store the model, write validation metrics and the training record."""
    train = R.read_split(spark, f"{data}/splits", "train")
    val = R.read_split(spark, f"{data}/splits", "val")
    fitted = M.fit_tfidf_lr(train, stack, RECORD_ID, NARRATIVE)
    M.save_model(fitted, model_path)
    pairs = _pairs(fitted, val)
    metrics = E.summary_metrics(pairs)
    W.write_report(metrics, f"{report}/category_metrics_val", "json")
    W.write_report(E.classification_report(pairs), f"{report}/category_report_val")
    record = metrics.select(
        F.lit(M.STACK_NAME).alias("stack_name"),
        F.lit(train.count()).alias("n_train_rows"),
        F.lit(val.count()).alias("n_val_rows"),
        F.lit(fitted.labels.count()).alias("n_labels"),
        F.lit(NARRATIVE).alias("text_column"),
        F.lit("category").alias("target_column"),
        "macro_f1",
        "accuracy",
    )
    W.write_metadata(record, f"{model_path}/training_metadata")
    return fitted


def _scored(fitted: M.FittedStack, rows: DataFrame) -> DataFrame:
    scored = M.predict_proba(fitted, rows, RECORD_ID, NARRATIVE, ("category",))
    return scored.withColumnRenamed("category", "y_true")


def _pairs(fitted: M.FittedStack, rows: DataFrame) -> DataFrame:
    return E.confusion_pairs(_scored(fitted, rows))


def evaluate_category(spark: SparkSession, data: str, model_path: str, report: str) -> DataFrame:
    """Score the test split with a stored model and write macro-F1, accuracy and weighted F1."""
    test = R.read_split(spark, f"{data}/splits", "test")
    metrics = E.summary_metrics(_pairs(M.load_model(spark, model_path), test))
    W.write_report(metrics, f"{report}/category_metrics_test", "json")
    return metrics


def analyse_tail_errors(
    spark: SparkSession, data: str, model_path: str, report: str, threshold: int = E.TAIL_THRESHOLD
) -> DataFrame:
    """Metrics, worst classes and error samples of rare classes on the test split."""
    fitted = M.load_model(spark, model_path)
    train = R.read_split(spark, f"{data}/splits", "train")
    test = R.read_split(spark, f"{data}/splits", "test")
    scored = stage(_scored(fitted, test), "scored")
    metrics = E.tail_class_metrics(E.confusion_pairs(scored), E.tail_classes(train, threshold))
    worst = E.worst_tail(metrics)
    # Samples are picked on narrow rows; the text of the few chosen ones is joined afterwards.
    for name, sample in (("fn", E.fn_samples), ("fp", E.fp_samples)):
        chosen = sample(scored.withColumn("_none", F.lit(None)), worst, fitted.labels, RECORD_ID, "_none").drop("_none")
        texts = test.select(RECORD_ID, "complaint_id", F.col(NARRATIVE).alias("text"))
        W.write_report(texts.join(F.broadcast(chosen), RECORD_ID).drop(RECORD_ID), f"{report}/tail_worst_{name}_samples")
    W.write_report(metrics, f"{report}/tail_class_metrics")
    W.write_report(worst, f"{report}/tail_worst_metrics")
    summary = E.tail_summary(metrics, worst, threshold)
    W.write_report(summary, f"{report}/tail_error_summary", "json")
    return summary


def analyse_scores(
    scores: DataFrame,
    labels: DataFrame,
    train: DataFrame,
    report: str,
    head_min: int = E.HEAD_MIN,
    mid_min: int = E.MID_MIN,
    tail_max: int = E.TAIL_MAX,
) -> DataFrame:
    """Full diagnosis of stored scores (``label_id``, ``scores``) of any model, neural ones included."""
    named = labels.select(F.col("label_id").alias("_best"), F.col("category").alias("y_pred"))
    predicted = lookup_join(scores.withColumn("_best", SC.argmax_index(F.col("scores"))), named, "_best", "left")
    predicted = X.decode_labels(predicted, labels).withColumnRenamed("category", "y_true")
    pairs = E.confusion_pairs(predicted)
    groups = E.class_frequency_groups(train, "category", head_min, mid_min, tail_max)
    overall = E.overall_summary(predicted, labels.count())
    W.write_report(overall, f"{report}/summary", "json")
    W.write_report(E.group_metrics(pairs, groups), f"{report}/head_mid_tail_metrics")
    W.write_report(E.per_class_report(pairs, labels, groups), f"{report}/per_class_metrics")
    W.write_report(E.prediction_distribution(pairs), f"{report}/predicted_class_distribution")
    W.write_report(E.classification_report(pairs), f"{report}/classification_report")
    W.write_report(E.head_confusion_wide(pairs, groups), f"{report}/confusion_head_top20")
    return overall


def prepare_sequences(
    spark: SparkSession,
    data: str,
    out: str,
    max_vocab_size: int = 50_000,
    min_token_freq: int = 2,
    max_length: int = 256,
) -> DataFrame:
    """Vocabulary from train, then ids, masks and labels of every split, with their metadata."""
    splits = R.drop_unlabelled(spark.read.parquet(f"{data}/splits"))
    S.assert_labels_seen(splits)
    tokens = splits.select(RECORD_ID, "split", "category", T.simple_tokenize(F.col(NARRATIVE)).alias("tokens"))
    train = tokens.filter(F.col("split") == SPLITS[0])
    labels = X.label_index(train)
    vocab = X.build_vocab(train, max_vocab_size, min_token_freq)
    encoded = X.encode_labels(X.encode(tokens, vocab, max_length), labels)
    W.write_encoded(encoded, f"{out}/encoded")
    W.write_vocab(vocab, f"{out}/vocab")
    metadata = W.encode_metadata(vocab, labels, max_length, max_vocab_size, min_token_freq)
    W.write_metadata(metadata, f"{out}/metadata")
    return metadata


def tune_category(splits: DataFrame, report: str, grid: dict | None = None) -> DataFrame:
    """Leaderboard of a settings grid and its best row."""
    board = EX.grid_leaderboard(splits, grid)
    W.write_report(board.drop("params"), f"{report}/category_tuning_results")
    W.write_report(board, f"{report}/category_tuning_results_json", "json")
    best = EX.best_experiment(board)
    W.write_report(best, f"{report}/category_tuning_best", "json")
    return best


def best_settings(best: DataFrame) -> M.TextStack:
    """Stack settings of the leading experiment."""
    return M.build_stack(M.STACK_NAME, json.loads(best.first()["params"]))
