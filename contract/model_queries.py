"""Fitting, scoring and comparing linear models, with the library's default settings.

Coefficients have no SQL twin. What SQL can tell is checked: which rows and settings there are, label counts, vocabulary
sizes, that the gradient ended the fit, that probabilities add up and labels are their largest, that orders follow the scores.
"""

from __future__ import annotations

import json
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract import sql as Q
from contract.registry import query
from contract.tables import split_of, splits, train_rows
from labelloom.functions import scores as SC
from labelloom.operators import evaluate as E
from labelloom.operators import experiments as EX
from labelloom.operators import model as M
from labelloom.scale.staging import shared_dir, stage
from labelloom.schema import NARRATIVE, RECORD_ID


@lru_cache(maxsize=2)
def _fitted(application: str, spark, sf_dir: str) -> M.FittedStack:
    return M.fit_tfidf_lr(train_rows(spark, sf_dir), M.build_stack(M.STACK_NAME), RECORD_ID, NARRATIVE)


@lru_cache(maxsize=2)
def _board(application: str, spark, sf_dir: str) -> DataFrame:
    return stage(EX.grid_leaderboard(splits(spark, sf_dir)), "board")


@lru_cache(maxsize=2)
def _trials(application: str, spark, sf_dir: str) -> DataFrame:
    return stage(EX.random_search(splits(spark, sf_dir)), "trials")


@lru_cache(maxsize=2)
def _ablation(application: str, spark, sf_dir: str) -> DataFrame:
    return stage(EX.vectorizer_ablation(splits(spark, sf_dir)), "ablation")


def fitted(spark, sf_dir) -> M.FittedStack:
    return _fitted(spark.sparkContext.applicationId, spark, sf_dir)


def board(spark, sf_dir) -> DataFrame:
    return _board(spark.sparkContext.applicationId, spark, sf_dir)


def trials(spark, sf_dir) -> DataFrame:
    return _trials(spark.sparkContext.applicationId, spark, sf_dir)


def ablation(spark, sf_dir) -> DataFrame:
    return _ablation(spark.sparkContext.applicationId, spark, sf_dir)


def forget() -> None:
    """Drop the shared fits, so that the next query fits again."""
    for shared in (_fitted, _board, _trials, _ablation):
        shared.cache_clear()


# --- fit and scoring ------------------------------------------------------------------

_K = "(SELECT count(*) FROM labels_by_id)"


@query(Q.with_(Q.vocab_ctes(), """
SELECT (SELECT count(DISTINCT category) FROM prepared WHERE split = 'train') AS n_labels,
       (SELECT count(*) FROM vocab) AS n_features, TRUE AS gradient_below_1e_4, TRUE AS beats_majority_on_train"""))
def fit_tfidf_lr(spark, sf_dir):
    """The default fit on all training rows: sizes, whether every gradient entry is at most 1e-4, and a comparison."""
    model, train = fitted(spark, sf_dir), train_rows(spark, sf_dir)
    scored = M.predict(model, train, RECORD_ID, NARRATIVE, ("category",)).withColumnRenamed("category", "y_true")
    mine = E.summary_metrics(E.confusion_pairs(scored)).select(F.col("macro_f1").alias("mine"))
    plain = M.majority_baseline(train, train.select(F.col("category").alias("y_true")))
    theirs = E.summary_metrics(E.confusion_pairs(plain)).select(F.col("macro_f1").alias("theirs"))
    return mine.join(theirs).select(
        F.lit(model.n_labels).alias("n_labels"), F.lit(model.vocab.size).alias("n_features"),
        F.lit(model.converged and model.gradient <= 1e-4).alias("gradient_below_1e_4"),
        (F.col("mine") > F.col("theirs")).alias("beats_majority_on_train"),
    )


@query()
def fit_tfidf_lr_quality(spark, sf_dir):
    """Test quality of the default fit, with the steps it took and its largest gradient entry."""
    model = fitted(spark, sf_dir)
    scored = M.predict(model, split_of(spark, sf_dir, "test"), RECORD_ID, NARRATIVE, ("category",))
    metrics = E.summary_metrics(E.confusion_pairs(scored.withColumnRenamed("category", "y_true")))
    return metrics.select("*", F.lit(model.steps).alias("steps"), F.lit(model.gradient).alias("gradient"))


@query(Q.with_(Q.LABELS, f"""
SELECT record_id, {_K} AS n_classes, 1e0 AS total, TRUE AS in_range FROM prepared WHERE split = 'test'"""))
def predict_proba(spark, sf_dir):
    scored = M.predict_proba(fitted(spark, sf_dir), split_of(spark, sf_dir, "test"), RECORD_ID, NARRATIVE)
    total = F.aggregate("proba", F.lit(0.0), lambda a, x: a + x)
    return scored.select(
        RECORD_ID, F.size("proba").alias("n_classes"), F.round(total, 6).alias("total"),
        F.forall("proba", lambda p: (p >= 0) & (p <= 1)).alias("in_range"),
    )


@query(Q.with_(Q.LABELS, """
SELECT record_id, category, TRUE AS label_is_largest, TRUE AS label_is_known FROM prepared WHERE split IN ('val', 'test')"""))
def predict(spark, sf_dir):
    model, rows = fitted(spark, sf_dir), split_of(spark, sf_dir, "val", "test")
    labels = model.labels.select(F.col("category").alias("y_pred"), "label_id")
    scored = M.predict_proba(model, rows, RECORD_ID, NARRATIVE, ("category",)).join(F.broadcast(labels), "y_pred", "left")
    return scored.select(
        RECORD_ID, "category", (SC.argmax_index(F.col("proba")) == F.col("label_id")).alias("label_is_largest"),
        F.col("label_id").isNotNull().alias("label_is_known"),
    )


@query()
def predict_labels(spark, sf_dir):
    """Predicted label of every held-out row, with its probability."""
    scored = M.predict_proba(fitted(spark, sf_dir), split_of(spark, sf_dir, "val", "test"), RECORD_ID, NARRATIVE)
    return scored.select(RECORD_ID, "y_pred", F.round(F.array_max("proba"), 6).alias("pred_confidence"))


@query(Q.with_(Q.PREPARED, "SELECT record_id, TRUE AS same_label, TRUE AS same_proba FROM prepared WHERE split = 'test'"))
def predict_batch(spark, sf_dir):
    """The test rows scored with a stored model, beside the scores of the model it was stored from."""
    path = f"{shared_dir(spark)}/model-{uuid4().hex}"
    model, rows = fitted(spark, sf_dir), split_of(spark, sf_dir, "test")
    M.save_model(model, path)
    stored = M.predict_batch(rows, path, RECORD_ID, NARRATIVE)
    direct = M.predict_proba(model, rows, RECORD_ID, NARRATIVE).select(
        RECORD_ID, F.col("y_pred").alias("_label"), F.col("proba").alias("_proba")
    )
    apart = F.array_max(F.zip_with("proba", "_proba", lambda a, b: F.abs(a - b)))
    return stored.join(direct, RECORD_ID).select(
        RECORD_ID, (F.col("y_pred") == F.col("_label")).alias("same_label"), (apart < 1e-9).alias("same_proba")
    )


# --- settings -----------------------------------------------------------------------------

_GRID_ROWS = ", ".join(
    f"('{name}', {p['max_features']}, {p['min_df']}, {p['max_df']}e0, {p['c']}e0, "
    + ("NULL" if p["class_weight"] is None else f"'{p['class_weight']}'") + ")"
    for name, p in EX.default_grid().items()
)
_GRID = f"""
grid AS (SELECT * FROM (VALUES {_GRID_ROWS})
  AS g(experiment_name, max_features, min_df, max_df, c, class_weight))"""
_STATS = Q.PREPARED + f""",
doc_terms AS MATERIALIZED ({Q.terms("prepared")}),
tf AS MATERIALIZED (
  SELECT record_id, term FROM (SELECT record_id, split, unnest(terms) AS term FROM doc_terms) WHERE split = 'train' GROUP BY ALL
),
stats AS MATERIALIZED (SELECT df, count(*) AS terms FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) GROUP BY df),
n_train AS (SELECT count(*) AS n FROM prepared WHERE split = 'train')"""
_SIZES = """
least(max_features, (SELECT CAST(sum(terms) AS BIGINT) FROM stats, n_train WHERE df >= min_df AND df <= max_df * n))"""


@query(Q.with_(_GRID, "SELECT experiment_name, max_features, min_df, max_df, c, class_weight, '1,2' AS ngram_range FROM grid"))
def build_stack(spark, sf_dir):
    """The settings of every named experiment, by way of the stack each one builds."""
    rows = []
    for name, params in EX.default_grid().items():
        stack = M.build_stack(M.STACK_NAME, params)
        rows.append((name, stack.max_features, stack.min_df, stack.max_df, stack.c, stack.class_weight, ",".join(map(str, stack.ngram_range))))
    return spark.createDataFrame(
        rows, "experiment_name string, max_features bigint, min_df bigint, max_df double, c double, class_weight string, ngram_range string"
    )


_BAD_STACKS = {
    "unknown name": ("forest", {}), "neural name": ("bilstm", {}), "unknown setting": (M.STACK_NAME, {"depth": 3}),
    "unknown analyzer": (M.STACK_NAME, {"analyzer": "sentence"}), "unknown class weight": (M.STACK_NAME, {"class_weight": "heavy"}),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', TRUE)" for name in _BAD_STACKS) + ") AS x(problem, raises)")
def build_stack_errors(spark, sf_dir):
    rows = []
    for problem, (name, params) in _BAD_STACKS.items():
        try:
            M.build_stack(name, params)
            rows.append((problem, False))
        except ValueError:
            rows.append((problem, True))
    return spark.createDataFrame(rows, "problem string, raises boolean")


@query(Q.with_(_STATS + "," + _GRID, f"""
SELECT experiment_name, max_features, min_df, max_df, c, class_weight, {_SIZES} AS n_features, TRUE AS scores_in_range FROM grid"""))
def grid_leaderboard(spark, sf_dir):
    """The 18 settings with what they were fitted with; the scores are in :func:`grid_leaderboard_scores`."""
    params = F.from_json("params", "max_features bigint, min_df bigint, max_df double, c double, class_weight string")
    return board(spark, sf_dir).select(
        "experiment_name", params.alias("p"), "n_features",
        ((F.col("macro_f1") > 0) & (F.col("macro_f1") <= 1) & (F.col("accuracy") > 0) & (F.col("accuracy") <= 1)).alias("scores_in_range"),
    ).select("experiment_name", "p.*", "n_features", "scores_in_range")


@query()
def grid_leaderboard_scores(spark, sf_dir):
    return board(spark, sf_dir)


@query(Q.with_(_GRID, """
SELECT count(*) AS experiments, 1 AS best_rows, TRUE AS best_has_highest_score, TRUE AS params_rebuild_a_stack FROM grid"""))
def best_experiment(spark, sf_dir):
    """The leading row of the board of all 18 fits against a plain maximum over that board."""
    rows = board(spark, sf_dir)
    best = stage(EX.best_experiment(rows), "best")
    name, top, params = best.select("experiment_name", "macro_f1", "params").first()
    rebuilt = M.build_stack(M.STACK_NAME, json.loads(params)) == M.build_stack(M.STACK_NAME, EX.default_grid()[name])
    first = rows.filter(F.col("macro_f1") == top).agg(F.min("experiment_name").alias("first"))
    return rows.agg(F.count("*").alias("experiments"), F.max("macro_f1").alias("most")).join(first).select(
        "experiments", F.lit(best.count()).alias("best_rows"),
        ((F.col("most") == top) & (F.col("first") == name)).alias("best_has_highest_score"), F.lit(rebuilt).alias("params_rebuild_a_stack"),
    )


_DRAWS = ", ".join(
    f"({i}, {p['max_features']}, {p['min_df']}, {p['max_df']}e0, " + ("NULL" if p["class_weight"] is None else f"'{p['class_weight']}'") + f", {p['c']!r})"
    for i, p in enumerate(EX.random_settings(30))
)


@query(Q.with_(_STATS + f""",
draws AS (SELECT * FROM (VALUES {_DRAWS}) AS d(trial_number, max_features, min_df, max_df, class_weight, c))""", f"""
SELECT trial_number, max_features AS param_max_features, min_df AS param_min_df, max_df AS param_max_df,
       class_weight AS param_class_weight, round(CAST(c AS DOUBLE), 9) AS param_c, {_SIZES} AS n_features, TRUE AS scores_in_range
FROM draws"""))
def random_search(spark, sf_dir):
    """The 30 draws with what they were fitted with; states and scores are in :func:`random_search_trials`."""
    in_range = (F.col("macro_f1") >= 0) & (F.col("macro_f1") <= 1) & F.col("state").isin("COMPLETE", "PRUNED")
    return trials(spark, sf_dir).select(
        "trial_number", *[f"param_{k}" for k in ("max_features", "min_df", "max_df", "class_weight")],
        F.round("param_c", 9).alias("param_c"), "n_features", in_range.alias("scores_in_range"),
    )


@query("SELECT * FROM (VALUES (0, 'PRUNED', 20), (1, 'PRUNED', 6), (2, 'COMPLETE', 4)) AS x(rung, state, trials)")
def random_search_rungs(spark, sf_dir):
    """How many of the 30 trials ended at each rung: a third goes on each time."""
    return trials(spark, sf_dir).groupBy("rung", "state").agg(F.count("*").alias("trials"))


@query()
def random_search_trials(spark, sf_dir):
    return trials(spark, sf_dir)


@query()
def vectorizer_ablation(spark, sf_dir):
    return ablation(spark, sf_dir)


@query("SELECT TRUE AS macro_f1_is_highest, TRUE AS weighted_f1_is_highest, 4 AS configs")
def best_ablation(spark, sf_dir):
    """The best vectoriser by each of two metrics against plain maxima over the table."""
    table = ablation(spark, sf_dir)
    best = EX.best_ablation(table)
    checks = []
    for metric in ("macro_f1", "weighted_f1"):
        top = table.agg(F.max(f"test_{metric}").alias("top"))
        own = table.select(F.col("config").alias(f"best_by_test_{metric}"), F.col(f"test_{metric}").alias(f"own_{metric}"))
        best = best.join(F.broadcast(own), f"best_by_test_{metric}").join(F.broadcast(top.withColumnRenamed("top", f"top_{metric}")))
        checks.append((F.col(f"own_{metric}") == F.col(f"top_{metric}")).alias(f"{metric}_is_highest"))
    return best.select(*checks, F.lit(table.count()).alias("configs"))
